"""Search: filter, BM25, top-k, and results as JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DYNAMIC, Field, IndexConfig
from brindle.functions.parse import json_path
from brindle.functions.tokenize import literal_tokens, tokens
from brindle.plans.bind import Searchable, column, field_tokens, predicate, scored_leaves
from brindle.plans.grammar import Boolean, Node, Term, parse_query

K1, B = 1.2, 0.75
SCORE = "score"


def matches(table: Searchable, query: str) -> DataFrame:
    """The rows that match, unranked."""
    return table.df.where(predicate(table, parse_query(query)))


def text_terms(table: Searchable, node: Node) -> list[tuple[Field, str, float]]:
    """(field, token, boost) for every text term of a query that can score; phrases score by their tokens."""
    found = []
    for leaf, boost in scored_leaves(node):
        if isinstance(leaf, Term):
            for field, _ in table.targets(leaf.field):
                if field.kind == "text":
                    found += [(field, token, boost) for token in literal_tokens(leaf.text, field.tokenizer)]
    return found


def _counted(table: Searchable, terms: list[tuple[Field, str, float]]) -> DataFrame:
    """The table with each text's token count (``_len<k>``) and each term's frequency (``_tf<k>``)."""
    fields = list(dict.fromkeys(f for f, _, _ in terms))
    df = table.df.select("*", *[field_tokens(f).alias(f"_tok{n}") for n, f in enumerate(fields)])

    def frequency(words: str, token: str) -> Column:
        return F.size(F.filter(words, lambda t: t == token))

    tf = [frequency(f"_tok{fields.index(f)}", token).alias(f"_tf{k}") for k, (f, token, _) in enumerate(terms)]
    lengths = [F.size(f"_tok{fields.index(f)}").alias(f"_len{k}") for k, (f, _, _) in enumerate(terms)]
    return df.select("*", *tf, *lengths).drop(*[f"_tok{n}" for n in range(len(fields))])


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of the whole table: documents, tokens by field, and documents that hold a (field, term)."""

    documents: int
    lengths: dict[str, int]
    holding: dict[tuple[str, str], int]


def ranked(table: Searchable, query: str, known: Statistics | None = None) -> DataFrame:
    """The rows that match with their BM25 score, by statistics over the whole table.

    Without ``known`` statistics, one aggregation without a shuffle of rows gives them: one row, as wide as the
    query. With them the table may be any part that has all matches. A leaf that isn't text adds its boost
    to each match that has no text term.
    """
    node = parse_query(query)
    terms = text_terms(table, node)
    if not terms:
        return matches(table, query).withColumn(SCORE, F.lit(float(node.boost)))
    counted = _counted(table, terms)
    known = known or _statistics(counted, terms)
    score = F.lit(0.0)
    for k, (field, token, boost) in enumerate(terms):
        n, df = known.documents, known.holding.get((field.name, token), 0)
        mean = known.lengths.get(field.name, 0) / max(n, 1)
        idf = F.log(F.lit(1.0) + (F.lit(float(n - df)) + 0.5) / (F.lit(float(df)) + 0.5))
        tf = F.greatest(F.col(f"_tf{k}"), F.lit(0)).cast("double")
        tf = tf if field.frequencies else F.least(tf, F.lit(1.0))
        norm = K1 * (1 - B + B * F.col(f"_len{k}") / F.lit(mean or 1.0)) if field.fieldnorms else F.lit(K1)
        score = score + boost * idf * tf * (K1 + 1) / (tf + norm)
    hits = counted.where(predicate(table, node)).withColumn(SCORE, F.coalesce(score, F.lit(0.0)))
    return hits.drop(*[f"_{kind}{k}" for kind in ("tf", "len") for k in range(len(terms))])


def _statistics(counted: DataFrame, terms: list[tuple[Field, str, float]]) -> Statistics:
    facts = counted.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))],
        *[F.sum(F.greatest(F.col(f"_len{k}"), F.lit(0))).alias(f"sum{k}") for k in range(len(terms))],
    ).first()
    lengths = {field.name: facts[f"sum{k}"] or 0 for k, (field, _, _) in enumerate(terms)}
    return Statistics(facts["n"], lengths, {(field.name, token): facts[f"df{k}"] for k, (field, token, _) in enumerate(terms)})


def top(hits: DataFrame, limit: int, ties: list[str], per: str | None = None) -> DataFrame:
    """The best ``limit`` by score, then by ``ties``; of each value of ``per`` if that is given."""
    order = [F.col(SCORE).desc(), *[F.col(t) for t in ties]]
    if per is None:
        return hits.orderBy(*order).limit(limit)
    nth = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return hits.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def rfc3339(time: Column) -> Column:
    """UTC with a Z; a fraction only if there is one."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(time, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, fraction, F.lit("Z"))


def _shown(field: Field) -> Column:
    value = column(field.name)
    if field.kind == "datetime":
        return F.transform(value, rfc3339) if field.array else rfc3339(value)
    if field.kind == "ip":
        return F.transform(value, lambda t: t) if field.array else value
    return value


def result_json(hits: DataFrame, config: IndexConfig, include_unindexed: bool = False) -> DataFrame:
    """One column ``json``: indexed, stored fields as nested objects and the keys of the spill-over; keys are sorted at every level."""
    fields = [f for f in config.leaves() if f.stored and (f.indexed or include_unindexed)]

    def tree(depth: int, group: list[Field]) -> list[tuple[str, Column, Column]]:
        """(name, value as a variant, whether it is there)."""
        by_name: dict[str, list[Field]] = {}
        for f in group:
            by_name.setdefault(f.path[depth], []).append(f)
        out = []
        for name, inside in by_name.items():
            if len(inside) == 1 and len(inside[0].path) == depth + 1:
                value = _shown(inside[0])
                made = value if inside[0].kind == "dynamic_object" and not inside[0].array else _variant(value, inside[0])
                out.append((name, made, value.isNotNull()))
            else:
                children = tree(depth + 1, inside)
                there = [c for _, _, c in children]
                any_there = there[0]
                for c in there[1:]:
                    any_there = any_there | c
                out.append((name, F.to_variant_object(_map(children)), any_there))
        return out

    def _variant(value: Column, field: Field) -> Column:
        if field.array:
            return F.to_variant_object(value)
        return F.try_variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant")

    def _map(children: list[tuple[str, Column, Column]]) -> Column:
        entries = F.array(*[F.when(there, F.struct(F.lit(name).alias("key"), value.alias("value"))) for name, value, there in children])
        return F.map_from_entries(F.array_compact(entries))

    top_level = tree(0, fields)
    dynamic = F.coalesce(F.try_variant_get(column(DYNAMIC), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    whole = F.map_concat(_map(top_level), dynamic) if top_level else dynamic
    return hits.select(F.to_json(F.to_variant_object(whole)).alias("json"))


def places(table: Searchable, field: Field, id_col: str) -> DataFrame:
    """(id, position, term): each token of a text field."""
    return table.df.select(F.col(id_col).alias("id"), F.posexplode(field_tokens(field)).alias("position", "term"))


def postings(table: Searchable, field: Field, id_col: str) -> DataFrame:
    """(term, id, tf, positions): the inverted form of one text field, for repeated searches for terms."""
    grouped = places(table, field, id_col).groupBy("term", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return grouped.select("term", "id", "tf", "positions")


def needed_terms(table: Searchable, node: Node) -> Callable[[Callable[[str, str], Column]], Column] | None:
    """What of a tree's text terms a match must have, as a function of "has (field, token)"; null if any row could match.

    It holds for more rows than the tree: phrases count by their tokens, and what isn't text is left open.
    """
    if isinstance(node, Boolean):
        if node.must:
            parts = [p for p in (needed_terms(table, n) for n in node.must) if p]
            return (lambda has: reduce(lambda a, b: a & b, [p(has) for p in parts])) if parts else None
        some = [needed_terms(table, n) for n in node.should]
        return (lambda has: reduce(lambda a, b: a | b, [p(has) for p in some])) if some and all(some) else None
    if not isinstance(node, Term) or node.prefix:
        return None
    targets = table.targets(node.field)
    if any(field.kind != "text" or field.tokenizer == "raw" for field, _ in targets):
        return None
    by_field = [(field.name, literal_tokens(node.text, field.tokenizer)) for field, _ in targets]
    if any(not words for _, words in by_field):
        return None
    return lambda has: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(name, w) for w in words]) for name, words in by_field])


def postings_search(found: DataFrame, terms: list[str]) -> DataFrame:
    """Ids with all the terms, from a postings table."""
    hits = found.where(F.col("term").isin(*terms)).groupBy("id").agg(F.countDistinct("term").alias("n"))
    return hits.where(F.col("n") == len(set(terms))).select("id")
