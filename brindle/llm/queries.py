"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import chat_format, decontaminate, html_text, license_scan, mixing, pii, quality_classifier, quality_rules, simhash, token_count
from brindle.sources.tables import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. SQL can't express the local parsers; tests hold it against the patterns."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.digest("text").alias("r")).select("doc_id", "r.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: taken is the document's words times its copies. As in its SQL, the first misfit ends a source's sample."""
    out = mixing.mix(mixing.weigh(read_table(spark, sf_dir, "documents")), past_misfits=False)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP2_SQL = r"""
with weighed as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5('mix-1' || chr(31) || coalesce(doc_id::varchar, '') || chr(31) || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5::double)
      / 281474976710656::double as u
  from documents),
sums as (select source, count(*) as n, sum(size)::bigint as words from weighed group by source),
ranked as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight,
    (2 * words)::double as cap, (sum(words) over () * 150)::double / 100.0::double as budget
  from sums),
levels as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as level
  from ranked),
free as (select level from levels where level * weight <= cap order by cap / weight, source is null, source limit 1),
goals as (select source, words, case when (select level from free) is null then cap else least((select level from free) * weight, cap) end as target from levels),
rated as (
  select w.*, words, target, case when words > 0 then target / words else 0 end as rate
  from weighed w join goals g on w.source is not distinct from g.source),
due as (
  select *, case when size > 0 then floor(rate) else 0 end as certain, target - floor(rate) * words as due,
    case when rate - floor(rate) > 0 and size > 0 then u / (1 - u) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) end as rank,
    row_number() over (order by doc_id, source, size) as r
  from rated),
chosen as (
  select *, rank is not null and sum(case when rank is null then 0 else size end) over (partition by source order by rank nulls last, size, r rows unbounded preceding) <= due as chosen
  from due),
gaps as (select source, max(due) - sum(case when chosen then size else 0 end) as gap from chosen group by source),
closing as (
  select c.r from chosen c join gaps g on c.source is not distinct from g.source
  where rank is not null and not chosen and size < 2 * gap
  qualify row_number() over (partition by c.source order by abs(gap - size), rank, c.r) = 1)
select doc_id, size, words as source_size, target,
  ((certain + case when chosen or r in (select r from closing) then 1 else 0 end) * size)::bigint as taken
from chosen
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures and both verdicts for every document."""
    return quality_rules.measure(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with t as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
windows as (
  select r, i, array_to_string(list_slice(w, i, i + 4), ' ') as k
  from (select r, w, unnest(range(1, len(w) - 3)) as i from w)),
twice as (select r, i from windows qualify count(*) over (partition by r, k) > 1),
repeated as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
f as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(l) as n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper
  from w left join repeated using (r)),
g as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 100 * n_upper > 40 * word_chars or word_chars not between 2 * n_words and 15 * n_words
    or 2 * n_dup_lines > n_lines) as kept
from g
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document. SQL can't express the rules and their suppression; tests hold it against plain ones."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", license_scan.licenses("text").alias("r"))
    firsts = F.transform("r.base", lambda d: d["first"])
    return docs.select(
        "doc_id",
        "r.n_words",
        F.size("r.base").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        license_scan.label_list(F.col("r.base")).alias("base_labels"),
        license_scan.label_list(F.concat("r.base", "r.more")).alias("labels"),
        "r.score",
    )


#: Tokens over which a text is over the limit.
TOKEN_LIMIT = 512


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. SQL can't express the merging; tests hold it against the tokenizer's own library."""
    import public_tokenizers

    count = token_count.token_counter(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count(F.col("text")).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    n_hit = decontaminate.hit_words()
    return out.select(
        "doc_id",
        "found.n_words",
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_window as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as k
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)),
lengths as (select distinct n from item_window),
doc_window as (
  select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lengths where len(w) >= n)),
hit as (select r, d.n, i, item_id from doc_window d join item_window using (n, k)),
hit_word as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
hit_item as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit_word using (r) left join hit_item using (r)
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back. Its SQL tells from the rows what must come back, and how much the marks and escapes add."""
    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(rows.unionByName(planted)).withColumnRenamed("id", "conv_id")


#: What a turn's marks, its escaped role and its escaped text add up to: a backslash more for each of these strings and each backslash.
_OP7_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + " + " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL
)
OP7_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured as (
  select *, {len(chat_format.TURN) + 1 + len(chat_format.END)} + {_OP7_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), ''))
    + {_OP7_ESCAPED.format("text")} as size from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size)::bigint as formatted_chars
from measured group by conv_id
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document. SQL can't express the fit; tests measure accuracy on held-out labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    score = quality_classifier.scorer(spark, quality_classifier.train(docs, read_table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.classes(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page. SQL can't express the layout; tests hold it against worked examples."""
    pages = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_token_count": op5_token_count,
    "op6_decontamination": op6_decontamination,
    "op7_chat_format": op7_chat_format,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
}
ORACLES = {"op2_mixing": OP2_SQL, "op3_quality_rules": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_chat_format": OP7_SQL}
