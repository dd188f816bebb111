"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share a budget of words by weight, none above a multiple of what it has
(``targets``). A source whose target is r times its words gives every document
floor(r) certain whole copies. The rest is a sample of fixed size without
replacement: a document's inclusion odds are p / (1 - p) with p = r - floor(r)
(times its own weight, if it has one), its random odds are u / (1 - u) with u
from a digest of the row; documents enter in rising order of random odds over
inclusion odds while their words fit in what is still due, and the document
whose size is nearest to the last gap closes it, if that brings the sum nearer.

What the sample takes of a source is said by few figures (``plan``): the last place
in the order that fits, the same for each round past a misfit, and the closing place.
Each document's copies follow from its own size and draw and its source's figures, so
that texts are neither copied nor shuffled.

No task sees a whole source: ranks are dealt into about sqrt(n) even buckets a
source (n rows), whose sums are added up first; rows are then ordered within
their bucket only. What one task holds grows with the square root of a source.
The table of sources is one row each and is joined by key, salted; ``targets`` orders
that table in one task, which is meant for up to a million sources.

Defined results: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own and comes last; rows of equal id, text and source share a draw and
enter together; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.words import fresh, spaced_words
from brindle.plans.shared import Scratch, scratch

#: Weights of the sources in order, repeating; the budget in hundredths of all words; the most copies.
WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
#: Bits of the digest that make the draw, and the seed in the digest.
DRAW_BITS, SEED = 48, "mix-1"


def draw(*columns: Column) -> Column:
    """A uniform number strictly between 0 and 1, the same on each run for the same values."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(SEED), *columns).cast("binary"))
    return (F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))


def size_of(text: str) -> Column:
    """Words of a text."""
    return F.size(spaced_words(F.col(text))).cast("long")


def draw_of(id_col: str, text: str) -> Column:
    """The draw of a document."""
    return draw(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def weigh(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", own_weight: str | None = None) -> DataFrame:
    """One narrow row a document: id, source, size in words, draw; and own, if ``own_weight`` names a positive column that multiplies inclusion odds."""
    own = [] if own_weight is None else [F.col(own_weight).cast("double").alias("own")]
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size_of(text).alias("size"), draw_of(id_col, text).alias("u"), *own)


def targets(weighed: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """One row a source: rows, words, target.

    Sharing, stopping at ``most`` times the words and sharing the excess again
    ends where one level L gives every source min(L * weight, most * words).
    With sources in order of most * words / weight, the capped ones come first:
    L = (budget - caps before) / (weights from here on), at the first source that L
    doesn't bring to its cap.
    """
    sums = weighed.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = (most * F.col("words")).cast("double")
    ranked = sums.select("*", weight.alias("weight"), cap.alias("cap"), (F.sum("words").over(everything) * F.lit(percent) / 100.0).alias("budget"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.select("*", level.alias("level"))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("no_name"), "source", "level"))).over(everything)["level"]
    target = F.when(free.isNull(), F.col("cap")).otherwise(F.least(free * F.col("weight"), F.col("cap")))
    return levels.select("source", "rows", "words", "weight", target.alias("target"))


def _with_source(rows: DataFrame, table: DataFrame, columns: list[str], source: str = "source", u: str = "u") -> DataFrame:
    """Join on the source, null with null. A hot source is dealt over salts, on which its one row is repeated."""
    salts = 32
    salt, of_table, at = fresh(rows, "salt"), fresh(rows, "of_table"), fresh(rows, "at_salt")
    left = rows.withColumn(salt, F.pmod(F.floor(F.col(u) * 2.0**32).cast("long"), F.lit(salts)).cast("int"))
    right = table.select(F.col("source").alias(of_table), *columns).withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, left[source].eqNullSafe(right[of_table]) & (left[salt] == right[at]))
    return joined.drop(salt, at, of_table)


def _reached(rows: DataFrame, of: Column) -> DataFrame:
    """Adds the running sum of ``of`` by place in each source, its own row included: by bucket first, then within buckets."""
    rows = rows.withColumn("of", of)
    sums = rows.groupBy("source", "bucket").agg(F.sum("of").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("words_before"))
    on = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    rows = rows.join(sums, on, "left").drop("of_source", "of_bucket")
    upto = Window.partitionBy("source", "bucket").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("reached", F.col("words_before") + F.sum("of").over(upto)).drop("of", "words_before")


def _place() -> Column:
    return F.struct("rank", "size")


def _rounds(left: DataFrame, tables: Scratch) -> list[DataFrame]:
    """What is taken when the walk goes on past those that don't fit: for each round source, gap, cut, large and took.

    ``left`` has the units that are not taken and no larger than their source's gap. A
    round takes units of up to half the gap by their running sum, until one doesn't fit
    or until one of more than half fits, which is taken too. Less than half of the gap
    stays either way, or no unit that fits, so that rounds are log-many.
    """
    rounds, small = [], 2 * F.col("unit") <= F.col("gap")
    while not left.isEmpty():
        scored = _reached(left.withColumn("small", small), F.when(F.col("small"), F.col("unit")).otherwise(0))
        fits = F.col("reached") + F.when(F.col("small"), 0).otherwise(F.col("unit")) <= F.col("gap")
        scored = tables.write(scored.where(fits), "mix-fits")
        large = scored.groupBy("source").agg(F.min(F.when(~F.col("small"), _place())).alias("large"))
        takes = F.col("large").isNull() | (_place() <= F.col("large"))
        taken = _with_source(scored, large, ["large"]).where(takes)
        cut = F.max(F.when(F.col("small"), _place())).alias("cut")
        now = taken.groupBy("source").agg(F.first("gap").alias("gap"), cut, F.first("large").alias("large"), F.sum("unit").alias("took"))
        now = tables.write(now, "mix-round")
        rounds.append(now)
        rest = _with_source(left, now.select("source", "cut", "large", "took"), ["cut", "large", "took"])
        rest = rest.where(~_in_round(F.col("gap"), F.col("cut"), F.col("large"), F.col("unit"), _place())).withColumn("gap", F.col("gap") - F.col("took"))
        last, left = left, tables.write(rest.where("unit <= gap").select(*left.columns), "mix-left")
        tables.drop(last, scored)
    return rounds


def _in_round(gap: Column, cut: Column, large: Column, unit: Column, place: Column) -> Column:
    """Whether a round takes a unit that no earlier round took."""
    of_small = (2 * unit <= gap) & F.coalesce(place <= cut, F.lit(False))
    return (unit <= gap) & (of_small | F.coalesce(place == large, F.lit(False)))


def _rank(u: Column, p: Column, own: Column) -> Column:
    """Random odds over inclusion odds."""
    return u / (1 - u) / own / (p / (1 - p))


def plan(weighed: DataFrame, tables: Scratch, table: DataFrame | None = None, past_misfits: bool = True) -> tuple[DataFrame, DataFrame]:
    """What decides every document's copies: a row for each source, and the draws that several rows share, with their number.

    ``weighed`` is read several times: write it first. A source's row has words, target, whole, p, and what of the
    fractional sample is taken: the units up to the place ``cut``, those of ``rounds``, and the one at the place ``closing``.
    """
    own = F.col("own") if "own" in weighed.columns else F.lit(1.0)
    units = weighed.select("source", "u", "size", own.alias("own")).groupBy("source", "u", "size", "own").agg(F.count("*").alias("peers"))
    units = tables.write(units.withColumn("unit", F.col("size") * F.col("peers")), "mix-units")
    table = tables.write(targets(units.select("source", F.col("unit").alias("size"))) if table is None else table, "mix-targets")
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    rates = table.select("source", "rows", "words", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
    rates = rates.withColumn("due", F.col("target") - F.col("whole") * F.col("words"))

    rows = _with_source(units.where("size > 0"), rates, ["p", "due", F.ceil(F.sqrt("rows")).alias("buckets")]).where("p > 0")
    # The odds of p are the same in a source: they cancel in the bucket's number, which is the rank's own share of (0, 1).
    odds = F.col("u") / (1 - F.col("u")) / F.col("own")
    bucket = F.least(F.floor(odds / (1 + odds) * F.col("buckets")), F.col("buckets") - 1).cast("long")
    rows = rows.select("source", "u", "size", "unit", "due", _rank(F.col("u"), F.col("p"), F.col("own")).alias("rank"), bucket.alias("bucket"))
    reached = _reached(rows, F.col("unit"))
    drawn = tables.write(reached.withColumn("chosen", F.col("reached") <= F.col("due")).drop("reached"), "mix-drawn")
    firsts = drawn.groupBy("source").agg(
        F.max(F.when(F.col("chosen"), _place())).alias("cut"), (F.max("due") - F.sum(F.when(F.col("chosen"), F.col("unit")).otherwise(0))).alias("gap")
    )
    firsts = tables.write(firsts, "mix-firsts")
    left = _with_source(drawn.where("not chosen"), firsts, ["gap"]).select("source", "u", "size", "unit", "rank", "bucket", "gap")
    gaps, rounds = firsts.select("source", "gap"), None
    if past_misfits:
        for now in _rounds(tables.write(left.where("unit <= gap"), "mix-left"), tables):
            rounds = now if rounds is None else rounds.unionByName(now)
    if rounds is not None:
        rounds = rounds.groupBy("source").agg(F.collect_list(F.struct("gap", "cut", "large")).alias("rounds"), F.sum("took").alias("took"))
        rounds = tables.write(rounds, "mix-rounds").alias("r")
        on = F.col("f.source").eqNullSafe(F.col("r.source"))
        gaps = firsts.alias("f").join(rounds, on, "left").select("f.source", (F.col("gap") - F.coalesce("took", F.lit(0))).alias("gap"), "rounds")
        open_units = _with_source(left.withColumnRenamed("gap", "first_gap"), gaps, ["gap", "rounds"])
        left = open_units.where(~_in_rounds(F.col("unit"), _place()))
    # The place that is nearest to the last gap; ties go to the lower rank.
    near = left.where("unit < 2 * gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("unit")).alias("off"), "rank", "size")).alias("best"))
    near = near.select("source", F.struct("best.rank", "best.size").alias("closing"))
    out = rates.drop("rows", "due")
    for more in (firsts.drop("gap"), near, *([] if rounds is None else [rounds.drop("took")])):
        more = more.withColumnRenamed("source", "of_source")
        out = out.join(more, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    if rounds is None:
        out = out.withColumn("rounds", F.lit(None).cast("array<struct<gap:double,cut:struct<rank:double,size:bigint>,large:struct<rank:double,size:bigint>>>"))
    shared = units.where("peers > 1 and size > 0").select("source", "u", "size", "peers")
    return tables.write(out, "mix-plan"), tables.write(shared, "mix-shared")


def _in_rounds(unit: Column, place: Column, rounds: Column | None = None) -> Column:
    rounds = F.col("rounds") if rounds is None else rounds
    return F.coalesce(F.exists(rounds, lambda r: _in_round(r["gap"], r["cut"], r["large"], unit, place)), F.lit(False))


def take(docs: DataFrame, plan: DataFrame, shared: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with three new columns: the words and the target of the source, and the copies.

    ``columns`` names those that the rows have (source, size, u, and own where documents have weights) and the new ones.
    """
    source, size, u = columns["source"], columns["size"], columns["u"]
    figures, peers = fresh(docs, "figures"), fresh(docs, "peers")
    plan = plan.select("source", F.struct(*[c for c in plan.columns if c != "source"]).alias(figures))
    rows = _with_source(docs, plan, [figures], source, u)
    if shared.isEmpty():
        rows = rows.withColumn(peers, F.lit(1))
    else:
        names = {c: fresh(rows, f"shared_{c}") for c in ("source", "u", "size")}
        ties = shared.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("peers").alias(peers))
        on = rows[source].eqNullSafe(ties[names["source"]]) & (rows[u] == ties[names["u"]]) & (rows[size] == ties[names["size"]])
        rows = rows.join(ties, on, "left").drop(*names.values())
    own = F.col(columns["own"]) if "own" in columns else F.lit(1.0)
    p, of = F.col(figures)["p"], F.col(figures)
    rank = F.when((p > 0) & (F.col(size) > 0), _rank(F.col(u), p, own))
    place = F.struct(rank.alias("rank"), F.col(size).alias("size"))
    unit = F.col(size) * F.coalesce(F.col(peers), F.lit(1))
    sampled = F.coalesce(place <= of["cut"], F.lit(False)) | _in_rounds(unit, place, of["rounds"]) | F.coalesce(place == of["closing"], F.lit(False))
    copies = F.when(F.col(size) > 0, of["whole"] + F.when(rank.isNotNull() & sampled, 1).otherwise(0)).otherwise(0)
    new = {columns["words"]: of["words"], columns["target"]: of["target"], columns["copies"]: copies.cast("long")}
    return rows.withColumns(new).drop(figures, peers)


def mix(weighed: DataFrame, table: DataFrame | None = None, past_misfits: bool = True) -> DataFrame:
    """Copies for each row of ``weigh``: adds words, target and copies. ``table`` has own targets (source, rows, words, target)."""
    columns = {c: c for c in weighed.columns if c != "id"} | {c: c for c in ("words", "target", "copies")}
    with scratch(weighed.sparkSession) as tables:
        weighed = tables.keep(weighed, "mix-rows")
        return take(weighed, *tables.outlive(*plan(weighed, tables, table, past_misfits)), columns)


def mixed(docs: DataFrame, into: str = "mix_copies", words: str = "mix_words", id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, with all their columns, how often each is taken, and its size; equally named columns are replaced."""
    with scratch(docs.sparkSession) as tables:
        made = tables.outlive(*plan(tables.write(weigh(docs, id_col, text, source), "mix-rows"), tables))
    docs = docs.drop(into, words)
    columns = {c: fresh(docs, c) for c in ("u", "target", "words")} | {"source": source, "size": words, "copies": into}
    rows = take(docs.withColumns({words: size_of(text), columns["u"]: draw_of(id_col, text)}), *made, columns)
    return rows.where(F.col(into) > 0).drop(columns["u"], columns["target"], columns["words"])
