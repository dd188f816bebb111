"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule says whether to reject a text, and how many steps that takes. On a sample
of about ``SAMPLE_ROWS`` texts, drawn by a hash over the whole table, every rule's
steps and rejections are counted in one job; the cascade asks the rules in falling
order of rejections per step and stops at the first that rejects. Counted steps, unlike
seconds, give the same order on each run. The order changes the work, never the verdict.

Defined results: a null or empty text has no words and is rejected for it;
repeated rows get equal verdicts; columns of the input other than the text are
neither read nor changed, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import SPACE, let, spaced_words

#: Words in a window that counts as repeated.
WINDOW = 5
#: Texts that costs and rejections are counted on, about.
SAMPLE_ROWS = 4000
#: Steps a word of comparing windows, in steps a character of a regular expression (both as measured on one core: 1.2 us and 0.02 us).
WINDOW_STEPS = 60


def word_chars(words: Column) -> Column:
    """Code points in the words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters that are one of ``# * $ % & | < >``."""
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_upper(text: Column) -> Column:
    """Letters A-Z."""
    return F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACE.replace("[", "[^")))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window found twice or more in the text.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. A text
    without an equal pair of hashes, which is most, ends there; else hashes
    are sorted with their positions, so that the work stays n log n in the words.
    """

    def hashes(h: Column) -> Column:
        start = F.sequence(F.lit(0), F.size(h) - window)
        return F.when(
            F.size(h) >= window,
            F.transform(start, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"] == e["h"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        def union(p: Column) -> Column:
            gain = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gain, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, positions), union)

    return let(
        let(F.transform(words, lambda w: F.xxhash64(w)), hashes),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)),
    ).cast("long")


@dataclass
class Facts:
    """What rules can ask of one text; a figure that is there already is not computed again."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def get(self, name: str) -> Column:
        if name not in self.known:
            make = {
                "n_words": lambda: F.size(self.words).cast("long"),
                "word_chars": lambda: word_chars(self.words),
                "n_symbols": lambda: n_symbols(self.text),
                "n_upper": lambda: n_upper(self.text),
                "n_lines": lambda: F.size(worded_lines(self.text)).cast("long"),
                "n_dup_lines": lambda: let(worded_lines(self.text), n_dup_lines),
                "n_repeat_words": lambda: n_repeat_words(self.words),
            }
            return make[name]()
        return self.known[name]


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for a text to refuse, ``steps`` what it takes to tell, in characters that a regular expression reads."""

    name: str
    reject: Callable[[Facts], Column]
    steps: Callable[[Facts], Column] = lambda f: F.length(f.text)


#: The two base rules.
BASE_RULES = (
    Rule("few_words", lambda f: f.get("n_words") < 10, lambda f: F.lit(1)),
    Rule("repeated_windows", lambda f: 100 * f.get("n_repeat_words") > 20 * f.get("n_words"), lambda f: WINDOW_STEPS * f.get("n_words")),
)
#: What the method adds: symbols over a tenth of the words, capitals over two fifths of the
#: characters, mean word length outside 2 to 15, over half of the lines repeated.
MORE_RULES = (
    Rule("symbols", lambda f: 10 * f.get("n_symbols") > f.get("n_words")),
    Rule("capitals", lambda f: 100 * f.get("n_upper") > 40 * f.get("word_chars")),
    Rule("word_length", lambda f: ~f.get("word_chars").between(2 * f.get("n_words"), 15 * f.get("n_words")), lambda f: f.get("n_words")),
    Rule("repeated_lines", lambda f: 2 * f.get("n_dup_lines") > f.get("n_lines"), lambda f: 2 * F.length(f.text)),
)


@dataclass(frozen=True)
class Profile:
    """One rule on the sample: mean steps beyond splitting into words, and the share rejected."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.cost


def profile(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Profile]:
    """Count each rule's steps and rejections on a sample. A rule that rejects none goes last; an empty table gives any order."""
    total, parts = docs.count(), 1 << 32
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = whole.where(F.pmod(F.xxhash64("t"), F.lit(parts)) < min(parts, parts * rows // max(total, 1)))
    facts = Facts(F.col("t"), F.col("w"))
    figures = [f for n, rule in enumerate(rules) for f in (F.avg(rule.reject(facts).cast("int")).alias(f"r{n}"), F.avg(rule.steps(facts)).alias(f"s{n}"))]
    found = sample.select("t", spaced_words(F.col("t")).alias("w")).agg(F.count("*").alias("n"), *figures).first()
    return [Profile(rule, max(found[f"s{n}"], 1.0), found[f"r{n}"]) if found.n else Profile(rule, 1.0, 0.0) for n, rule in enumerate(rules)]


def ordered(profiles: list[Profile]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; ties: the cheaper, then by name."""
    return tuple(p.rule for p in sorted(profiles, key=lambda p: (-p.gain, p.cost, p.rule.name)))


def cascade(facts: Facts, rules: tuple[Rule, ...]) -> Column:
    """True if no rule rejects. A CASE asks its branches in order and stops at the first that holds."""
    if not rules:
        return F.lit(True)
    chain = F.when(rules[0].reject(facts), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(rule.reject(facts), F.lit(False))
    return chain.otherwise(F.lit(True))


def passes(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The whole cascade on a text column: words are split once, all else only when a rule asks."""
    return let(spaced_words(text), lambda w: cascade(Facts(F.coalesce(text, F.lit("")), w), rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    rules = ordered(profile(docs, BASE_RULES + MORE_RULES, text)) if rules is None else rules
    return docs.where(passes(F.col(text), rules))


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All base figures, the base verdict and the cascade's verdict for each row."""
    more = ordered(profile(docs, MORE_RULES, text))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), whole.alias("t"), spaced_words(F.col(text)).alias("w"))
    facts = Facts(F.col("t"), F.col("w"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = rows.select(F.col(id_col), "t", *[facts.get(n).alias(n) for n in names])
    facts = Facts(F.col("t"), F.lit(None), {n: F.col(n) for n in names})
    failed = BASE_RULES[0].reject(facts) | BASE_RULES[1].reject(facts)
    verdict = F.when(failed, F.lit(False)).otherwise(cascade(facts, more))
    return rows.select(F.col(id_col), *names, failed.alias("base_failed"), verdict.alias("kept"))
