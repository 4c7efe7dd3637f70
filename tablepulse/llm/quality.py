"""Quality rules as a short-circuit cascade.

Every rule is a predicate over the text and its words that says *reject*. On a bounded sample each rule is
run alone to measure its cost, and all rules are evaluated together to see which rows each rejects. Rules are
then ordered greedily by rejected rows per second among the rows that the rules before them let pass, and the
cascade is one CASE expression: a later rule is only evaluated where all earlier ones passed. The sample
decides the order, hence the speed, and never the verdict: a document is kept iff no rule rejects it.

NULL and empty texts have no words and are rejected by the word-count rule. Repeated rows get the same
verdict each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, let, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MAX_DUPLICATE_LINE_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_UPPER_PERCENT = 40
MIN_LETTER_WORD_PERCENT = 70
MEAN_WORD_CHARS = (2, 15)
SAMPLE_ROWS = 512
SAMPLE_CHARS = 20_000


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included.

    Windows are told apart by a 64-bit hash. Most texts repeat none, which a hash set shows; only the others
    sort their windows to find the repeated ones and add up the words these cover.
    """
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda first, i: F.xxhash64(first, *(F.get(w, i + k) for k in range(1, WINDOW))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twins = F.filter(
                s,
                lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]),
            )
            return F.sort_array(F.transform(twins, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(ranked, positions), total)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return counted.cast("long")


@dataclass(frozen=True)
class Rule:
    """``reject(text, words)`` is true for rows to drop; it must be false, not NULL, for the others."""

    name: str
    reject: Callable[[Column, Column], Column]


def _too_few_words(text: Column, w: Column) -> Column:
    return F.size(w) < MIN_WORDS


def _repeated_windows(text: Column, w: Column) -> Column:
    return n_repeat_words(w) * 100 > F.size(w) * MAX_REPEATED_PERCENT


def _duplicate_lines(text: Column, w: Column) -> Column:
    return let(worded_lines(text), lambda ls: n_dup_lines(ls) * 100 > F.size(ls) * MAX_DUPLICATE_LINE_PERCENT)


def _symbols(text: Column, w: Column) -> Column:
    return n_symbols(text) * 100 > F.size(w) * MAX_SYMBOL_PERCENT


def _upper_case(text: Column, w: Column) -> Column:
    rest = F.length(F.regexp_replace(text, "\\p{Lu}+", ""))
    return (F.length(text) - rest) * 100 > F.length(text) * MAX_UPPER_PERCENT


def _letterless_words(text: Column, w: Column) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) * 100 < F.size(w) * MIN_LETTER_WORD_PERCENT


def _word_length(text: Column, w: Column) -> Column:
    low, high = MEAN_WORD_CHARS
    return let(word_chars(w), lambda n: (n < F.size(w) * low) | (n > F.size(w) * high))


BASE_RULES = (Rule("too_few_words", _too_few_words), Rule("repeated_windows", _repeated_windows))
OTHER_RULES = (
    Rule("duplicate_lines", _duplicate_lines),
    Rule("symbols", _symbols),
    Rule("upper_case", _upper_case),
    Rule("letterless_words", _letterless_words),
    Rule("word_length", _word_length),
)
RULES = BASE_RULES + OTHER_RULES


@dataclass(frozen=True)
class Estimate:
    """Of one rule, at its place in the cascade: seconds for the sample, and the share of arriving rows it rejects."""

    rule: Rule
    seconds: float
    rejected: float


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of rejection per cost, measured on up to ``sample_rows`` rows.

    The rows are those that come first to hand, so that sampling reads a few files and not the table. Texts of over
    ``SAMPLE_CHARS`` characters are not taken into the sample, whose size is thus bounded; they are judged like any others.
    """
    text, w = F.col("text"), F.col("words")
    first = docs.where(F.length(text) <= SAMPLE_CHARS).select(text).limit(sample_rows).collect()
    taken = docs.sparkSession.createDataFrame(first, "text string")
    sample = cut(taken.select(text, words(text).alias("words")), "quality-sample")

    def seconds(condition: Column) -> float:
        """Best of three runs; the first also compiles the code."""
        job = sample.agg(F.count_if(condition | (F.size(w) < 0)))
        return min(_timed(job.collect) for _ in range(3))

    nothing = seconds(F.length(text) < 0)
    cost = {r.name: max(seconds(r.reject(text, w)) - nothing, 1e-3) for r in rules}
    flags = [r.reject(text, w).alias(f"r{i}") for i, r in enumerate(rules)]
    patterns = sample.groupBy(*flags).agg(F.count(F.lit(1)).alias("n")).collect()  # at most sample_rows rows
    left, order = list(range(len(rules))), []
    while left:
        arriving = sum(p["n"] for p in patterns) or 1
        share = {i: sum(p["n"] for p in patterns if p[f"r{i}"]) / arriving for i in left}
        best = max(left, key=lambda i: (share[i] / cost[rules[i].name], -cost[rules[i].name]))
        order.append(Estimate(rules[best], cost[rules[best].name], share[best]))
        patterns = [p for p in patterns if not p[f"r{best}"]]
        left.remove(best)
    return order


def _timed(job: Callable[[], object]) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cascade(rules: Sequence[Rule], text: Column, w: Column) -> Column:
    """The name of the first rule that rejects, NULL if none does; rules after it are not evaluated."""
    first, *rest = rules
    return reduce(lambda case, r: case.when(r.reject(text, w), r.name), rest, F.when(first.reject(text, w), first.name))


def rejected_by(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> Column:
    """The cascade over the column ``text``, with the order measured on ``docs``."""
    order = [e.rule for e in estimate(docs, rules, sample_rows)]
    return let(words(F.col("text")), lambda w: cascade(order, _known(F.col("text")), w))


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, rejected_by`` for every row: the rule of the cascade that rejected it, or NULL."""
    return docs.select("doc_id", rejected_by(docs, rules, sample_rows).alias("rejected_by"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    return docs.where(rejected_by(docs, rules, sample_rows).isNull())


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts of the base rules, whether these failed, and whether the whole cascade kept the row."""
    order = [e.rule for e in estimate(docs, OTHER_RULES, sample_rows)]
    text = _known(F.col("text"))

    def judged(w: Column) -> Column:
        def verdict(repeated: Column) -> Column:
            n = F.size(w).cast("long")
            failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEATED_PERCENT)
            return F.struct(
                n.alias("n_words"),
                word_chars(w).alias("word_chars"),
                n_symbols(text).alias("n_symbols"),
                let(worded_lines(text), n_dup_lines).alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                failed.alias("base_failed"),
                F.when(failed, F.lit(False)).otherwise(cascade(order, text, w).isNull()).alias("kept"),
            )

        return let(n_repeat_words(w), verdict)

    return docs.select("doc_id", let(words(F.col("text")), judged).alias("report")).select("doc_id", "report.*")
