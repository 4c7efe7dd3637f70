from __future__ import annotations

import re
from collections import Counter

from tablepulse.llm import quality
from tests.llm.conftest import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    n, upper = len(words), len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    failed = n < 10 or 100 * len(covered) > 20 * n
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    duplicates = len(lines) - len(set(lines))
    others = (
        100 * duplicates > 30 * len(lines), 100 * symbols > 10 * n, 100 * upper > 40 * len(text),
        100 * sum(any(c.isalpha() for c in w) for w in words) < 70 * n, chars < 2 * n or chars > 15 * n,
    )
    return n, chars, symbols, duplicates, len(covered), failed, not failed and not any(others)


def test_counts_and_verdicts_match_brute_force(messy, messy_rows):
    found = quality.quality_report(messy).collect()
    assert Counter(map(tuple, found)) == Counter((i, *expected(t)) for i, t in messy_rows)


def test_the_order_of_rules_does_not_change_the_verdict(messy):
    def kept(rules):
        text = quality.F.coalesce("text", quality.F.lit(""))
        by = quality.let(quality.words(messy.text), lambda w: quality.cascade(rules, text, w))
        return Counter((r.doc_id, r.by is None) for r in messy.select("doc_id", by.alias("by")).collect())

    assert kept(quality.RULES) == kept(quality.RULES[::-1])
    assert Counter((r.doc_id, r.rejected_by is None) for r in quality.quality_cascade(messy).collect()) == kept(quality.RULES)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    def never(text, w):
        return quality.F.length(text) < 0

    def short(text, w):
        return quality.F.size(w) < 3

    rules = (quality.Rule("never", never), quality.Rule("short", short))
    order = quality.estimate(docs_of(spark, [(i, "a b") for i in range(50)]), rules)
    assert [e.rule.name for e in order] == ["short", "never"]
    assert [e.rejected for e in order] == [1.0, 0.0]


def test_kept_rows_keep_their_columns(spark, messy, messy_rows):
    kept = quality.keep_good(messy)
    assert kept.schema == messy.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in messy_rows if expected(t)[-1])


def test_empty_table(spark):
    assert quality.quality_report(docs_of(spark, [])).collect() == []
    assert quality.keep_good(docs_of(spark, [])).collect() == []


def test_no_python_in_the_plan(messy):
    plan = quality.quality_report(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
