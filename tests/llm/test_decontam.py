from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from tablepulse.llm import decontam
from tests.llm.conftest import docs_of, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[i : i + size]) in windows and i + size <= len(w):
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        names = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        rows.append((doc, len(w), len(hit), len(names), digest, 0 < len(hit) and 20 * len(hit) >= len(w)))
    return rows


@pytest.fixture(scope="module")
def case(messy_rows):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 12, 5, 1, 60, 3))]
    items += [(7, None), (8, ""), (9, "?!"), (None, prose(rng, 20)), (0, items[0][1]), (10, "the the " * 10), (11, items[0][1])]
    first, short = words(items[0][1]), words(items[3][1])
    docs = [
        *messy_rows,
        (200, prose(rng, 30) + " " + " ".join(first) + ". " + prose(rng, 10)),
        (201, prose(rng, 50) + "\n" + "; ".join(first[5:18]).upper() + "! " + prose(rng, 30)),
        (202, " ".join(first[5:17]) + " gap " + " ".join(first[17:29])),  # 12 in a row only
        (203, " ".join(short)), (204, " ".join(short[:4])), (205, items[1][1] + " " + items[1][1]),
        (206, prose(rng, 900) + " " + " ".join(first[:13]) + " " + prose(rng, 900)), (207, "the " * 100), (208, items[10][1]),
        (209, " ".join(reversed(first[:13]))), (210, " ".join(first[:20])), (210, " ".join(first[:20])),
    ]
    return docs, items


def test_hits_match_brute_force(spark, case):
    docs, items = case
    table = docs_of(spark, docs)
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, item string, term string")
    found = decontam.contamination(table, bench).drop("text_hash")
    want = expected(docs, items)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    kept = decontam.keep_clean(table, bench)
    assert kept.schema == table.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want if not r[-1])


def test_blocks_of_the_test_set_change_nothing(spark, case, monkeypatch):
    docs, items = case
    table = docs_of(spark, docs[-12:])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "blocks", lambda b, whole=decontam.blocks: whole(b, 400))
    found = decontam.contamination(table, bench).drop("text_hash")
    assert Counter(map(tuple, found.collect())) == Counter(expected(docs[-12:], items))


def test_empty_tables(spark):
    bench = "item_id long, text string"
    assert decontam.contamination(docs_of(spark, []), spark.createDataFrame([(1, "a b")], bench)).collect() == []
    row = decontam.contamination(docs_of(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], bench)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in row} == {(1, 2, 0, False), (2, 0, 0, False)}


def test_proximity_finds_any_order(spark, case):
    docs, items = case
    bench = spark.createDataFrame(items[:2], "item_id long, text string")
    span = 16
    windows = [(str(i), s, set(words(t)[s : s + 13])) for i, t in items[:2] for s in range(max(1, len(words(t)) - 12))]
    chosen = docs[-12:]
    found = decontam.proximity_matches(docs_of(spark, chosen), bench, span).select("doc_id", "item_id", "start").distinct()
    counts = Counter(w for _, t in chosen for w in words(t))
    vocabulary = sorted({w for _, _, ws in windows for w in ws})
    want = set()
    for doc, text in chosen:
        w = words(text)
        for item, start, terms in windows:
            rare = min(terms, key=lambda t: (counts[t], vocabulary.index(t)))
            for p in (i for i, x in enumerate(w) if x == rare):
                if terms <= set(w[max(0, p - span) : p + span + 1]):
                    want.add((doc, item, start))
    assert set(map(tuple, found.collect())) == want and any(d == 209 for d, _, _ in want)
