from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from tablepulse.llm import merkle
from tests.llm.conftest import CLASHING, DOCS

FIELDS = "doc_id, text, lang, source, n_chars"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc, _, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def tree(digests):
    """The last digest, and for every leaf the (left, right) siblings from the bottom up, by plain recursion over runs of eight."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
    top, above = tree([sha(*run) for run in runs])
    own = [("".join(run[:j]), "".join(run[j + 1 :])) for run in runs for j in range(len(run))]
    return top, [[step, *above[i // 8]] for i, step in enumerate(own)]


def expected(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for members in by_lang.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {lang: tree([leaf(r, r[1]) for r in by_lang[lang]]) for lang in langs}
    root, paths = tree([trees[lang][0] for lang in langs]) if langs else (None, [])
    found = []
    for lang, upper in zip(langs, paths, strict=True):
        subroot, lower = trees[lang]
        for row, path in zip(by_lang[lang], lower, strict=True):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for left, right in path + upper:
                folded = sha(left, folded, right)
            proof = sha(*(left + right for left, right in path + upper))
            found.append((row[0], leaf(row, row[1]), subroot, root, proof, folded, folded == root))
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], DOCS.replace("leaf string", "digest string"))


def check(spark, rows):
    found = merkle.manifest(table(spark, rows))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == Counter(expected(rows))


def test_messy_rows(spark, messy_rows):
    langs = ["en", None, "", "de", "é", "EN"]
    rows = [(d, t, langs[i % 6 if i % 3 else 0], None if i % 5 == 0 else "s", None if i % 7 == 0 else i) for i, (d, t) in enumerate(messy_rows)]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 73])
def test_sizes_of_trees(spark, n):
    check(spark, [(i * 37 % 101 - 50, f"Text {i}", "en", "s", i) for i in range(n)])


def test_many_languages_and_repeated_rows(spark):
    rows = [(i % 40, "Same", f"l{i % 11:02}", "s", 4) for i in range(200)] + [(7, "Again", None, None, None)] * 30
    check(spark, rows)


def test_a_large_language_is_ranked_in_many_tasks(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS tree", "id", "CAST('x' AS BINARY) AS digest")
    found = merkle.ranked(rows, "id").collect()
    for name, want in (("a", range(0, 5000, 3)), ("b", [i for i in range(5000) if i % 3])):
        mine = sorted((r.id, r.lo, r.n) for r in found if r.tree == name)
        assert mine == [(i, place, len(want)) for place, i in enumerate(want)]
