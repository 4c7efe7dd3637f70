from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablepulse.llm import suffixes
from tests.llm.conftest import docs_of, prose

N = suffixes.LENGTH


def expected(rows):
    """Rows in order of ``doc_id``, each window looked up among those before it; equal rows are one document."""
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, set()).add(text)
    seen, found = set(), {}
    for doc in sorted(texts, key=lambda d: (d is not None, d or 0)):
        assert len(texts[doc]) == 1
        data = (next(iter(texts[doc])) or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - N + 1):
            window = data[i : i + N]
            if window in seen:
                gone[i : i + N] = b"\1" * N
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        found[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return Counter((doc, *found[doc]) for doc, _ in rows)


def check(spark, rows, **options):
    found = suffixes.without_repeats(docs_of(spark, rows), **options)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()) == expected(rows)


def planted(rng):
    passages = [prose(rng, n) for n in (16, 20, 40, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(90, 400)], prose(rng, rng.randrange(3))]
        rows.append((i * 13 % 61, rng.choice(["", " "]).join(parts)))
    copy = rows[5][1]
    near = copy[: len(copy) // 2] + "!" + copy[len(copy) // 2 :]
    rows += [(100, copy), (101, near), (102, near + near), (103, "a" * 700), (104, "ab" * 300 + "a"), (105, "x" * 99), (106, "y" * 100), (107, "y" * 101)]
    rows += [(108, "é🙂" * 90), (109, "🙂é" * 90), (None, copy), (-4, near), (110, None), (111, ""), (100, copy), (100, copy), (112, "\0" * 150)]
    return rows


def test_matches_brute_force(spark):
    check(spark, planted(random.Random(9)))


def test_wide_anchors_are_settled_window_by_window(spark):
    check(spark, planted(random.Random(10)), wide_bytes=300)


def test_messy_rows(spark, messy_rows):
    rows = [(-1000 - i if d is None and t is None else d, t) for i, (d, t) in enumerate(messy_rows)]
    check(spark, rows)


def test_small_pieces_shards_and_merges(spark, monkeypatch):
    for name, value in (("PIECE_BYTES", 700), ("PIECE", 16), ("SHARD_BYTES", 900), ("MERGE_BYTES", 5000)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(11)
    check(spark, planted(rng) + [(200, prose(rng, 900)), (201, "z" * 5000)])


def test_two_texts_of_one_id(spark):
    """They are two documents, in a fixed order: the passage stays in one of them."""
    rng = random.Random(12)
    p = prose(rng, 60)
    found = suffixes.without_repeats(docs_of(spark, [(1, p + " one"), (1, "two " + p)])).collect()
    assert sorted(r.n_removed for r in found) == [0, len(p)] or sorted(r.n_removed for r in found) == [0, len(p) + 1]


def test_empty_table(spark):
    assert suffixes.without_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_merged_order_and_repeated_intervals(seed):
    """The suffixes left are those whose first bytes occur twice, in order, and blocks are the groups of equal ones."""
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(20)] + [b"abab" * 8] * 3
    for rounds in (1, 3, 15, 40):
        shards = [strings[:7], strings[7:8], strings[8:]]
        suffixes_, transforms = [], []
        for shard in shards:
            data = np.frombuffer(b"".join(s + b"\xff" for s in shard), np.uint8)
            order, transform = suffixes.shard_transform(data, np.array([len(s) + 1 for s in shard]))
            own = [s[i:] for s in shard for i in range(len(s) + 1)]
            assert [own[i] for i in order] == sorted(own)
            suffixes_ += [own[i] for i in order]
            transforms.append(transform)
        places, blocks = suffixes.merge(transforms, rounds)
        merged = [suffixes_[i][:rounds] for i in places]
        heads = Counter(s[i : i + rounds] for s in strings for i in range(len(s) - rounds + 1))
        assert merged == sorted(h for h, n in heads.items() if n > 1 for _ in range(n))
        assert len(set(places.tolist())) == len(places)
        for i in range(1, len(merged)):
            assert (merged[i] == merged[i - 1]) == (blocks[i] == blocks[i - 1])
