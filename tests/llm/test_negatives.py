from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tablepulse.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, a string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def expected(rows):
    kept = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        flipped = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, flipped, [math.floor(256 * c) for c in x]))
    found = []
    for i, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), other is None, other or 0, other, own == label)
            for j, (other, own, w) in enumerate(kept)
            if j != i and len(w) == len(v)
        ]
        scored.sort(key=lambda s: s[:3])
        for positive in [s for s in scored if s[4]][:5]:
            p = -positive[0]
            window = [s for s in scored if not s[4] and 50 * p <= 100 * -s[0] <= 95 * p][:3]
            found += [(anchor, positive[3], rank, s[3], p, -s[0]) for rank, s in enumerate(window, 1)]
    return found


def check(spark, rows):
    found = negatives.hard_negatives(table(spark, rows))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == Counter(expected(rows))
    return found


def vectors(rng, n, dim=6, steps=64):
    return [(i, [rng.randrange(-steps // 4, steps) / steps for _ in range(dim)], rng.randrange(4)) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "SCORES_AT_ONCE", 200)


def test_blocks_and_slots_match_brute_force(spark, small_blocks):
    rng = random.Random(3)
    check(spark, vectors(rng, 420))
    check(spark, vectors(rng, 260, dim=2, steps=6))  # nearly all scores are ties


def test_dirty_rows(spark, small_blocks):
    rng = random.Random(4)
    rows = vectors(rng, 230)
    rows += [(50, None, 1), (100, [0.5] * 6, None), (150, [0.5, None] + [0.5] * 4, 1), (200, [float("nan")] + [0.1] * 5, 1), (201, [float("inf")] * 6, 2)]
    rows += [rows[50], rows[50], rows[61], (None, [0.5] * 6, 1), (None, [0.4] * 6, 2), (-50, [0.3] * 6, 1), (-49, [0.2] * 6, 3)]
    rows += [(300, [], 1), (301, [], 1), (302, [], 2), (350, [0.5] * 3, 1), (351, [0.5] * 3, 1), (352, [0.4] * 3, 2)]
    check(spark, rows)


def test_large_components(spark):
    rows = [(0, [1e9, -3.5], 1), (1, [9e8, 2.0], 1), (2, [6e8, 1.0], 2), (3, [7e8, 1.0], 2), (4, [1e-20, -1e-20], 2)]
    check(spark, rows)
    top = (1 << 63) - 1
    found = negatives.hard_negatives(table(spark, [(0, [1e30], 1), (1, [2e30], 1), (2, [1e30], 2)])).collect()
    assert found == []  # both scores stop at the largest number, which is above 95 % of itself
    assert negatives.scores(*(2 * [negatives.np.array([[2.0**80]])]))[0, 0] == top


def test_empty_tables(spark):
    assert check(spark, []).count() == 0
    assert check(spark, [(50, [1.0], 1)]).count() == 0


def test_every_pair_is_scored_once(spark, small_blocks, monkeypatch, tmp_path):
    """Positives need the pairs of one label and negatives the others."""
    real, path = negatives.scores, str(tmp_path / "pairs")

    def counted(a, b, *more):
        with open(path, "a") as out:
            out.write(f"{len(a) * len(b)}\n")
        return real(a, b, *more)

    monkeypatch.setattr(negatives, "scores", counted)
    rng = random.Random(7)
    rows = [(i, [rng.randrange(1, 64) / 64 for _ in range(6)], i % 4) for i in range(500)]
    assert len(expected(rows)) == negatives.hard_negatives(table(spark, rows)).count() > 0
    with open(path) as pairs:
        assert sum(map(int, pairs)) == 10 * 500


def test_grid_of_groups(spark, monkeypatch):
    for name, value in {"ANCHOR_BYTES": 1600, "TASK_PAIRS": 400, "BLOCK_ROWS": 30, "SCORES_AT_ONCE": 600, "_FIRST_ROWS": 8, "_MERGED_AT_ONCE": 5}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(8)
    rows = vectors(rng, 300, dim=2, steps=6) + [(i, x, rng.randrange(50)) for i, x, _ in vectors(rng, 300)]
    blocks = negatives.cut(negatives.usable(table(spark, rows)).mapInArrow(negatives._packed, negatives._BLOCK), "blocks")
    assert min(negatives._grid(blocks)) > 1
    check(spark, rows)


def test_products_of_any_size(spark):
    """Floats of 32 bits, of 64 bits and whole numbers meet in one table."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(1, 1 << 12) * 2.0 ** rng.choice((-12, -8, 0, 8)) for _ in range(6)], rng.randrange(3)) for i in range(200)]
    check(spark, rows)
