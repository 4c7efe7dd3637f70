from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from tablepulse.llm import packing
from tests.llm.conftest import docs_of


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_bounds_have_the_least_padding():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 30) for _ in lengths]
        k = rng.randrange(1, 5)
        bounds, wasted = packing.best_bounds(np.array(lengths), np.array(counts), k)
        best = min(
            padding((*c, lengths[-1]), lengths, counts)
            for size in range(min(k, len(lengths)))
            for c in combinations(lengths[:-1], size)
        )
        assert wasted == padding(bounds, lengths, counts) == best
        assert len(bounds) <= k and bounds == sorted(set(bounds))


def test_pieces_and_batches_hold_every_token_once(messy, messy_rows):
    found = packing.pack(messy, max_length=50, n_buckets=4, batch_tokens=200, shard_rows=7).collect()
    sizes = Counter()
    for r in found:
        sizes[r.doc_id] += r.length
    want = Counter()
    for doc, text in messy_rows:
        want[doc] += len((text or "").replace("\x0b", " ").split())
    assert sizes == +want
    bounds = sorted({r.bucket for r in found})
    assert len(bounds) <= 4
    assert all(r.bucket == min(b for b in bounds if b >= r.length) and r.start == 50 * r.piece for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), used in slots.items():
        full = 200 // bucket
        assert sorted(used) == list(range(len(used))) and len(used) <= full
        assert len(used) == full or (bucket, batch + 1) not in slots


def test_bucket_bounds_of_a_table_are_optimal(messy):
    cut = packing.pieces(messy, packing.F.size(packing.words(packing.F.col("text"))), 60)
    lengths = Counter(r.length for r in cut.collect())
    histogram = sorted(lengths.items())
    want = packing.best_bounds(np.array([x for x, _ in histogram]), np.array([c for _, c in histogram]), 3)[0]
    assert packing.buckets(cut, 3) == want


def test_tables_without_tokens(spark):
    assert packing.pack(docs_of(spark, [])).collect() == []
    assert packing.pack(docs_of(spark, [(1, None), (2, ""), (3, " \n")])).collect() == []
