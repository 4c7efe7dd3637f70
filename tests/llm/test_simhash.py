from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash

from tablepulse.llm import simhash
from tablepulse.llm.components import components
from tests.llm.conftest import docs_of


def expected_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def expected_classes(rows):
    prints = [expected_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return [(doc, f"{prints[i]:016x}", smallest.get(find(i))) for i, (doc, _) in enumerate(rows)]


def test_classes_match_brute_force(messy, messy_rows):
    assert Counter(map(tuple, simhash.near_duplicates(messy).collect())) == Counter(expected_classes(messy_rows))


def test_one_row_of_every_class_stays(messy, messy_rows):
    kept = simhash.keep_one(messy)
    assert kept.schema == messy.schema
    groups = {c for _, _, c in expected_classes(messy_rows)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(groups)


def test_codes_are_perfect():
    assert sum(b.n for b in simhash.CODE) == simhash.BITS
    for block in set(simhash.CODE):
        nearest = simhash.offsets(block, 0)[0]
        assert nearest.shape == (1 << block.check_bits, 1) and (nearest >= 0).all()


def test_linked_prints_meet_where_one_is_marked():
    rng = np.random.default_rng(3)
    anchors = simhash.Anchors(2)
    for flips in (0, 1, 2, 3) * 40:
        x = rng.integers(0, 1 << 64, dtype=np.uint64)
        y = x
        for bit in rng.choice(64, flips, replace=False):
            y ^= np.uint64(1 << int(bit))
        row, anchor, excess = anchors.of(np.array([x, y], np.uint64))
        one, two = (dict(zip(anchor[row == i].tolist(), excess[row == i].tolist(), strict=True)) for i in (0, 1))
        assert any(min(one[a], two[a]) <= 1 for a in one.keys() & two.keys())


def test_forest_spans_dense_groups_with_few_edges():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 64, dtype=np.uint64)
    group = np.unique(np.array([centre ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)], np.uint64))
    edges = simhash.forest(group)
    reached = {group[0].item()} | {x for e in edges for x in e}
    assert reached == set(group.tolist()) and len(edges) == len(group) - 1
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    names = rng.sample(range(-1000, 1000), 300)
    edges = list(zip(names[:99], names[1:100], strict=True))  # a chain
    edges += [(names[100], x) for x in names[101:200]] + [(x, x) for x in names[200:210]] + edges[:5]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(names[:100]) for x in names[:100]} | {x: min(names[100:200]) for x in names[100:200]}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    assert simhash.keep_one(docs_of(spark, [])).collect() == []
