from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tablepulse.llm import chunks
from tests.llm.conftest import docs_of, prose


@pytest.fixture(scope="module")
def rows(messy_rows):
    rng = random.Random(9)
    passages = [prose(rng, 55, 5000) for _ in range(5)]
    planted = [(400 + i, prose(rng, 40 + 7 * i, 5000) + " " + passages[i % 5] + "\n" + prose(rng, 30 + i, 5000)) for i in range(15)]
    clean = [(500 + i, prose(rng, 150, 50_000)) for i in range(20)]
    return [*messy_rows, *planted, *clean]


def words_of(text, a, b):
    return tuple(text.encode()[a:b].split())


def expected(rows, min_words):
    """Passages by comparing the words of all chunks."""
    docs = list({(d, t): None for d, t in rows})
    cut = {i: [(a, b, n, words_of(t or "", a, b)) for a, b, _, n in chunks.chunks((t or "").encode())] for i, (_, t) in enumerate(docs)}
    owners = defaultdict(set)
    for i, its in cut.items():
        for *_, w in its:
            owners[w].add(i)
    found = Counter()
    for i, its in cut.items():
        run = []
        for c in [*its, None]:
            if c and len(owners[c[3]]) > 1:
                run.append(c)
            else:
                if run and sum(n for _, _, n, _ in run) >= min_words:
                    found[docs[i][0], run[0][0], run[-1][1], sum(n for _, _, n, _ in run)] += 1
                run = []
    return found


def test_passages_match_brute_force(spark, rows):
    found = chunks.repeated_passages(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.start, r.end, r.n_words) for r in found) == expected(rows, chunks.MIN_PASSAGE_WORDS)
    ids = {r.doc_id for r in found}
    assert set(range(400, 415)) <= ids and not ids & set(range(500, 520))
    assert {tuple(r.first_ids) for r in found if r.doc_id in (405, 410)} == {(400,)}


def test_documents_that_share_over_fifty_words_are_found(spark, rows):
    """Against all windows of 51 words."""
    owners = defaultdict(set)
    for i, (_, t) in enumerate(docs := list({(d, t): None for d, t in rows})):
        w = (t or "").split()
        for k in range(len(w) - 50):
            owners[tuple(w[k : k + 51])].add(i)
    want = {docs[i][0] for ids in owners.values() if len(ids) > 1 for i in ids}
    found = {r.doc_id for r in chunks.repeated_passages(docs_of(spark, rows)).collect()}
    assert want <= found


def test_passages_of_51_words_are_found_whole(spark):
    """Planted in two texts each, at every alignment with the chunks."""
    rng = random.Random(11)
    rows, want = [], Counter()
    for i in range(120):
        passage = prose(rng, 51, 50_000)
        for d in (i, 1000 + i):
            before = prose(rng, 20 + rng.randrange(40), 50_000)
            rows.append((d, f"{before} x{d} {passage} y{d} " + prose(rng, 30, 50_000)))
            a = len(before) + len(f" x{d} ")
            want[d, a, a + len(passage), 51, d == i] += 1
    found = chunks.whole_passages(docs_of(spark, rows)).collect()
    got = Counter((r.doc_id, r.start, r.end, r.n_words, r.is_first) for r in found)
    assert not got - want
    assert (want - got).total() <= 2  # passages in which the chunks of both texts never fall into step


def test_the_first_occurrence_stays(spark, rows):
    table = docs_of(spark, rows)
    left = chunks.without_repeats(table)
    assert left.columns == table.columns
    after = Counter((r.doc_id, len(r.text or "")) for r in left.collect())
    before = Counter((d, len(t or "")) for d, t in rows)
    assert after.total() == before.total()
    assert all(after[400 + i, len(rows_text)] == 1 for i, rows_text in ((d - 400, t) for d, t in rows if d in range(400, 405)))
    shorter = dict(after.keys())
    assert all(shorter[d] < len(t) - 150 for d, t in rows if d in range(405, 415))


def test_no_text_is_lost(spark):
    """A third text whose chunks first occur in two others leaves each of its words in one of them."""
    text = prose(random.Random(21), 400, 50_000).split()
    parts = [(1, text[:200]), (2, text), (3, text[150:])]
    left = {r.doc_id: r.text.split() for r in chunks.without_repeats(docs_of(spark, [(d, " ".join(w)) for d, w in parts])).collect()}
    assert left[1] == text[:200] and set(text) <= {w for words in left.values() for w in words}
    assert sum(map(len, left.values())) < 500


def test_every_word_of_a_shared_chunk_survives_somewhere(spark):
    rng = random.Random(22)
    passages = [prose(rng, 120, 50_000).split() for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(80)
            words += p[a : a + rng.randrange(20, 120)] + prose(rng, rng.randrange(12), 50_000).split()
        rows.append((d * 7 % 60, " ".join(words)))
    left = " ".join(r.text for r in chunks.without_repeats(docs_of(spark, rows)).collect())
    before, after = Counter(" ".join(t for _, t in rows).split()), Counter(left.split())
    assert set(after) == set(before), "no word is gone everywhere"
    shared = {w for p in passages for w in p}
    assert sum(after[w] for w in shared) < 0.6 * sum(before[w] for w in shared)


def test_chunks_cover_every_word_and_follow_insertions():
    rng = random.Random(4)
    text = prose(rng, 3000, 9000)
    cut = [words_of(text, a, b) for a, b, _, _ in chunks.chunks(text.encode())]
    assert [w for c in cut for w in c] == text.encode().split()
    assert all(len(c) <= chunks.MAX_WORDS for c in cut) and all(len(c) >= chunks.MIN_WORDS for c in cut[:-1])
    moved = "some words in front " + text
    again = {words_of(moved, a, b) for a, b, _, _ in chunks.chunks(moved.encode())}
    assert sum(c not in again for c in cut) <= 4


def test_rolling_hash_depends_on_32_bytes_and_not_on_pieces(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = chunks.gear_hashes(data)
    for i in (31, 100, 4999):
        h = 0
        for byte in data[: i + 1]:
            h = (h * 2 + int(chunks.GEAR[byte])) % (1 << 32)
        assert h == whole[i]
    text = prose(random.Random(2), 3000).encode()
    once = list(chunks.chunks(text))
    monkeypatch.setattr(chunks, "PIECE_BYTES", 777)
    assert list(chunks.chunks(text)) == once


@pytest.fixture()
def written(spark, monkeypatch):
    """What ``chunks`` writes to the shared folder, and the plans of it as for tables far above the broadcast threshold."""
    found, cut, threshold = {}, chunks.cut, "spark.sql.autoBroadcastJoinThreshold"

    def noted(df, purpose):
        found[purpose] = plan_of(df), (after := cut(df, purpose)).count()
        return after

    monkeypatch.setattr(chunks, "cut", noted)
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    yield found
    spark.conf.set(threshold, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def children_of_joins(plan):
    """The operators that each join in a plan reads, below its sorts."""
    lines = [(len(m[1]), m[2]) for line in plan.splitlines() if (m := re.match(r"([\s:+\-]*)(\w+)", line)) and m[2] != "Sort"]
    for i, (depth, name) in enumerate(lines):
        if name == "SortMergeJoin":
            below = [x for x in lines[i + 1 : next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), None)]]
            first = min(d for d, _ in below)
            yield sorted(n for d, n in below if d == first)


def test_the_table_of_all_chunks_is_not_stored(spark, rows, written):
    """Of mostly unique texts little is written, and the joins with counts of digests read shuffles that can be split."""
    found = chunks.shared_chunks(docs_of(spark, rows))
    n = chunks.chunk_table(docs_of(spark, rows)).count()
    assert set(written) == {"likely-chunks"} and found.count() <= written["likely-chunks"][1] < 0.6 * n
    for plan in (written["likely-chunks"][0], plan_of(found)):
        assert list(children_of_joins(plan)) == [["Exchange", "Exchange"]]


def test_texts_and_their_edges_meet_in_one_shuffle(spark, rows, written):
    chunks.whole_passages(docs_of(spark, rows))
    plan = written["edges"][0]
    assert "Exchange" not in plan.split("SortMergeJoin")[0], "copies of a row are dropped where its text meets its edges"
    runs = written["candidate-passages"][0]
    assert runs.split("SortMergeJoin")[0].count("Exchange hashpartitioning") == 1, "chunks are dealt to their documents once"


def test_rows_that_are_there_twice_change_nothing(spark, rows):
    once = list(dict.fromkeys(rows))
    found = [sorted(map(repr, chunks.whole_passages(docs_of(spark, r)).collect())) for r in (once, once + once)]
    assert found[0] == found[1] != []


def test_packed_places_of_the_largest_texts(spark):
    top = (1 << 31) - 1
    places = [(i, 7, number, start, end, is_last, n, -1, -(1 << 63)) for i, (number, start, end, is_last, n) in enumerate([
        (0, 0, 1, False, 1), (top // 4, top - 9, top, True, chunks.MAX_WORDS), (3, 0, top, False, 3), (top, 1, top - 1, True, chunks.MIN_WORDS),
    ])]
    table = spark.createDataFrame([*places, (None, *places[1][1:])], chunks.CHUNK)
    after = chunks._loose(chunks._tight(table))
    assert after.dtypes == table.dtypes and Counter(after.collect()) == Counter(table.collect())


def test_digests_do_not_see_white_space(spark):
    texts = ["\x0ba \t b\x0c\r\nc ", "a b c", "", None, " \n"]
    found = chunks.chunk_table(docs_of(spark, list(enumerate(texts)))).collect()
    whole = xxhash.xxh3_128_digest(b"a b c")
    want = [int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)]
    assert sorted((r.doc_id, r.start, r.end, r.n_words) for r in found) == [(0, 1, 10, 3), (1, 0, 5, 3)]
    assert [[r.high, r.low] for r in found] == [want, want]


def test_empty_table(spark):
    assert chunks.repeated_passages(docs_of(spark, [])).collect() == []
    assert chunks.without_repeats(docs_of(spark, [])).collect() == []
