"""Benchmark decontamination over a distributed positional inverted index.

The test set is taken in blocks of bounded size; every block meets all training rows.

1. Term statistics: how often every term of the block occurs in the training texts.
2. The index: postings (document, term, position) of the terms that the block's windows open first, which are the
   rarest few of each 13-word window, written to the shared folder.
3. Intersection: every list is shifted by its term's offset in the item. An occurrence of a window has the same shift
   in all its lists, so only alignments (document, item, shift) that collect enough of them go on.
4. For the documents of those alignments the lists of all other terms are opened as well and intersected at the shift.
   Runs of 13 matching terms are occurrences; an item with fewer words must match as a whole.

Nothing but the block's terms and their counts reaches the driver. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z. NULL and empty texts have no words: they are never hit, and such items match nothing. An item
without an id can hit words but is not listed. Repeated rows get the same result each; repeated items count once. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, same_row, text_hash

WINDOW = 13
OPENED_FIRST = 3
BLOCK_CHARS = 8_000_000
MIN_HIT_SHARE = 20  # contaminated if at least one word in so many is hit
PIECE_BYTES = 1 << 20
COUNTED_TERMS = 200_000

# Lower-cases A-Z and blanks every other ASCII character that is no digit or letter.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lists of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if at + PIECE_BYTES >= len(folded) else folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def words_of(text: str | None) -> list[bytes]:
    return [w for piece in pieces((text or "").encode()) for w in piece]


@dataclass(frozen=True)
class Block:
    """Some items of the test set: ids and words, and the number of every term."""

    ids: list[str | None]
    items: list[list[bytes]]
    terms: dict[bytes, int]

    def windows(self, item: int) -> Iterator[range]:
        n = len(self.items[item])
        return (range(i, min(i + WINDOW, n)) for i in range(max(1, n - WINDOW + 1)))

    def opened_first(self, counts: dict[int, int]) -> set[tuple[int, int]]:
        """(item, offset) of the rarest terms of every window."""
        found = set()
        for item, its_words in enumerate(self.items):
            rank = [(counts.get(self.terms[w], 0), i) for i, w in enumerate(its_words)]
            for window in self.windows(item):
                found.update((item, i) for _, i in sorted(rank[window.start : window.stop])[:OPENED_FIRST])
        return found


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The distinct items that have words, about ``block_chars`` characters at a time, at least one item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // block_chars)
    for number in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).collect()
        kept = [(r["item_id"], w) for r in rows if (w := words_of(r["text"]))]
        kept.sort(key=lambda x: (x[0] or "", x[1]))
        terms = {t: i for i, t in enumerate(sorted({w for _, its in kept for w in its}))}
        if kept:
            yield Block([i for i, _ in kept], [its for _, its in kept], terms)


def _count_terms(terms: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        seen: Counter[bytes] = Counter()

        def settle() -> None:
            for word in seen.keys() & terms.keys():
                total[terms[word]] += seen[word]
            seen.clear()

        for batch in batches:
            for text in batch.column("text"):
                for piece in pieces(text.as_py() or b""):
                    seen.update(piece)
                    if len(seen) > COUNTED_TERMS:
                        settle()
        settle()
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(total[present])], ["term", "n"])

    return count


def _postings(terms: dict[bytes, int]):
    """``doc_id, text_hash, n_words`` and the terms and positions of the listed words, in text order."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers, places = [], [], []
            for text in batch.column("text"):
                n, term, place = 0, [], []
                for piece in pieces(text.as_py() or b""):
                    hits = [i for i, w in enumerate(piece) if w in terms]
                    term += [terms[piece[i]] for i in hits]
                    place += [n + i for i in hits]
                    n += len(piece)
                lengths.append(n)
                numbers.append(term)
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(lengths, pa.int64()),
                    pa.array(numbers, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())),
                ],
                ["doc_id", "text_hash", "n_words", "terms", "places"],
            )

    return index


POSTINGS = "doc_id long, text_hash long, n_words long, terms array<int>, places array<int>"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )


def _long(postings: DataFrame) -> DataFrame:
    """``doc_id, text_hash, term, place``: one row per posting."""
    pair = F.arrays_zip("terms", "places")
    return postings.select("doc_id", "text_hash", F.explode(pair).alias("p")).select(
        "doc_id", "text_hash", F.col("p.terms").alias("term"), F.col("p.places").alias("place")
    )


def _local(docs: DataFrame, **columns: list) -> DataFrame:
    return docs.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}))


def term_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    counted = _rows(docs).select("text").mapInArrow(_count_terms(block.terms), "term long, n long")
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _alignments(index: DataFrame, block: Block, first: set[tuple[int, int]]) -> DataFrame:
    """``doc_id, text_hash, item, shift`` where as many opened lists meet as one window has."""
    opened = sorted(first)
    offsets = _local(
        index,
        term=[block.terms[block.items[i][j]] for i, j in opened],
        item=[i for i, _ in opened],
        offset=[j for _, j in opened],
        needed=[min(OPENED_FIRST, len(block.items[i])) for i, _ in opened],
    )
    met = _long(index).join(offsets, "term").groupBy("doc_id", "text_hash", "item", (F.col("place") - F.col("offset")).alias("shift"))
    return met.agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed")).where("n >= needed").drop("n", "needed")


def _of_documents(docs: DataFrame, wanted: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The postings of some documents, given as ``doc_id, text_hash``."""
    keys = wanted.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    rows = _rows(docs)
    some = rows.join(keys, same_row((rows["doc_id"], rows["text_hash"]), (F.col("k"), F.col("h"))), "left_semi")
    # Repeated rows have the same postings.
    return _long(some.mapInArrow(_postings(terms), POSTINGS)).distinct()


def _matches(docs: DataFrame, aligned: DataFrame, block: Block) -> DataFrame:
    """``doc_id, text_hash, item, place``: the words of every document that lie inside an occurrence of a window."""
    listed = [(i, j, w) for i, its in enumerate(block.items) for j, w in enumerate(its)]
    item_words = _local(
        docs,
        item=[i for i, _, _ in listed],
        offset=[j for _, j, _ in listed],
        term=[block.terms[w] for _, _, w in listed],
        needed=[min(WINDOW, len(block.items[i])) for i, _, _ in listed],
    )
    expected = aligned.join(item_words, "item").select(
        F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), "item", "shift", "offset", "needed",
        F.col("term").alias("t"), (F.col("shift") + F.col("offset")).alias("p"),
    )
    found = _of_documents(docs, aligned, block.terms)
    here = same_row((found["doc_id"], found["text_hash"]), (F.col("k"), F.col("h")))
    met = expected.join(found, here & (found["term"] == F.col("t")) & (found["place"] == F.col("p")))
    by_alignment = Window.partitionBy("k", "h", "item", "shift")
    run = F.col("offset") - F.row_number().over(by_alignment.orderBy("offset"))
    in_run = Window.partitionBy("k", "h", "item", "shift", "run")
    kept = met.withColumn("run", run).withColumn("n", F.count(F.lit(1)).over(in_run)).where("n >= needed")
    return kept.select(F.col("k").alias("doc_id"), F.col("h").alias("text_hash"), "item", "place").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Word counts ``doc_id, text_hash, n_words`` of all documents, and hit words ``doc_id, text_hash, item_id, place``.

    Both are None if the test set has no words.
    """
    sizes = hits = None
    for block in blocks(benchmark):
        first = block.opened_first(term_counts(docs, block))
        opened = {w: block.terms[w] for w in {block.items[i][j] for i, j in first}}
        index = cut(_rows(docs).mapInArrow(_postings(opened), POSTINGS), "postings")
        sizes = index.select("doc_id", "text_hash", "n_words") if sizes is None else sizes
        aligned = cut(_alignments(index, block, first), "alignments")
        ids = docs.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, pa.string())})
        )
        found = _matches(docs, aligned, block).join(ids, "item").select("doc_id", "text_hash", "item_id", "place")
        hits = found if hits is None else hits.unionAll(found)
    return sizes, hits


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``."""
    sizes, hits = occurrences(docs, benchmark)
    if sizes is None:
        sizes = _rows(docs).mapInArrow(_postings({}), POSTINGS).select("doc_id", "text_hash", "n_words")
        hits = sizes.where("false").select("doc_id", "text_hash", F.lit("").alias("item_id"), F.lit(0).alias("place"))
    hits = cut(hits, "hits")
    key = [F.col("doc_id").alias("k"), F.col("text_hash").alias("h")]
    places = hits.select(*key, "place").distinct().groupBy("k", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select(*key, "item_id").distinct().groupBy("k", "h").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    items = items.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "items")
    per_doc = places.join(items, same_row((F.col("k"), F.col("h")), (F.col("k2"), F.col("h2"))), "left")
    all_docs = sizes.join(per_doc, same_row((F.col("doc_id"), F.col("text_hash")), (F.col("k"), F.col("h"))), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return all_docs.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * MIN_HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = 2 * WINDOW) -> DataFrame:
    """``doc_id, text_hash, item_id, start, place``: windows all of whose terms lie near one another, in any order.

    ``start`` is the window's first word in the item, ``place`` an occurrence of its rarest term; every other term of
    the window occurs within ``span`` words of it. Positions are put into buckets as wide as the span, so a
    term's list is only compared with the buckets beside the occurrence.
    """
    schema = "doc_id long, text_hash long, item_id string, start int, place int"
    result = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        counts = term_counts(docs, block)
        windows = [(i, w.start, {block.terms[x] for x in block.items[i][w.start : w.stop]}) for i in range(len(block.items)) for w in block.windows(i)]
        rarest = [min(terms, key=lambda t: (counts.get(t, 0), t)) for _, _, terms in windows]
        opened = {w: t for w, t in block.terms.items() if t in set(rarest)}
        index = cut(_rows(docs).mapInArrow(_postings(opened), POSTINGS), "postings")
        heads = _local(docs, window=list(range(len(windows))), term=rarest, needed=[len(t) for _, _, t in windows])
        cases = _long(index).join(heads, "term").select(
            F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), "window", "needed", F.col("place").alias("p")
        )
        members = _local(docs, window=[n for n, w in enumerate(windows) for _ in w[2]], t=[t for w in windows for t in sorted(w[2])])
        width = F.lit(span + 1)
        beside = F.explode(F.array(*(F.call_function("div", F.col("p"), width) + d for d in (-1, 0, 1)))).alias("bucket")
        wanted = cases.join(members, "window").select("*", beside)
        wanted_docs = cases.select(F.col("k").alias("doc_id"), F.col("h").alias("text_hash"))
        found = _of_documents(docs, wanted_docs, block.terms).withColumn("b", F.call_function("div", F.col("place"), width))
        same = same_row((found["doc_id"], found["text_hash"]), (F.col("k"), F.col("h")))
        near = wanted.join(found, same & (found["term"] == F.col("t")) & (found["b"] == F.col("bucket")))
        near = near.where(F.abs(F.col("place") - F.col("p")) <= span).select("k", "h", "window", "needed", "p", "t").distinct()
        whole = near.groupBy("k", "h", "window", "needed", "p").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
        names = docs.sparkSession.createDataFrame(
            pa.table({
                "window": pa.array(range(len(windows)), pa.int32()),
                "item_id": pa.array([block.ids[i] for i, _, _ in windows], pa.string()),
                "start": pa.array([s for _, s, _ in windows], pa.int32()),
            })
        )
        result = result.unionAll(
            whole.join(names, "window").select(F.col("k").alias("doc_id"), F.col("h").alias("text_hash"), "item_id", "start", F.col("p").alias("place"))
        )
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k"), text_hash(F.col("text")).alias("h")
    )
    kept = rows.join(bad, same_row((F.col("k"), F.col("h")), (F.col("bad_id"), F.col("bad_hash"))), "left_anti")
    return kept.select("row.*")
