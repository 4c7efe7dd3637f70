"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text: every byte shifts the 32-bit hash left by one and adds the byte's random
number, so it depends on the last 32 bytes alone. A chunk may end before a word if ``MASK_BITS`` leading bits of the
hash are zero there, at least ``MIN_WORDS`` and at most ``MAX_WORDS`` after it began. Boundaries follow the content:
after an insertion they fall into step again within a few words, and the chunks of a shared passage come out equal.

Chunks are compared by a 128-bit digest of their words; white space is not compared. A chunk is shared if at least two
documents have it. Shared chunks that follow each other form a passage, which counts if they have ``MIN_PASSAGE_WORDS``
words or more. The chunks at the edges of a repeated passage also hold other words, so it shows some chunks shorter
than it is. ``whole_passages`` therefore takes runs from ``CANDIDATE_WORDS`` words on, compares the words on both sides
with those at the first occurrence of the run's outer chunks, one by one and up to ``REACH_WORDS``, and also reports runs
that have more than ``LONG_WORDS`` words with these. A first occurrence reaches as far as the longest of its repeats.

Digests are grouped with a map-side combined minimum, which a chunk of very many documents does not slow down. They are
grouped by their complement, so that the joins back to the single chunks read two plain shuffles, which adaptive
execution can split.

``without_repeats`` cuts chunks out one by one: those of a passage that occur earlier, and the words beside its first and
last chunk where these occur earlier themselves. Whatever is cut out is equal to words at an earlier place, so of all
copies of a word the first one stays.

NULL and empty texts have no chunks. Equal rows (same ``doc_id`` and text) are one document, so copies of a row under
one id are no repeat. The first occurrence is that of the smallest ``doc_id`` (a missing one first), then text hash,
then place. Other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, same_row, text_hash

MASK_BITS = 2
MIN_WORDS = 3
MAX_WORDS = 24
MIN_PASSAGE_WORDS = 20
CANDIDATE_WORDS = 15
LONG_WORDS = 50
REACH_WORDS = 64
_WORD_BITS = MAX_WORDS.bit_length()
PIECE_BYTES = 1 << 20
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_IS_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: five doublings of the window, 1 to 32 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _bounds(data: np.ndarray, starts: np.ndarray) -> list[int]:
    """The first word of every chunk, and the number of words.

    The text is hashed a piece at a time, each with the bytes before it that the rolling window needs.
    """
    if not len(starts):
        return [0]
    may_cut = np.zeros(len(starts), bool)
    for a in range(0, len(data), PIECE_BYTES):
        lead = min(a, 32)
        hashes = gear_hashes(data[a - lead : a + PIECE_BYTES])
        here = slice(*np.searchsorted(starts, (a, a + PIECE_BYTES)))
        at = starts[here] - a + lead - 1  # the hash of everything before the word
        may_cut[here] = np.where(at >= 0, hashes[at] >> np.uint32(32 - MASK_BITS) == 0, False)
    first, n, bounds = 0, len(starts), [0]
    for cut_at in [*np.flatnonzero(may_cut).tolist(), n]:
        while cut_at - first > MAX_WORDS:
            first += MAX_WORDS
            bounds.append(first)
        if cut_at - first >= MIN_WORDS or cut_at == n and cut_at > first:
            first = cut_at
            bounds.append(first)
    return bounds


def chunks(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """``first byte, end byte, first word, number of words`` of every chunk, in order and without gaps between words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    for first, end in pairwise(_bounds(data, starts)):
        yield int(starts[first]), int(ends[end - 1]), first, end - first


CHUNK = "doc_id long, text_hash long, number int, start int, end int, is_last boolean, n_words int, high long, low long"
_NAMES = [c.split()[0] for c in CHUNK.split(", ")]
_PLACE = ("doc_id", "text_hash", "number", "start", "end", "is_last")


def _chunk_columns(text: bytes) -> tuple[np.ndarray, ...]:
    """``number`` to ``low`` of every chunk; the digests are taken from the words with one space between them."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    bounds = np.array(_bounds(data, starts), np.int64)
    first, last = bounds[:-1], bounds[1:] - 1
    flat, flat_ends = b" ".join(text.split()), np.cumsum(ends - starts + 1) - 1
    spans = zip((flat_ends - (ends - starts))[first].tolist(), flat_ends[last].tolist(), strict=True)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(flat[a:b]) for a, b in spans]), ">i8")
    number = np.arange(len(first))
    return number, starts[first], ends[last], number == len(first) - 1, np.diff(bounds), digests[::2], digests[1::2]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, n = [], [], 0
        for row, text in enumerate(batch.column("text")):
            found.append(_chunk_columns(text.as_py() or b""))
            rows.append(np.full(len(found[-1][0]), row))
            n += len(rows[-1])
            if n > 100_000:
                yield _batch(batch, rows, found)
                rows, found, n = [], [], 0
        if rows:
            yield _batch(batch, rows, found)


def _batch(batch: pa.RecordBatch, rows: list[np.ndarray], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in CHUNK.split(", ")]
    at = pa.array(np.concatenate(rows))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    native = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds[2:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), *native], _NAMES)


def chunk_table(docs: DataFrame) -> DataFrame:
    """One row per chunk of every document; offsets count the bytes of the text in UTF-8."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(_chunk_rows, CHUNK)


def _tight(found: DataFrame) -> DataFrame:
    """Chunks with their small numbers in two, for a shuffle, which keeps eight bytes for each. Spans are below 2^31."""
    place = F.shiftleft(F.col("number").cast("long"), _WORD_BITS + 1) + F.shiftleft("n_words", 1) + F.col("is_last").cast("int")
    span = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end") - F.col("start")
    return found.select("doc_id", "text_hash", place.alias("place"), span.alias("span"), "high", "low")


def _loose(tight: DataFrame) -> DataFrame:
    start = F.shiftright("span", 32)
    columns = {
        "number": F.shiftright("place", _WORD_BITS + 1), "start": start, "end": start + F.col("span").bitwiseAND((1 << 32) - 1),
        "is_last": F.col("place").bitwiseAND(1) == 1, "n_words": F.shiftright("place", 1).bitwiseAND((1 << _WORD_BITS) - 1),
    }
    kinds = dict(c.split() for c in CHUNK.split(", "))
    return tight.select(*(columns.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in _NAMES))


def shared_chunks(docs: DataFrame) -> DataFrame:
    """The chunks that two or more documents have, with the document and place that has them first.

    All chunks are counted by half of the digest, and only what occurs twice is grouped by all of it and by document, so
    that the bulk of the chunks is shuffled as one number with its count, and once more for the join. The texts are cut
    into chunks for both: the table of all chunks, about as large as that of the texts, is nowhere stored.
    """
    found = chunk_table(docs)
    twice = found.groupBy(F.bitwise_not("low").alias("not_low")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    likely = cut(_loose(_tight(found).join(twice.select(F.bitwise_not("not_low").alias("low")), "low")), "likely-chunks")
    doc, not_high = F.xxhash64("doc_id", "text_hash"), F.bitwise_not("high").alias("not_high")
    owners = likely.groupBy(not_high, "low").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.min(F.struct(*_PLACE)).alias("first"))
    return likely.join(owners.where("a < b").select(F.bitwise_not("not_high").alias("high"), "low", "first"), ["high", "low"])


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """Runs of shared chunks; ``left`` and ``right`` are the first occurrences of their outer chunks, ``again`` the chunks
    that occur earlier."""
    by_doc = Window.partitionBy("doc_id", "text_hash")
    shared = shared_chunks(docs).repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "number"])
    run = F.col("number") - F.row_number().over(by_doc.orderBy("number"))
    own = F.col("first").eqNullSafe(F.struct(*_PLACE))
    passages = shared.withColumn("run", run).withColumn("own", own).groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.sort_array(F.collect_set("first.doc_id")).alias("first_ids"), F.every("own").alias("is_first"),
        F.min_by("first", "number").alias("left"), F.max_by("first", "number").alias("right"),
        F.min("number").alias("number"), F.max_by("is_last", "number").alias("is_last"),
        F.collect_list(F.when(~F.col("own"), F.struct("start", "end"))).alias("again"),
    )
    return passages.where(F.col("n_words") >= min_words).drop("run")


def repeated_passages(docs: DataFrame, min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """Passages that other documents share: ``doc_id, text_hash, start, end, n_words, first_ids, is_first``.

    ``first_ids`` lists the documents in which the passage's chunks occur first, and ``is_first`` tells whether the
    passage is itself the first occurrence of all its chunks.
    """
    return _runs(docs, min_words).drop("left", "right", "number", "is_last", "again")


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside every wanted edge, from the nearest on: their hashes and the bytes where they end outwards."""
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "wanted")), strict=True)
        columns: list[list] = [[] for _ in range(6)]
        for (doc, hash_, wanted), text in zip(keys, batch.column("text"), strict=True):
            data = text.as_py() or b""
            starts, ends = word_spans(np.frombuffer(data, np.uint8))
            for edge in wanted:
                side, at = edge["side"], edge["at"]
                n = int(np.searchsorted(starts, at))
                after = range(n, min(n + REACH_WORDS, len(starts)))
                beside = range(n - 1, max(n - REACH_WORDS, 0) - 1, -1) if side < 0 else after
                hashes = [xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]]) - (1 << 63) for i in beside]
                places = [int(starts[i] if side < 0 else ends[i]) for i in beside]
                for column, value in zip(columns, (doc, hash_, side, at, hashes, places), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "side", "at", "hashes", "places"])


def _same_edge(a: str, b: str) -> Column:
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("text_hash", "side", "at")]
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & same[0] & same[1] & same[2]


def whole_passages(docs: DataFrame, min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """``repeated_passages`` extended word by word, and the shorter runs that belong to over ``LONG_WORDS`` words.

    Only the edges of runs meet the texts, once per document and place; the words beside them are joined by place, so a
    first occurrence that very many documents repeat is no group of one task. An edge at an end of either text has no
    words beside it.
    """
    return _whole(docs, min_words).drop("again")


def _whole(docs: DataFrame, min_words: int) -> DataFrame:
    """``whole_passages`` with the spans ``again`` of each that occur earlier."""
    runs = cut(_runs(docs, min(min_words, CANDIDATE_WORDS)), "candidate-passages")

    def edge(doc: str, hash_: str, side: int, at: str) -> Column:
        return F.struct(F.col(doc).alias("doc_id"), F.col(hash_).alias("text_hash"), F.lit(side).alias("side"), F.col(at).alias("at"))

    def key(doc: Column, hash_: Column) -> list[Column]:
        return [doc.isNull().alias("missing"), F.coalesce(doc, F.lit(0)).alias("k"), hash_.alias("h")]

    sides = [(-1, "start", "left"), (1, "end", "right")]
    inner = {-1: F.least("number", "left.number") > 0, 1: ~F.col("is_last") & ~F.col("right.is_last")}
    pairs = runs.select(F.explode(F.array_compact(F.array(*(
        F.when(inner[side], F.struct(
            edge("doc_id", "text_hash", side, at).alias("a"), edge(f"{first}.doc_id", f"{first}.text_hash", side, f"{first}.{at}").alias("b")
        ))
        for side, at, first in sides
    )))).alias("pair")).select("pair.*").where(~F.col("a").eqNullSafe(F.col("b"))).distinct()
    # One key for the edges of a row, its text and the copies of the row: all meet in one shuffle.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct().groupBy(*key(F.col("e.doc_id"), F.col("e.text_hash"))).agg(
        F.collect_list(F.struct("e.side", "e.at")).alias("wanted")
    )
    rows = docs.select(*key(F.col("doc_id").cast("long"), text_hash(F.col("text"))), F.col("text").cast("binary").alias("text"))
    rows = rows.join(wanted, ["missing", "k", "h"]).dropDuplicates(["missing", "k", "h"])
    rows = rows.select(F.when(~F.col("missing"), F.col("k")).alias("doc_id"), F.col("h").alias("text_hash"), "text", "wanted")
    reach = rows.mapInArrow(_reach, "doc_id long, text_hash long, side int, at int, hashes array<long>, places array<int>")
    reach = cut(reach, "edges")

    joined = pairs.join(reach.alias("x"), _same_edge("a", "x")).select("a", "b", F.col("hashes").alias("mine"), F.col("places").alias("to"))
    joined = joined.join(reach.alias("y"), _same_edge("b", "y"))
    differs = F.array_position(F.zip_with("mine", "hashes", lambda x, y: x.eqNullSafe(y)), False)
    n = F.when(differs == 0, F.size("mine")).otherwise(differs - 1).cast("int")
    grown = joined.select("a", "b", n.alias("n"), "to", "places").where("n > 0")
    grown = cut(grown.select("a", "b", "n", F.get("to", F.col("n") - 1).alias("a_to"), F.get("places", F.col("n") - 1).alias("b_to")), "grown")
    # Where this text repeats an earlier one the words beside it go with it; where it is the earlier one they only lengthen it.
    longest = grown.select("a.*", "n", F.col("a_to").alias("to"), F.lit(True).alias("again")).unionAll(
        grown.select("b.*", "n", F.col("b_to").alias("to"), F.lit(False).alias("again"))
    )
    furthest = F.struct("n", "to")
    longest = longest.groupBy("doc_id", "text_hash", "side", "at").agg(
        F.max(furthest).alias("more"), F.max(F.when(F.col("again"), furthest)).alias("more_again")
    )

    whole = runs.drop("left", "right", "number", "is_last")
    for side, at, _ in sides:
        more = longest.where(F.col("side") == side).select(
            F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), F.col("at"), F.col("more").alias(f"more_{at}"), F.col("more_again.to").alias(f"again_{at}")
        )
        here = same_row((F.col("doc_id"), F.col("text_hash")), (F.col("k"), F.col("h"))) & (F.col(at) == F.col("at"))
        whole = whole.join(more, here, "left").drop("k", "h", "at")
    n_words = F.col("n_words") + F.coalesce("more_start.n", F.lit(0)) + F.coalesce("more_end.n", F.lit(0))
    beside = [
        F.when(F.col("again_start").isNotNull(), F.struct(F.col("again_start").alias("start"), F.col("start").alias("end"))),
        F.when(F.col("again_end").isNotNull(), F.struct(F.col("end").alias("start"), F.col("again_end").alias("end"))),
    ]
    whole = whole.where((F.col("n_words") >= min_words) | (n_words > LONG_WORDS)).select(
        "doc_id", "text_hash", F.coalesce("more_start.to", "start").alias("start"), F.coalesce("more_end.to", "end").alias("end"),
        n_words.alias("n_words"), "first_ids", "is_first", F.concat("again", F.array_compact(F.array(*beside))).alias("again"),
    )
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("first_ids"))))
    return whole.groupBy("doc_id", "text_hash", "start", "end").agg(
        F.max("n_words").alias("n_words"), ids.alias("first_ids"), F.every("is_first").alias("is_first"), F.flatten(F.collect_list("again")).alias("again")
    )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data, at, kept = text.as_py(), 0, []
            if data is not None:
                for span in sorted(spans or [], key=lambda s: s["start"]):
                    kept.append(data[at : max(at, span["start"])])
                    at = max(at, span["end"])
                data = b"".join([*kept, data[at:]]).decode()
            texts.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "left"])


def without_repeats(docs: DataFrame, min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """``docs`` without what occurred before in the passages; of all copies of a word the first one stays."""
    gone = _whole(docs, min_words).where(F.size("again") > 0).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("again")).alias("spans"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "spans")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k"), text_hash(F.col("text")).alias("h"))
    joined = rows.join(gone, same_row((F.col("k"), F.col("h")), (F.col("gone_id"), F.col("gone_hash"))), "left")
    joined = joined.select("row", F.col("row.text").cast("binary").alias("text"), "spans")
    row = joined.schema["row"].dataType.simpleString()
    left = joined.mapInArrow(_cut_out, f"row {row}, left string")
    return left.select(*(F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
