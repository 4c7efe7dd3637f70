"""Exact substring deduplication by merging the Burrows-Wheeler transforms of shards.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier is removed: in a document with a smaller
``doc_id``, or further left in the same document. Texts are UTF-8 bytes, and matches never cross documents.

Strings. A *window* is a string of ``LENGTH`` bytes, and its anchor the smallest of the hashes of its ``GRAM``-byte
grams. Equal windows have equal anchors. Neighbouring windows of one anchor form a *stretch*, about 33 windows on
average. Only an anchor that occurs twice can belong to a repeated window, so stretches are counted by their anchor (a
map-side combined sum) and those of single anchors are settled. Equal stretches are one *string* with its first
occurrence: all windows of the other occurrences start earlier too.

Merging. A string that is alone with its anchor, and in which the anchor occurs once, has nothing to be merged with. The
others meet in one task, several anchors at a time and sorted by anchor. The task cuts its strings into shards, sorts the
suffixes of each shard once, by their first ``LENGTH`` bytes, and keeps the shard's transform: the byte before each
suffix, in order. The transforms are merged by refining their interleave, which says from which shard, and from which
place in its order, each suffix of the merged order comes. Round k turns the order by k - 1 bytes into the order by k
bytes: the merged transform, read in the present order and sorted stably by byte, lists the suffixes one byte longer, and
where they stand in their shards follows from the transforms alone. No suffix is compared or sorted again. A boundary is
set where the byte or the block of the round before changes, so a boundary first set in round k stands for a common
prefix of k - 1 bytes. A block of one suffix is settled, as are all that grow out of it, and is left out of later rounds.
The blocks that are left after ``LENGTH`` rounds are the repeated intervals: all windows with the same bytes. Every window
of an interval but the first one by place starts earlier somewhere else.

Wide anchors. If these strings of one anchor exceed ``WIDE_BYTES``, each of their windows becomes a string of its own:
equal ones collapse to their first occurrence before anything meets, and nothing is left to merge. This is exact as well.

At scale. Three things are shuffled: anchors with a count, repeated stretches, and texts that hold strings to be merged
or bytes to be removed. Stretches end at ``PIECE`` windows, so that a text of one repeated character is no large string,
and texts are hashed a bounded piece at a time. A document's own spans meet in its own task only.

NULL and empty texts have no bytes and keep none. Equal rows (same ``doc_id`` and text) are one document and share its
result. Different texts under one ``doc_id`` are ordered by a hash of the text, which is only carried along if a table
has such rows, and a missing ``doc_id`` comes first.
Empty tables give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, same_row, text_hash

LENGTH = 100
GRAM = 36
PIECE = 1024
PIECE_BYTES = 1 << 20
SHARD_BYTES = 1 << 16
MERGE_BYTES = 1 << 18
WIDE_BYTES = 1 << 21
END = 0xFF  # no byte of UTF-8 text; ends every string

_RANDOM = np.random.default_rng(20240531).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STRETCH = "doc_id long, text_hash long, start int, n int, anchor long, print long, times int"
_SPAN = "doc_id long, text_hash long, start int, end int"


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_UP, _DOWN = (_powers(b, PIECE_BYTES + LENGTH) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, from running sums modulo 2^64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * _UP[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Over texts laid end to end: ``start, n, anchor, times`` of all stretches of windows that lie in one text.

    ``ends`` are the ends of the texts, in order. ``times`` is 2 if an anchor occurs twice inside the stretch, else 1.
    """
    for a in range(0, len(data) - LENGTH + 1, PIECE_BYTES):
        piece = data[a : a + PIECE_BYTES + LENGTH - 1]
        h = gram_hashes(piece)
        anchor = _sliding_min(h, LENGTH - GRAM + 1)
        text = np.searchsorted(ends, np.arange(a, a + len(anchor)), side="right")
        inside = np.arange(a, a + len(anchor)) + LENGTH <= ends[text]
        same = (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1]) & inside[1:] & inside[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        n = np.diff(np.append(first, len(anchor)))
        # The anchor moves inside a stretch if the window that begins with it is not the last one.
        moves = np.append((h[: len(anchor) - 1] == anchor[:-1]) & same, False)
        times = 1 + (np.add.reduceat(moves, first, dtype=np.int64) > 0)
        if n.max() > PIECE:
            parts = -(-n // PIECE)
            which = np.repeat(np.arange(len(n)), parts)
            number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            first, n, times = first[which] + number * PIECE, np.minimum(n[which] - number * PIECE, PIECE), times[which]
        good = inside[first]
        yield first[good] + a, n[good], anchor[first[good]].view(np.int64), times[good]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with all their bytes: ``first row, end row, bytes, ends of the texts``."""
    column = batch.column("text").fill_null(b"")
    sizes = np.array([len(x.as_buffer()) for x in column], np.int64)
    at = 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), PIECE_BYTES, side="right")))
        data = np.frombuffer(b"".join(x.as_py() for x in column.slice(at, to - at)), np.uint8)
        yield at, to, data, np.cumsum(sizes[at:to])
        at = to


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, data, ends in _texts(batch):
            for *_, anchor, times in stretches(data, ends):
                anchor, back = np.unique(anchor, return_inverse=True)
                counts = np.bincount(back, times, len(anchor)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(counts)], ["anchor", "times"])


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, hashes = batch.column("doc_id"), batch.column("text_hash")
        for first, _, data, ends in _texts(batch):
            begins = np.concatenate(([0], ends[:-1]))
            for start, n, anchor, times in stretches(data, ends):
                text = np.searchsorted(ends, start, side="right")
                view = memoryview(data)
                prints = [xxhash.xxh3_64_intdigest(view[s : s + k]) for s, k in zip(start.tolist(), (n + LENGTH - 1).tolist(), strict=True)]
                row = pa.array(text + first)
                columns = [
                    docs.take(row), hashes.take(row), pa.array(start - begins[text], pa.int32()), pa.array(n, pa.int32()), pa.array(anchor),
                    pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(times, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STRETCH.split(", ")])


# ---- transforms of shards, and their interleave ----


def shard_transform(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order, transform`` of strings laid end to end, each closed by ``END``.

    ``order`` lists the places of all suffixes by their first ``LENGTH`` bytes; a suffix ends with its string, the ends
    come first, and equals stay in the order of their places. ``transform`` has the byte before each suffix, ``END``
    before the first one of a string. Places are ranked by 8 bytes, then by twice as many in every round, in which only
    those take part that share their rank. A rank is the number of places before its first one.
    """
    n = len(data)
    left = np.repeat(np.cumsum(lengths) - 1, lengths) - np.arange(n)  # bytes up to the END of each place's string
    symbol = np.where(data == END, 0, data.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n, np.uint64)
    for i in range(8):  # nothing after the end of a string
        key <<= np.uint64(8)
        inside = np.flatnonzero(left >= i) if i else slice(None)
        key[inside] |= symbol[inside + i if i else inside]
    rank = np.zeros(n, np.int64)
    shared = _refine(rank, key, np.arange(n))
    width = 8
    while width < LENGTH and len(shared):
        ahead = np.zeros(len(shared), np.int64)
        reach = np.flatnonzero(left[shared] >= width)
        ahead[reach] = rank[shared[reach] + width] + 1
        shared = _refine(rank, rank[shared] * np.int64(n + 1) + ahead, shared)
        width *= 2
    order = np.argsort(rank * n + np.arange(n))
    before = np.concatenate(([END], data[:-1])).astype(np.uint8)
    return order, before[order]


def _refine(rank: np.ndarray, key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Rank the places ``some`` by their keys, which begin with their present ranks; the places that still share one."""
    order = np.argsort(key)
    places, ordered, old = some[order], key[order], rank[some[order]]
    at = np.arange(len(places))
    begins = np.append(True, ordered[1:] != ordered[:-1])
    of_old = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
    rank[places] = old + np.maximum.accumulate(np.where(begins, at, 0)) - of_old
    return places[~(begins & np.append(begins[1:], True))]


def steps(transform: np.ndarray) -> np.ndarray:
    """For each suffix of a shard the place of the one that is a byte longer, -1 if there is none.

    The suffixes that begin with a byte stand in the order of those they extend, as the transform lists them.
    """
    longer = np.full(len(transform), -1, np.int32)
    order = np.argsort(transform, kind="stable")  # END, the largest, is before no suffix
    n_ends = np.count_nonzero(transform == END)
    longer[order[: len(order) - n_ends]] = np.arange(n_ends, len(order))
    return longer


def merge(transforms: list[np.ndarray], rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``places, blocks`` of the suffixes that share their first ``rounds`` bytes with others, in merged order.

    Places count through all shards. Suffixes of one block agree in these bytes; the rest are settled.
    """
    merged = np.concatenate(transforms)
    begins = np.cumsum([0, *map(len, transforms)], dtype=np.int32)
    longer = np.concatenate([steps(t) + at for t, at in zip(transforms, begins, strict=False)])
    interleave = np.arange(len(merged), dtype=np.int32)
    block = np.zeros(len(merged), np.int32)
    for _ in range(rounds):
        symbol = merged[interleave]
        order = np.argsort(symbol, kind="stable")[: np.count_nonzero(symbol != END)]
        symbol, block = symbol[order], block[order]
        interleave = longer[interleave[order]]
        begin = np.ones(len(order) + 1, bool)
        begin[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        several = ~(begin[:-1] & begin[1:])
        interleave, block = interleave[several], np.cumsum(begin[:-1], dtype=np.int32)[several]
        if not len(interleave):
            break
    return interleave, block


def repeated_spans_of(strings: list[bytes], windows: list[int], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``string, start, end``: the spans of bytes of strings whose windows start earlier elsewhere.

    A string has as many windows as given. ``place`` orders the strings by their first occurrence: ``document, start`` per
    string, where the start also tells windows of one document apart. Windows that touch make one span; starts and ends
    count from where the string begins in its document.
    """
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8)
    shard_of = begins // SHARD_BYTES
    cuts = np.flatnonzero(np.concatenate(([True], shard_of[1:] != shard_of[:-1], [True])))
    orders, transforms = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at, to = int(begins[a]), int(begins[b - 1] + lengths[b - 1])
        order, transform = shard_transform(data[at:to], lengths[a:b])
        orders.append(order + at)
        transforms.append(transform)
    interleave, block = merge(transforms)
    places = np.concatenate(orders)[interleave]

    string = np.repeat(np.arange(len(strings)), lengths)
    offset = np.arange(len(data)) - begins[string]
    is_window = (offset < np.asarray(windows)[string])[places]
    at, group = places[is_window], block[is_window]
    start = place[string, 1] + offset
    order = np.lexsort((start[at], place[string[at], 0], group))
    later = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    at = np.sort(at[order[later]])
    if not len(at):
        return at, at, at
    apart = np.flatnonzero((string[at][1:] != string[at][:-1]) | (start[at][1:] > start[at][:-1] + LENGTH)) + 1
    first, last = at[np.append(0, apart)], at[np.append(apart, len(at)) - 1]
    return string[first], start[first], start[last] + LENGTH


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by anchor -> spans; whole anchors are gathered until there are ``MERGE_BYTES``."""
    held: list[tuple] = []
    size, anchor = 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_hash", "start", "n", "string")]
        for row in zip(*columns, strict=True):
            if held and row[:4] == held[-1][:4]:
                continue  # a copy of the same document
            if size >= MERGE_BYTES and row[0] != anchor:
                yield _settled(held)
                held, size = [], 0
            held.append(row)
            size, anchor = size + len(row[5]), row[0]
    if held:
        yield _settled(held)


def _settled(held: list[tuple]) -> pa.RecordBatch:
    keys = [(doc is not None, doc or 0, h) for _, doc, h, *_ in held]
    documents = {key: i for i, key in enumerate(sorted(set(keys)))}
    place = np.array([(documents[key], row[3]) for key, row in zip(keys, held, strict=True)], np.int64)
    string, start, end = repeated_spans_of([row[5] for row in held], [row[4] for row in held], place)
    docs = [pa.array([held[i][c] for i in string.tolist()], pa.int64()) for c in (1, 2)]
    return pa.RecordBatch.from_arrays([*docs, pa.array(start, pa.int32()), pa.array(end, pa.int32())], [c.split()[0] for c in _SPAN.split(", ")])


# ---- the tables ----


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``; the hash is zero for all unless some ``doc_id`` has different texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    ends = rows.groupBy("doc_id").agg((F.min("text_hash") < F.max("text_hash")).alias("several"))
    several = ends.agg(F.max("several")).first()[0]
    return rows if several else rows.withColumn("text_hash", F.lit(0).cast("long"))


def _with_known(rows: DataFrame, per_doc: DataFrame, how: str, *fields: str) -> DataFrame:
    """Documents beside the rows of ``per_doc`` about their document, as the array ``known`` of ``fields``.

    These are grouped by a hash beside the key, so that both sides of the join are plain shuffles, which adaptive
    execution can split if one row is repeated very often. Copies of a row say the same, once.
    """
    known = per_doc.groupBy(F.xxhash64("doc_id", "text_hash"), F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).agg(
        F.collect_set(F.struct(*fields)).alias("known")
    )
    return rows.join(known.select("k", "h", "known"), same_row((F.col("doc_id"), F.col("text_hash")), (F.col("k"), F.col("h"))), how)


_STRING = "doc_id long, text_hash long, start int, n int, anchor long, wide boolean, string binary"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text; a copy right after its row is passed over."""
    last = None
    for batch in batches:
        held, n_bytes = [[] for _ in range(7)], 0
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash")), strict=True)
        for key, text, known in zip(keys, batch.column("text"), batch.column("known"), strict=True):
            if key == last:
                continue
            last = key
            data, wanted = text.as_py(), [known.values.field(c).to_pylist() for c in ("start", "n", "anchor", "wide")]
            for row in zip(*wanted, strict=True):
                string = data[row[0] : row[0] + row[1] + LENGTH - 1]
                n_bytes += len(string)
                for column, value in zip(held, (*key, *row, string), strict=True):
                    column.append(value)
                if n_bytes > PIECE_BYTES:
                    yield _string_batch(held)
                    held, n_bytes = [[] for _ in range(7)], 0
        yield _string_batch(held)


def _string_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _STRING.split(", ")])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            string, n = row["string"], row["n"]
            digests = [xxhash.xxh3_128_digest(string[i : i + LENGTH]) for i in range(n)]
            own = [pa.array([row[c]] * n, pa.int64()) for c in ("doc_id", "text_hash")]
            starts = pa.array(range(row["start"], row["start"] + n), pa.int32())
            yield pa.RecordBatch.from_arrays([*own, starts, pa.array(digests, pa.binary())], ["doc_id", "text_hash", "start", "window"])


def _later(rows: DataFrame, *group: str) -> DataFrame:
    """The rows that are not at the first place of their group. ``rows`` are files, and a large group can be split."""
    place = F.struct("doc_id", "text_hash", "start")
    first = rows.groupBy(F.xxhash64(*group), *group).agg(F.min(place).alias("first")).select(*group, "first")
    return rows.join(first, list(group)).where(~F.col("first").eqNullSafe(place)).drop("first")


def repeated_spans(rows: DataFrame, wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """Spans of bytes that start earlier, window by window: ``doc_id, text_hash, start, end``; they may overlap.

    ``rows`` are ``documents``.
    """
    counted = rows.select("text").mapInArrow(_anchor_rows, "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times"))
    again = cut(counted.where("times > 1").select("anchor"), "anchors")
    found = cut(rows.mapInArrow(_stretch_rows, _STRETCH).join(again, "anchor"), "stretches")

    group = ["anchor", "print", "n"]
    first = found.groupBy(*group).agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.max("times").alias("times"))
    first = cut(first.select("anchor", "n", "times", "first.*"), "strings")
    # All windows of a stretch that is equal to an earlier one start earlier.
    copies = _later(found, *group).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))

    # Grouped with a hash beside the anchor, so that both sides of the join are plain shuffles.
    sizes = first.groupBy(F.xxhash64("anchor"), "anchor").agg(F.count(F.lit(1)).alias("strings"), F.max("times").alias("most"), F.sum(F.col("n") + (LENGTH - 1)).alias("bytes"))
    together = sizes.where("strings > 1 OR most > 1").select("anchor", (F.col("bytes") > wide_bytes).alias("wide"))
    wanted = first.drop("times").join(together, "anchor")
    strings = _with_known(rows, wanted, "inner", "start", "n", "anchor", "wide").mapInArrow(_strings, _STRING)
    strings = cut(strings, "string-bytes")
    merged = strings.where(~F.col("wide")).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_hash", "start")
    merged = merged.mapInArrow(_merged_rows, _SPAN)
    windows = cut(strings.where("wide").mapInArrow(_single_windows, "doc_id long, text_hash long, start int, window binary"), "windows")
    single = _later(windows, "window").select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("end"))
    return copies.unionAll(merged).unionAll(single)


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for text, known in zip(batch.column("text"), batch.column("known"), strict=True):
            data, pieces, end, spans = text.as_py() or b"", [], 0, 0
            if known.is_valid:
                starts, ends = (known.values.field(c).to_numpy() for c in ("start", "end"))
                for i in np.argsort(starts, kind="stable").tolist():
                    a, b = int(starts[i]), int(ends[i])
                    if a > end or not spans:
                        pieces.append(data[end:a])
                        spans += 1
                    end = max(end, b)
            kept = b"".join([*pieces, data[end:]])
            for column, value in zip(columns, (len(data), len(data) - len(kept), spans, kept), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _KEPT.split(", ")])


def without_repeats(docs: DataFrame, wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row: the bytes that are left, and the maximal runs removed."""
    rows = documents(docs)
    joined = _with_known(rows, repeated_spans(rows, wide_bytes), "left", "start", "end")
    return joined.select("doc_id", "text", "known").mapInArrow(_cut_out, _KEPT)
