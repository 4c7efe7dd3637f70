"""Near-duplicates by SimHash, found with the codewords of a covering code as anchors.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints are linked
if they differ in at most ``threshold`` bits.

Anchors. The 64 bits are cut into blocks of 23, 23, 7, 7, 3 and 1 bits, and each block has a perfect cyclic code:
two Golay codes (covering radius 3), two Hamming codes and a repetition code (radius 1), and single bits (radius 0).
An anchor is one codeword per block, 2^34 in all, and every fingerprint lies within the radius of exactly one in each
block. The *excess* of a fingerprint at an anchor is by how much its distance passes the radius, summed over blocks.

Meeting. If x and y differ in 3 bits or fewer, there is a word m at most 1 bit from x and at most 2 from y. The anchor
that covers m has an excess of at most 1 for x and at most 2 for y. So every fingerprint is copied to all anchors of
excess 2 or less, about 150, and marked where the excess is at most 1. Linked fingerprints always meet at an anchor
where one of them is marked; no pair is missed. Two unrelated ones meet with a chance of about 10^-7.

Only distinct fingerprints are copied, so exact copies cost one. At an anchor, fingerprints are compared in blocks of
bounded size and joined into trees by breadth-first search, so a dense group emits one edge per member, not per pair.

Texts without words, NULL included, have the fingerprint zero and are linked like any others. Repeated rows get the
same result each. A missing ``doc_id`` counts as larger than any other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, same_row, text_hash
from tablepulse.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
THRESHOLD = 3
HASH_BATCH = 1 << 15
COMPARE_BATCH = 1 << 20

# Lower-cases A-Z and turns every separator into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fold(text: str) -> bytes:
    """The words in lower case, with one space between them."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD).strip(b" ")
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    return folded


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash; shingles are hashed a batch at a time, so a long text needs little more memory."""
    folded = fold(text or "")
    if not folded:
        return 0
    gaps = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(folded)]))
    width = min(size, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), HASH_BATCH):
        spans = zip(starts[i : i + HASH_BATCH].tolist(), ends[i : i + HASH_BATCH].tolist(), strict=True)
        hashes = np.array([digest(folded[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


@dataclass(frozen=True)
class Block:
    """A perfect cyclic code of length ``n``: its generator polynomial as bits, and its covering radius."""

    n: int
    generator: int
    radius: int

    @property
    def check_bits(self) -> int:
        return self.generator.bit_length() - 1


# Generator polynomials of the Golay, Hamming and repetition codes.
GOLAY = Block(23, 0b110001110101, 3)
HAMMING = Block(7, 0b1011, 1)
TRIPLE = Block(3, 0b111, 1)
SINGLE = Block(1, 0b1, 0)
CODE = (GOLAY, GOLAY, HAMMING, HAMMING, TRIPLE, SINGLE)


def syndromes(values: np.ndarray, block: Block) -> np.ndarray:
    """The remainder of each value, as a polynomial over GF(2), by the generator."""
    left = values.astype(np.int64)
    for bit in range(block.n - 1, block.check_bits - 1, -1):
        left = np.where(left >> bit & 1, left ^ (block.generator << (bit - block.check_bits)), left)
    return left


def offsets(block: Block, most: int) -> list[np.ndarray]:
    """Per excess 0..``most``: for every syndrome the XOR masks from a word's leading bits to the codewords there.

    A codeword differs from the word by a vector of the same syndrome, and codewords are told apart by their bits
    above the check bits. Rows are padded with -1.
    """
    reach = min(block.radius + most, block.n)
    vectors = np.arange(1 << block.n, dtype=np.int64)
    weights = np.bitwise_count(vectors)
    vectors, weights = vectors[weights <= reach], weights[weights <= reach]
    found = syndromes(vectors, block)
    masks = vectors >> block.check_bits
    by_excess = []
    for excess in range(most + 1):
        near = weights <= block.radius if excess == 0 else weights == block.radius + excess
        s, m = found[near], masks[near]
        order = np.argsort(s, kind="stable")
        s, m = s[order], m[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        rows = np.full((1 << block.check_bits, int(rank.max(initial=-1)) + 1), -1, np.int64)
        rows[s, rank] = m
        by_excess.append(rows)
    return by_excess


class Anchors:
    """The anchors of excess up to ``most`` for fingerprints, as ``(row, anchor, excess)`` arrays."""

    def __init__(self, most: int, code: tuple[Block, ...] = CODE):
        self.most = most
        self.code = code
        tables = {block: offsets(block, most) for block in set(code)}
        self.tables = [tables[block] for block in code]

    def of(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(prints))
        anchors = np.zeros(len(prints), np.int64)
        excess = np.zeros(len(prints), np.int64)
        shift = 0
        for block, table in zip(self.code, self.tables, strict=True):
            values = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << block.n) - 1)
            shift += block.n
            lead, syndrome = values >> block.check_bits, syndromes(values, block)
            parts = []
            for extra in range(self.most + 1):
                able = np.flatnonzero(excess + extra <= self.most)
                masks = table[extra][syndrome[rows[able]]]
                at, column = np.nonzero(masks >= 0)
                at_row = able[at]
                words = lead[rows[at_row]] ^ masks[at, column]
                anchor = anchors[at_row] << (block.n - block.check_bits) | words
                parts.append((rows[at_row], anchor, excess[at_row] + extra))
            rows, anchors, excess = (np.concatenate(x) for x in zip(*parts, strict=True))
        return rows, anchors, excess


def forest(prints: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked fingerprints, by breadth-first search.

    A fingerprint is compared with those not reached yet, so a dense group costs little more than its size.
    """
    edges: list[tuple[int, int]] = []
    left = prints
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.concatenate(
                [np.bitwise_count(left[i : i + COMPARE_BATCH] ^ x) <= threshold for i in range(0, len(left), COMPARE_BATCH)]
            )
            if near.any():
                reached = left[near]
                edges += [(int(x), int(y)) for y in reached]
                frontier += list(reached)
                left = left[~near]
    return edges


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "print"]
        )


def _replicas(threshold: int, batch_rows: int = 2048):
    far, near = threshold - threshold // 2, threshold // 2

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(far)
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            for i in range(0, len(prints), batch_rows):
                some = prints[i : i + batch_rows]
                row, anchor, excess = anchors.of(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(some.view(np.int64)[row]), pa.array(excess <= near)], ["anchor", "print", "near"]
                )

    return copies


def _compare(threshold: int):
    def edges_of(anchor: np.ndarray, prints: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
        """Edges inside runs of equal anchors that have a marked fingerprint."""
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        ends = np.concatenate((starts[1:], [len(anchor)]))
        marked = np.add.reduceat(near.astype(np.int64), starts) > 0
        size = ends - starts
        pairs = starts[(size == 2) & marked]
        close = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= threshold]
        edges = list(zip(prints[close].tolist(), prints[close + 1].tolist(), strict=True))
        for a, b in zip(starts[(size > 2) & marked].tolist(), ends[(size > 2) & marked].tolist(), strict=True):
            edges += forest(prints[a:b], threshold)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last anchor of a batch may go on in the next one."""
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()

        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, prints, near = (np.concatenate(x) for x in zip(*parts, strict=True))
            edges = {(min(e), max(e)) for e in edges_of(anchor, prints.view(np.uint64), near)} - seen
            if len(seen) < COMPARE_BATCH:
                seen.update(edges)
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*edges, strict=True) if edges else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            arrays = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "print", "near"))
            if not len(arrays[0]):
                continue
            last = int(np.searchsorted(arrays[0], arrays[0][-1]))
            if last == 0 and held and held[-1][0][-1] == arrays[0][0]:
                held.append(arrays)
                continue
            if last:
                yield found([*held, tuple(x[:last] for x in arrays)])
                held = []
            elif held:
                yield found(held)
                held = []
            held.append(tuple(x[last:] for x in arrays))
        if held:
            yield found(held)

    return run


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, print`` per row; the fingerprint is kept in a signed BIGINT."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, print long")


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges ``a, b`` that connect the fingerprints ``print`` (distinct) exactly as all links together do."""
    # The copies are some hundred times larger than the fingerprints, which would otherwise be read by a few tasks.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = prints.repartition(parts, "print").mapInArrow(_replicas(threshold), "anchor long, print long, near boolean")
    dealt = copies.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, print, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links lead to; NULL only if the whole component has none.
    """
    prints = cut(with_fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(prints.select("print").distinct(), threshold))
    labelled = nodes.join(labels, nodes["print"] == labels["node"], "left").select(
        "print", "first_id", F.coalesce("label", "print").alias("label")
    )
    labelled = cut(labelled, "labels")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.join(smallest, "label").select("print", "label", "component_id")
    return prints.join(by_print, "print").select("doc_id", "text_hash", "print", "label", "component_id")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row."""
    return classes(docs, threshold).select("doc_id", hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of every component, that with the smallest ``doc_id``, with all its columns."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("text_hash"))
    best = classes(docs, threshold).groupBy("label").agg(F.min(order).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k"), text_hash(F.col("text")).alias("h")
    )
    kept = rows.join(best, same_row((F.col("k"), F.col("h")), (F.col("best_id"), F.col("best_hash"))))
    copies = Window.partitionBy("k", "h").orderBy("h")  # rows that are repeated as a whole
    return kept.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("row.*")
