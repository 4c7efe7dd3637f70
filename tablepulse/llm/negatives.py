"""Hard negatives by slot-decomposed selection.

The rows whose ``vec_id`` is divisible by ``ANCHOR_EVERY`` are anchors, a stated query set, and every row is scored
against every anchor by the integer inner product of ``floor(256 x)``; higher scores come first, ties by smaller
``vec_id``. An anchor's positives are its first ``POSITIVES`` other rows of its label. A positive of score p admits the
negatives n with 50 p <= 100 n <= 95 p, and the windows of one anchor overlap.

Slots. The upper limits of an anchor's positives split the scores into disjoint slots: a slot ends at one limit and
begins above the next lower one. One pass keeps the first ``NEGATIVES`` rows of every slot; that combines, so tasks
keep no more than that of what they see and Spark merges it. The first rows below a limit are the first of the slots from
there down, so merging a slot into all that begin above it answers every window, and the lower limit cuts the merged list.
A slot does not keep scores below the lower limits of all its windows.

At scale. Vectors are packed once, as small integers where they fit. Groups of anchors that fit in a worker and groups of
rows form a grid, and each of its cells is a task: it holds its anchors and what they have kept, and rows stream by in
blocks. Positives score rows of the anchor's label only and negatives the others, so all pairs are scored about once. Products
are of 32-bit floats where norms show that these are exact. A strip of products is only looked at further for anchors whose
largest score in it reaches the least they have kept. Groups are dealt by the number of a block, so no label, value or repeated
row makes one of them large. Work grows with the number of pairs, the square of the rows.

Rows with a NULL label, a NULL vector, or any NULL or non-finite component take no part. A missing ``vec_id`` is no
anchor, keeps its label, and comes last among ties. Repeated rows are rows of their own, of which one may be the other's
positive. Vectors of different lengths are never compared; an empty vector scores zero. A window whose positive has a
negative score is empty. Scores beyond 64 bits stop at the largest number there is. Empty tables, and anchors without
positives or negatives, give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut

ANCHOR_EVERY = 50
FLIP_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
BLOCK_ROWS = 4096
SCORES_AT_ONCE = 1 << 20
# A group of anchors, with what it keeps; the rows of a cell; the pairs of a cell, and of one that is worth a task.
ANCHOR_BYTES = 96 << 20
CELL_BYTES = 256 << 20
CELL_PAIRS = 1 << 37
TASK_PAIRS = 1 << 27
_TILE_ROWS = 1024
_FIRST_ROWS = _STRIP = 256
_MANY = 16  # a tile with more than this part of its scores to look at
_MERGED_AT_ONCE = 1 << 18
_KEPT_BYTES = 512
_ANCHORS, _LIMITS, _ROWS = 0, 1, 2
_EXACT = float(1 << 53)
_PIECE_BITS, _ROW_BITS = 24, 16  # of a row's number, below the input partition's
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = (
    "side int, part int, piece int, dim int, n int, wide boolean, first long, "
    "row array<long>, vec_id array<long>, label array<long>, v binary"
)
_OF_ROWS = ("row", "label", "missing", "ids", "v", "norm")
_FOUND = "anchor long, anchor_id long, slot int, row long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of the rows that have a label and a vector, whose components may still be missing."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    flipped = F.when(vec_id % FLIP_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    x = F.col("embedding")
    x = x if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else x.cast("array<double>")
    given = vectors.select(vec_id.alias("vec_id"), flipped.alias("label"), x.alias("x"))
    return given.where(F.col("label").isNotNull() & F.col("x").isNotNull())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows that take part, and once more of the anchors among them, by vector length."""
    part, piece = TaskContext.get().partitionId(), 0
    largest = float(np.finfo(np.float64).max)
    for batch in batches:
        ids, label, x = batch.column("vec_id"), batch.column("label").to_numpy(), batch.column("x")
        dim = x.value_lengths().to_numpy().astype(np.int64)
        v, ends = x.flatten().fill_null(math.nan).to_numpy().astype(np.float64), np.cumsum(dim)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(v))))
        fine = np.flatnonzero(bad[ends] == bad[ends - dim])
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.clip(np.floor(v * SCALE), -largest, largest)
        asked = ids.fill_null(1).to_numpy() % ANCHOR_EVERY == 0
        for at in range(0, len(fine), BLOCK_ROWS):
            here = fine[at : at + BLOCK_ROWS]
            row = (((part << _PIECE_BITS) + piece) << _ROW_BITS) + np.arange(len(here))
            for d in np.unique(dim[here]):
                own = np.flatnonzero(dim[here] == d)
                for side, some in ((_ROWS, own), (_ANCHORS, own[asked[here[own]]])):
                    if len(some):
                        index = here[some]
                        values = v[(ends - dim)[index][:, None] + np.arange(d)]
                        yield _block(side, part, piece, row[some], ids.take(pa.array(index)), label[index], values)
            piece += 1


def _block(side: int, part: int, piece: int, row: np.ndarray, ids: pa.Array, label: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    wide = bool(np.abs(v).max(initial=0) > np.iinfo(np.int16).max)
    values = [side, part, piece, v.shape[1], len(row), wide, pc.min(ids).as_py()]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), pa.array(x, pa.int64())) for x in (row, ids, label)]
    kinds = [*[pa.int32()] * 5, pa.bool_(), pa.int64()]
    columns = [*(pa.array([x], kind) for x, kind in zip(values, kinds, strict=True)), *lists]
    packed = pa.array([v.astype(np.float64 if wide else np.int16).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, packed], [c.split()[0] for c in _BLOCK.split(", ")])


def _grid(blocks: DataFrame) -> tuple[int, int]:
    """Into how many groups anchors and rows are dealt."""
    width = F.col("dim") * F.when(F.col("wide"), 8).otherwise(2)
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0))
    n = F.col("n").cast("long")
    anchors, anchor_bytes, rows, row_bytes, most = blocks.agg(
        of(_ANCHORS, n), of(_ANCHORS, n * (width + _KEPT_BYTES)), of(_ROWS, n), of(_ROWS, n * (width + 24)), of(_ROWS, F.lit(1))
    ).first()
    a = max(1, -(-anchor_bytes // ANCHOR_BYTES))
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    cells = max(min(3 * cores, anchors * rows // TASK_PAIRS), anchors * rows // CELL_PAIRS)
    return a, max(1, min(most, max(-(-cells // a), -(-row_bytes // CELL_BYTES))))


def _cells(blocks: DataFrame, grid: tuple[int, int], *limits: DataFrame) -> DataFrame:
    """Every group of anchors with its limits, and then every group of rows in the order of ties, cell by cell."""
    a, b = grid
    number = F.col("part").cast("long") + F.col("piece")

    def dealt(side: DataFrame, own: int, own_step: int, others: int, step: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        cells = side.withColumn("other", each).withColumn("cell", (F.pmod(number, F.lit(own)) * own_step + F.col("other") * step).cast("int"))
        return cells.drop("other", "part", "piece")

    sides = dealt(blocks.where(F.col("side") == _ANCHORS), a, b, b, 1).unionByName(dealt(blocks.where(F.col("side") == _ROWS), b, 1, a, b))
    for x in limits:
        sides = sides.unionByName(dealt(x, a, b, b, 1), allowMissingColumns=True)
    return sides.repartitionById(a * b, "cell").sortWithinPartitions("cell", "side", F.asc_nulls_last("first"))


def scores(a: np.ndarray, b: np.ndarray, most: float = math.inf, into: np.ndarray | None = None) -> np.ndarray:
    """Inner products of whole numbers, exact: floats where ``most``, which no partial sum exceeds, shows that these are; else
    int64, stopped at its ends. 32-bit floats are put ``into`` memory that is there, since new memory costs as much as half of
    the products."""
    if most < float(1 << 24):
        out = None if into is None or len(into) < len(a) * len(b) else into[: len(a) * len(b)].reshape(len(a), len(b))
        return np.matmul(a.astype(np.float32, copy=False), b.astype(np.float32, copy=False).T, out=out)
    if most < _EXACT:
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    found = whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.array([[min(max(int(x), -_MOST), _MOST) for x in row] for row in found], np.int64).reshape(len(a), len(b))


def _ranked(score: np.ndarray, tied: np.ndarray, n: int) -> np.ndarray:
    """Doubles that order as (score, earlier in ``tied``), whose places are below ``n``."""
    if score.dtype != np.float32 and np.abs(score[score > _least(score)].astype(np.float64)).max(initial=0) * n >= _EXACT / 2:
        score = np.unique(score, return_inverse=True)[1].reshape(score.shape)
    return score.astype(np.float64) * n + (n - 1 - tied)


def _least(score: np.ndarray) -> float:
    """What stands for no score."""
    return _LEAST if score.dtype == np.int64 else -math.inf


def _strips(score: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A tile as rows of strips of ``_STRIP`` columns, then what is left of it; and where in the tile they begin."""
    even = score.shape[1] // _STRIP * _STRIP
    if even:
        yield score[:, :even].reshape(len(score), -1, _STRIP), 0
    if even < score.shape[1]:
        yield score[:, even:][:, None], even


class _Block:
    """Rows of one length of vectors."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.dim, n = batch.column("dim")[i].as_py(), batch.column("n")[i].as_py()
        self.row, self.label = (batch.column(c)[i].values.to_numpy() for c in ("row", "label"))
        ids = batch.column("vec_id")[i].values
        self.missing, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        kind = np.float64 if batch.column("wide")[i].as_py() else np.int16
        self.v = np.frombuffer(batch.column("v")[i].as_buffer(), kind).reshape(n, self.dim) if self.dim else np.zeros((n, 0), np.int16)
        whole = self.v.astype(np.float64)
        with np.errstate(over="ignore"):
            self.norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", whole, whole)) * (1 + 1e-9), 1)


def _joined(blocks: list[_Block], index: np.ndarray | None, *names: str) -> list[np.ndarray]:
    found = (np.concatenate([getattr(x, name) for x in blocks]) for name in names)
    return [x if index is None else x[index] for x in found]


def _order(key: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """By key, falling score and the order of ties. Key and score are one number where they fit; then only ties need more."""
    high, low = int(score.max()), int(score.min())
    if (int(key.max()) + 1) * (high - low + 1) > _MOST:
        return np.lexsort((row, ids, missing, -score, key))
    both = key * (high - low + 1) + (high - score)
    order = np.argsort(both)
    equal = both[order[1:]] == both[order[:-1]]
    tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
    some = order[tied]
    order[tied] = some[np.lexsort((row[some], ids[some], missing[some], both[some]))]
    return order


def _tile_rows() -> int:
    return min(_TILE_ROWS, SCORES_AT_ONCE)


def _chunks(label: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Stretches of about ``step`` sorted labels; a label with many of them shares none with others."""
    found, at = [], 0
    ends = [*np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)] if len(label) else []
    for begin, end in zip([0, *ends], ends, strict=False):
        if end - begin > step // 4:
            found += [(at, begin)] if at < begin else []
            found += [(x, min(x + step, end)) for x in range(begin, end, step)]
            at = end
        elif end - at >= step:
            found, at = [*found, (at, end)], end
    return [*found, (at, len(label))] if at < len(label) else found


class _Anchors:
    """Anchors of one length of vectors in the order of labels, and the first rows that each has kept in each of its slots."""

    def __init__(self, blocks: list[_Block], limits: dict[str, np.ndarray] | None):
        row, label = _joined(blocks, None, "row", "label")
        index = np.argsort(label, kind="stable")
        if limits is not None:
            index = index[np.isin(row[index], limits["anchor"])]
        self.row, self.label, self.ids, self.v, self.norm = _joined(blocks, index, "row", "label", "ids", "v", "norm")
        self.by_row = np.argsort(self.row)
        self.positives, self.k = limits is None, POSITIVES if limits is None else NEGATIVES
        if limits is None:
            self.upper, self.floor = np.full((len(index), 1), _MOST), np.full((len(index), 1), -_MOST)
        else:
            self._set(**limits)
        self.slots = self.upper.shape[1]
        shape = (len(index) * self.slots, self.k)
        self.kept = {"score": np.full(shape, _LEAST), "missing": np.zeros(shape, bool), "ids": np.zeros(shape, np.int64), "row": np.zeros(shape, np.int64)}
        self.picked: list[tuple[np.ndarray, ...]] = []
        self.chunks, self.seen = _chunks(self.label, min(_TILE_ROWS, max(1, SCORES_AT_ONCE // _tile_rows()))), 0

    def find(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchor each row is, and whether it is one."""
        at = self.by_row[np.minimum(np.searchsorted(self.row, row, sorter=self.by_row), len(self.row) - 1)] if len(self.row) else np.zeros(len(row), int)
        return at, self.row[at] == row if len(self.row) else np.zeros(len(row), bool)

    def _set(self, anchor: np.ndarray, slot: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        at, here = self.find(anchor)
        at, slot = at[here], slot[here]
        shape = (len(self.row), int(slot.max(initial=-1)) + 2)
        self.upper, self.floor = np.full(shape, _LEAST), np.full(shape, _MOST)
        self.upper[at, slot] = upper[here]
        np.minimum.at(self.floor, (at, slot), lower[here])
        self.floor[:, :-1] = np.maximum(self.floor[:, :-1], self.upper[:, 1:] + 1)
        self.upper, self.floor = self.upper[:, :-1], self.floor[:, :-1]

    def least(self, start: int, end: int, first: tuple) -> np.ndarray:
        """The score from which a row of a block is to be looked at, per anchor and slot; ``first`` is the first of its ties."""
        score, missing, ids, row = (self.kept[c][start * self.slots : end * self.slots, -1] for c in ("score", "missing", "ids", "row"))
        later = (missing < first[0]) | (missing == first[0]) & ((ids < first[1]) | (ids == first[1]) & (row < first[2]))
        beaten = score + (later & (score > _LEAST) & (score < _MOST))
        return np.maximum(self.floor[start:end], beaten.reshape(-1, self.slots))

    def meet(self, blocks: list[_Block]) -> None:
        """Few rows come first, then as many as were seen before, so that most are held against rows that were kept."""
        rows = dict(zip(_OF_ROWS, _joined(blocks, None, *_OF_ROWS), strict=True))
        at, n = 0, len(rows["row"])
        while at < n:
            some = max(_FIRST_ROWS, self.seen)
            self._meet(**{c: x[at : at + some] for c, x in rows.items()})
            at += some
            self.seen += min(some, n - at + some)

    def _meet(self, row: np.ndarray, label: np.ndarray, missing: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        index = np.argsort(label, kind="stable")
        row, label, missing, ids, v, norm = (x[index] for x in (row, label, missing, ids, v, norm))
        ties = np.lexsort((row, ids, missing))
        tied = np.empty(len(ties), np.int64)
        tied[ties] = np.arange(len(ties))
        first = tuple(x[ties[0]] for x in (missing, ids, row))
        own, is_own = self.find(row) if self.positives else (np.zeros(len(row), int), np.zeros(len(row), bool))
        own_col = np.flatnonzero(is_own)
        own = own[own_col]
        floats, widest, cols = v.astype(np.float32) if v.dtype == np.int16 else v, norm.max(), _tile_rows()
        into = np.empty(max(e - s for s, e in self.chunks) * cols, np.float32)
        for start, end in self.chunks:
            mine = self.label[start:end]
            low, high = np.searchsorted(label, mine[0], "left"), np.searchsorted(label, mine[-1], "right")
            mixed = mine[0] != mine[-1]
            spans = [(low, high)] if self.positives else [(0, len(row))] if mixed else [(0, low), (high, len(row))]
            least = self.least(start, end, first)
            lowest, most = least.min(axis=1), self.norm[start:end].max() * widest
            some = self.v[start:end]
            some = some.astype(np.float32) if some.dtype == np.int16 else some
            for left, right in ((x, min(x + cols, to)) for from_, to in spans for x in range(from_, to, cols)):
                score = scores(some, floats[left:right], most, into)
                if mixed and max(left, low) < min(right, high):
                    same = mine[:, None] == label[max(left, low) : min(right, high)]
                    score[:, max(left, low) - left : min(right, high) - left][same != self.positives] = _least(score)
                for i in np.flatnonzero((own >= start) & (own < end) & (own_col >= left) & (own_col < right)):
                    score[own[i] - start, own_col[i] - left] = _least(score)
                for parts, at in _strips(score):
                    who, part = np.nonzero(parts.max(axis=2) >= lowest.astype(score.dtype)[:, None])
                    if len(who):
                        self._pick(start + who, parts[who, part], least[who], left + at + part * parts.shape[2], tied)
            if sum(len(x[0]) for x in self.picked) >= _MERGED_AT_ONCE:
                self._merge(row, missing, ids)
        self._merge(row, missing, ids)

    def _pick(self, anchor: np.ndarray, score: np.ndarray, least: np.ndarray, left: np.ndarray, tied: np.ndarray) -> None:
        """Rows of strips that reach what their slot has kept: all if they are few, else the first of every slot. ``left`` is
        where each strip begins in its block, and ``tied`` the order of ties in that."""
        at = np.flatnonzero(score >= least.min(axis=1).astype(score.dtype)[:, None])
        if len(at) > score.size // _MANY:
            self._pick_first(anchor, score, least, left, tied)
            return
        who, col = np.divmod(at, score.shape[1])
        value = score.ravel()[at].astype(np.int64)
        slot = (self.upper[anchor[who]] >= value[:, None]).sum(axis=1) - 1
        there = (slot >= 0) & (value >= least[who, slot])
        self.picked.append((anchor[who[there]] * self.slots + slot[there], value[there], (left[who] + col)[there]))

    def _pick_first(self, anchor: np.ndarray, score: np.ndarray, least: np.ndarray, left: np.ndarray, tied: np.ndarray) -> None:
        none = _least(score)
        who, slot = np.nonzero(score.max(axis=1)[:, None] >= least.astype(score.dtype))
        step = max(1, SCORES_AT_ONCE // score.shape[1])
        for at in range(0, len(who), step):
            w, s = who[at : at + step], slot[at : at + step]
            key, from_, begins = anchor[w] * self.slots + s, least[w, s].astype(score.dtype), left[w]
            here = score[w]
            here = np.where(here <= self.upper.reshape(-1)[key].astype(score.dtype)[:, None], here, score.dtype.type(none))
            there = here.max(axis=1) >= from_
            key, from_, begins, here = key[there], from_[there], begins[there], here[there]
            order = _ranked(here, tied[begins[:, None] + np.arange(here.shape[1])], len(tied))
            for _ in range(self.k):
                col, each = order.argmax(axis=1), np.arange(len(key))
                value = here[each, col]
                there = value >= from_
                if not there.all():
                    key, from_, begins, here, order, col, value = (x[there] for x in (key, from_, begins, here, order, col, value))
                if not len(key):
                    break
                self.picked.append((key, value.astype(np.int64), begins + col))
                each = each[: len(key)]
                here[each, col], order[each, col] = none, -math.inf

    def _merge(self, row: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """What was picked from a block goes to what slots have kept."""
        picked, self.picked = [x for x in self.picked if len(x[0])], []
        if not picked:
            return
        key, score, col = (np.concatenate([x[i] for x in picked]) for i in range(3))
        met = np.unique(key)
        full = self.kept["score"][met] > _LEAST
        key = np.concatenate((np.repeat(met, self.k)[full.ravel()], key))
        new = {"score": score, "missing": missing[col], "ids": ids[col], "row": row[col]}
        new = {c: np.concatenate((self.kept[c][met][full], x)) for c, x in new.items()}
        order = _order(key, **new)
        key = key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        stays = place < self.k
        for c, x in new.items():
            self.kept[c][key[stays], place[stays]] = x[order[stays]]

    def found(self) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for start in range(0, len(self.row), BLOCK_ROWS):
            kept = {c: x[start * self.slots : (start + BLOCK_ROWS) * self.slots] for c, x in self.kept.items()}
            key, place = np.nonzero(kept["score"] > _LEAST)
            score, missing, ids, row = (kept[c][key, place] for c in ("score", "missing", "ids", "row"))
            anchor, slot = start + key // self.slots, key % self.slots
            columns = [self.row[anchor], self.ids[anchor], slot.astype(np.int32), row]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, mask=missing), pa.array(score)], names)


class _Cell:
    """The anchors of a cell, and rows that wait until they make a block."""

    def __init__(self, positives: bool):
        self.positives, self.anchors, self.limits, self.waiting = positives, defaultdict(list), [], defaultdict(list)
        self.asked: dict[int, _Anchors] | None = None

    def add(self, batch: pa.RecordBatch, i: int) -> None:
        side = batch.column("side")[i].as_py()
        if side == _LIMITS:
            self.limits.append(batch.column("limits")[i].values)
        elif side == _ANCHORS:
            block = _Block(batch, i)
            self.anchors[block.dim].append(block)
        else:
            if self.asked is None:
                self.asked = self._ready()
            if (dim := batch.column("dim")[i].as_py()) in self.asked:
                waiting = self.waiting[dim]
                waiting.append(_Block(batch, i))
                if sum(len(x.row) for x in waiting) >= BLOCK_ROWS:
                    self.asked[dim].meet(self.waiting.pop(dim))

    def _ready(self) -> dict[int, _Anchors]:
        limits = None
        if not self.positives:
            if not self.limits:
                return {}
            limits = {c: np.concatenate([x.field(c).to_numpy() for x in self.limits]) for c in ("anchor", "slot", "upper", "lower")}
        anchors = {dim: _Anchors(self.anchors.pop(dim), limits) for dim in list(self.anchors)}
        self.limits = []
        return {dim: x for dim, x in anchors.items() if len(x.row)}

    def found(self) -> Iterator[pa.RecordBatch]:
        for dim, anchors in (self.asked or {}).items():
            if dim in self.waiting:
                anchors.meet(self.waiting.pop(dim))
            yield from anchors.found()


def _kept(batches: Iterator[pa.RecordBatch], positives: bool) -> Iterator[pa.RecordBatch]:
    number, cell = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            at = batch.column("cell")[i].as_py()
            if cell is None or at != number:
                if cell is not None:
                    yield from cell.found()
                number, cell = at, _Cell(positives)
            cell.add(batch, i)
    if cell is not None:
        yield from cell.found()


def _best(found: DataFrame, k: int, *group: str) -> DataFrame:
    """The first ``k`` rows per group; the filter on the rank also cuts what every task sends."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _limits(windows: DataFrame) -> DataFrame:
    """The limits of every anchor's slots, as a side of the cells."""
    block = F.shiftright("anchor", _ROW_BITS)
    limits = windows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("anchor", "slot", "upper", "lower")).alias("limits"))
    part, piece = F.shiftright("block", _PIECE_BITS), F.col("block").bitwiseAND((1 << _PIECE_BITS) - 1)
    return limits.select(F.lit(_LIMITS).alias("side"), part.cast("int").alias("part"), piece.cast("int").alias("piece"), "limits")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: every anchor's and positive's negatives."""
    blocks = cut(usable(vectors).mapInArrow(_packed, _BLOCK), "vectors")
    grid = _grid(blocks)
    found = _cells(blocks, grid).mapInArrow(lambda batches: _kept(batches, True), _FOUND)
    positives = cut(_best(found, POSITIVES, "anchor").select("anchor", "anchor_id", "vec_id", "score"), "positives")

    upper = F.expr("(score div 100) * 95 + ((score % 100) * 95) div 100")  # floor(95 score / 100), without overflow
    lower = F.expr("score div 2 + score % 2")  # ceil(score / 2)
    slot = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("upper"))) - 1
    windows = positives.where("score >= 0").withColumns({"upper": upper, "lower": lower})  # that of a negative score is empty
    windows = windows.withColumn("slot", slot)
    found = _cells(blocks, grid, _limits(windows)).mapInArrow(lambda batches: _kept(batches, False), _FOUND)
    slots = _best(found, NEGATIVES, "anchor", "slot").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("slot", "place", F.col("vec_id").alias("id"), "score"))).alias("slots")
    )

    # Slots are listed from the highest down, so this list is the merge of all from the window's own slot on.
    merged = F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("slot")), 1, NEGATIVES)
    mined = windows.join(slots, "anchor").select("anchor_id", F.col("vec_id").alias("positive_id"), "lower", F.col("score").alias("positive_score"), F.posexplode(merged))
    return mined.where(F.col("col.score") >= F.col("lower")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("negative_id"),
        "positive_score", F.col("col.score").alias("negative_score"),
    )
