"""Hard negatives by Strassen multiplication of integer tiles.

Vectors are rows of integer matrices. The matrix of anchors and that of candidates are cut into
blocks; a tile is the product of two blocks, taken by Strassen's seven products on halves padded
with zeros. Additions are exact, and as integers wrap at 64 bits the recursion cannot spoil a
score that fits. Each tile keeps a few best rows for each anchor, and what tiles keep is merged: first
the positives, which set a window of scores for each pair of anchor and positive, then the best
negatives of each window.

A task holds a group of candidate blocks and takes the anchor blocks one after the other. Blocks
reach it by one shuffle, in which candidates travel once and anchors once for each group; no block
is broadcast, so none passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.llm.common import NULL_ID, settle
from streamtables.operators.ranking import top_k

#: Rows in a block of anchors and in one of candidates.
ANCHORS, CANDIDATES = 512, 2048
#: Blocks of candidates that a task holds: at least, where there are shuffle partitions to spare, and at most.
LEAST, MOST = 4, 16
#: Halves of no more rows or columns than this are multiplied directly.
LEAF = 32
_EXACT_DOUBLES, _LONGS = 1 << 53, 1 << 63


def _largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A direct product; over doubles where these hold every sum exactly."""
    if a.dtype != object and _largest(a) * _largest(b) * a.shape[1] < _EXACT_DOUBLES:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product; for 64-bit integers modulo 2**64."""
    n, k, m = *a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return _product(a, b)
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    (a11, a12), (a21, a22) = (np.hsplit(x, 2) for x in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(x, 2) for x in np.vsplit(b, 2))
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    whole = np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])
    return whole[:n, :m]


class Block:
    """Ids, labels and vectors of some rows, ordered by label and id."""

    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, values: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self._values = np.frombuffer(values, f"<i{len(values) // (n * width) if n * width else 8}").reshape(n, width)

    @property
    def values(self) -> np.ndarray:
        return self._values.astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as hold all of them."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packed(ids: list, labels: list, vectors: list) -> tuple:
    width = max(map(len, vectors))
    values = np.zeros((len(ids), width), dtype="<i8")
    for row, vector in zip(values, vectors, strict=True):
        row[: len(vector)] = vector
    ids, labels = np.array(ids, dtype="<i8"), np.array(labels, dtype="<i8")
    order = np.lexsort((ids, labels))
    return len(ids), width, ids[order].tobytes(), labels[order].tobytes(), _narrow(values[order]).tobytes()


_BLOCK = "block int, n int, width int, ids binary, labels binary, values binary"
_FIELDS = ("n", "width", "ids", "labels", "values")


def _blocks(rows: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
    """Rows (``vec_id``, ``label``, ``vector``) dealt evenly to blocks of ``size``, and how many there are."""
    n = max(1, math.ceil(rows.count() / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            vectors += [v.values.to_numpy() for v in batch.column(2)]
        if ids:
            row = (TaskContext.get().partitionId(), *_packed(ids, labels, vectors))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", *_FIELDS])

    return settle(rows.repartition(n).mapInArrow(run, _BLOCK), label), n


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all rows, and which of them fit 64 bits."""
    k = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, k - x.shape[1]))) for x in (a, b))
    if _largest(a) * _largest(b) * k * 100 < _LONGS:
        scores = strassen(a, b.T)
        return scores, np.ones(scores.shape, dtype=bool)
    scores = strassen(a.astype(object), b.T.astype(object))
    return scores, ((scores < _LONGS) & (scores >= -_LONGS)).astype(bool)


def _first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest allowed scores in each row, of equal ones the smallest ids."""
    if not allowed.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if scores.dtype == object:
        low = min(scores[allowed].min(), 0) - 1
    else:
        low = np.iinfo(np.int64).min
    held = np.where(allowed, scores, low)
    if held.shape[1] > most:
        at = held.shape[1] - most
        least = (np.sort(held, axis=1) if held.dtype == object else np.partition(held, at, axis=1))[:, at]
        allowed = allowed & (held >= least[:, None]).astype(bool)
    row, column = np.nonzero(allowed)
    kept = held[row, column]
    order = np.lexsort((ids[column], -kept, row)) if kept.dtype != object else np.array(
        sorted(range(len(row)), key=lambda i: (row[i], -kept[i], ids[column[i]])), dtype=np.int64
    )
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], column[place < most]


def _tiles(
    anchors: DataFrame, candidates: DataFrame, n: int, schema: str, step: Callable[..., list[tuple]], most: int, *extra: str
) -> DataFrame:
    """``step`` of every tile: each block of anchors with each of the ``n`` blocks of candidates.

    Of what the tiles of a block of anchors and a group of candidates find, the first ``most`` rows
    for each pair of the first two columns of ``schema`` stay.
    """
    spare = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(math.ceil(n / MOST), min(spare, math.ceil(n / LEAST)))
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    held = candidates.select((F.col("block") % groups).alias("group"), F.lit(False).alias("asks"), "block", *_FIELDS, *nothing)
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "block", *_FIELDS, *extra
    )
    # The candidates of a group come first.
    dealt = held.unionByName(asking).repartitionById(groups, "group").sortWithinPartitions("group", "asks", "block")
    arrow = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block = Block(*(row[c] for c in _FIELDS))
                if row["group"] != group:
                    group, blocks = row["group"], []
                if not row["asks"]:
                    blocks.append(block)
                    continue
                columns = _merged([step(row["block"], block, c, *(row[c] for c in extra)) for c in blocks], most)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=arrow.names)

    return dealt.mapInArrow(run, schema)


def _joined(parts: list[tuple], width: int) -> list[np.ndarray]:
    if not parts:
        return [np.zeros(0, dtype=np.int64)] * width
    return [np.concatenate([np.asarray(x, dtype=np.int64) for x in column]) for column in zip(*parts, strict=True)]


def _merged(parts: list[list[np.ndarray]], most: int) -> list[np.ndarray]:
    """The ``most`` highest scores, of equal ones the smallest ids, for each pair of the first two of four columns; id and score are the others."""
    first, second, ids, scores = _joined(parts, 4)
    order = np.lexsort((ids, ~scores, second, first))
    first, second = first[order], second[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    kept = np.arange(len(order)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] < most
    return [first[kept], second[kept], ids[order][kept], scores[order][kept]]


_ROW_BITS = 20


def _anchor(block: int, row: np.ndarray) -> np.ndarray:
    """An anchor's own number, so that rows that repeat an id are anchors of their own."""
    return (np.int64(block) << _ROW_BITS) | row


def positives(anchors: DataFrame, candidates: DataFrame, n: int, most: int) -> DataFrame:
    """(``anchor``, ``anchor_id``, ``place``, ``positive_id``, ``positive_score``): the first other rows of the same label."""

    def step(block: int, a: Block, c: Block) -> list[np.ndarray]:
        parts = []
        for label in np.intersect1d(a.labels, c.labels):
            own, other = np.flatnonzero(a.labels == label), np.flatnonzero(c.labels == label)
            scores, fits = _scores(a.values[own], c.values[other])
            row, column = _first(scores, fits & (a.ids[own][:, None] != c.ids[other]), c.ids[other], most)
            parts.append((_anchor(block, own[row]), a.ids[own[row]], c.ids[other[column]], scores[row, column]))
        return _joined(parts, 4)

    schema = "anchor long, anchor_id long, positive_id long, positive_score long"
    found = _tiles(anchors, candidates, n, schema, step, most)
    return top_k(found, ["anchor"], [F.col("positive_score").desc(), F.col("positive_id").asc()], most, "place")


def negatives(anchors: DataFrame, wanted: DataFrame, candidates: DataFrame, n: int, most: int, window: tuple[int, int]) -> DataFrame:
    """(``anchor``, ``place``, ``rank``, ``negative_id``, ``negative_score``): the first rows of other labels in each window."""
    low, high = window
    entry = F.struct(F.col("anchor").alias("a"), F.col("place").alias("p"), F.col("positive_score").alias("s"))
    block = F.shiftright("anchor", _ROW_BITS).cast("int").alias("block")
    # A block has no more pairs than anchors times positives. Blocks can be far larger than their files, so they are not to be broadcast.
    asked = anchors.hint("merge").join(wanted.groupBy(block).agg(F.collect_list(entry).alias("pairs")), "block")

    def step(_: int, a: Block, c: Block, pairs: list[dict]) -> list[np.ndarray]:
        scores, fits = _scores(a.values, c.values)
        fits &= a.labels[:, None] != c.labels
        parts = []
        for place in sorted({p["p"] for p in pairs}):
            some = [p for p in pairs if p["p"] == place]
            anchor = np.array([p["a"] for p in some], dtype=np.int64)
            row = anchor & ((1 << _ROW_BITS) - 1)
            bounds = np.array([(-(-low * p["s"] // 100), high * p["s"] // 100) for p in some], dtype=object)
            if scores.dtype != object:  # then bounds fit too
                bounds = bounds.astype(np.int64)
            own = scores[row]
            within = fits[row] & ((own >= bounds[:, :1]) & (own <= bounds[:, 1:])).astype(bool)
            found, column = _first(own, within, c.ids, most)
            parts.append((anchor[found], np.full(len(found), place), c.ids[column], own[found, column]))
        return _joined(parts, 4)

    found = _tiles(asked, candidates, n, "anchor long, place long, negative_id long, negative_score long", step, most, "pairs")
    return top_k(found, ["anchor", "place"], [F.col("negative_score").desc(), F.col("negative_id").asc()], most, "rank")


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows with ``vector`` as integers, floor(``scale`` times each component).

    Rows with a null label, a null vector, or a component that is null, not finite or beyond 64
    bits once scaled are left out.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float(_LONGS), F.lit(False)) & ~F.isnan(x))
    kept = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(usable)
    return kept.withColumn(vector, F.transform(scaled, lambda x: F.floor(x).cast("long")))


def mine(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95)
) -> DataFrame:
    """The hardest negatives of each anchor and positive.

    ``rows`` and ``anchors`` have ``vec_id``, ``label`` (long) and ``vector`` (array<long>). A
    score is the inner product of two vectors, the shorter one filled up with zeros; a pair whose
    score does not fit 64 bits has none. Higher scores come first, ties by smaller ``vec_id``. An
    anchor's positives are its first ``n_positives`` other rows of the same label; rows that share
    its ``vec_id`` are not other rows. For each of them come the first ``n_negatives`` rows of
    other labels with a score between the percentages ``window`` of the positive's score.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and
    ``negative_score``. A null ``vec_id`` is the smallest. Anchors that repeat a ``vec_id`` have
    results of their own.
    """
    columns = [F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col("label").cast("long"), "vector"]
    a_blocks, _ = _blocks(anchors.select(*columns), ANCHORS, "anchor-blocks")
    c_blocks, n = _blocks(rows.select(*columns), CANDIDATES, "candidate-blocks")
    pairs = settle(positives(a_blocks, c_blocks, n, n_positives), "positives")
    found = negatives(a_blocks, pairs, c_blocks, n, n_negatives, window)
    return found.join(pairs.hint("merge"), ["anchor", "place"]).select(
        F.nullif("anchor_id", F.lit(NULL_ID)).alias("anchor_id"),
        F.nullif("positive_id", F.lit(NULL_ID)).alias("positive_id"),
        F.col("rank").cast("int"),
        F.nullif("negative_id", F.lit(NULL_ID)).alias("negative_id"),
        "positive_score",
        "negative_score",
    )
