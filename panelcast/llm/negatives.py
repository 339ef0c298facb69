"""Hard-negative mining by Strassen products of integer tiles.

Anchors are dealt into tiles and all rows into groups of bounded size; a task gets one tile and one group and multiplies
them block by block, by Strassen's recursion on int64 with zero padding. Heaps in the task keep an anchor's best
positives, in a second pass the best negatives of each positive's window, and heaps of all groups are merged by rank.
Nothing but tiles, groups and heaps is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import Scratch

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 30, 90
EVERY = 100
#: Anchors of a tile and rows of a group, on average, and rows multiplied at once.
TILE, GROUP, BLOCK = 1024, 8192, 1024
#: Products with a side of at most so many are multiplied directly.
LEAF = 16
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices. Sums wrap around, so any product that fits 64 bits is exact."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    c = np.zeros((2 * h, 2 * j), np.int64)
    c11, c12, c21, c22 = c[:h, :j], c[:h, j:], c[h:, :j], c[h:, j:]
    for left, right, plus, minus in (
        (a11 + a22, b11 + b22, (c11, c22), ()),
        (a21 + a22, b11, (c21,), (c22,)),
        (a11, b12 - b22, (c12, c22), ()),
        (a22, b21 - b11, (c11, c21), ()),
        (a11 + a12, b22, (c12,), (c11,)),
        (a21 - a11, b11 + b12, (c22,), ()),
        (a12 - a22, b21 + b22, (c11,), ()),
    ):
        product = strassen(left, right)
        for part in plus:
            part += product
        for part in minus:
            part -= product
    return c[:m, :n]


def quantised(lists: pa.ListArray) -> np.ndarray:
    """floor(256 x) of every component as a matrix; shorter vectors are filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(256.0 * flat), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class Heaps:
    """For each of n rows the k best of what is offered: higher scores first, earlier offers among equals."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.score, self.item = (np.zeros(0, np.int64) for _ in range(3))
        self.full = np.zeros(n, bool)
        self.least = np.zeros(n, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, items: np.ndarray) -> None:
        """``scores[i, j]`` of ``items[j]`` for row ``rows[i]``, where allowed. Items come in the order of ties."""
        allowed = allowed & (~self.full[rows][:, None] | (scores > self.least[rows][:, None]))
        if np.count_nonzero(allowed) > 4 * self.k * len(rows) and scores.shape[1] > self.k:
            held = np.where(allowed, scores, np.iinfo(np.int64).min)
            place = held.shape[1] - self.k
            allowed &= held >= np.partition(held, place, axis=1)[:, place : place + 1]
        i, j = np.nonzero(allowed)
        if len(i):
            row, score, item = np.concatenate([self.row, rows[i]]), np.concatenate([self.score, scores[i, j]]), np.concatenate([self.item, items[j]])
            order = np.lexsort((item, ~score, row))
            row, score, item = row[order], score[order], item[order]
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            rank = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            keep = rank < self.k
            self.row, self.score, self.item = row[keep], score[keep], item[keep]
            last = rank == self.k - 1
            self.full[row[last]] = True
            self.least[row[last]] = score[last]


class _Cell:
    """A tile of anchors and a group of rows; rows by id, nulls last."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        ids = rows.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], rows.column("label").to_numpy()[order]
        self.anchor_ids, self.anchor_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        a, b = (quantised(x.column("embedding").combine_chunks()) for x in (anchors, rows))
        width = max(a.shape[1], b.shape[1])
        self.a, self.b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b[order]))

    def blocks(self):
        """(places of the rows, scores of all anchors with them)"""
        for k in range(0, len(self.b), BLOCK):
            at = np.arange(k, min(k + BLOCK, len(self.b)))
            yield at, strassen(self.a, np.ascontiguousarray(self.b[at].T))

    def id_column(self, items: np.ndarray) -> pa.Array:
        return pa.array(self.ids[items], pa.int64(), mask=self.ids[items] == _NO_ID)


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    cell = _Cell(anchors, rows)
    heaps, every = Heaps(len(cell.a), POSITIVES), np.arange(len(cell.a))
    for at, scores in cell.blocks():
        heaps.offer(every, scores, (cell.labels[at] == cell.anchor_labels[:, None]) & (cell.ids[at] != cell.anchor_ids[:, None]), at)
    return pa.table({"anchor": anchors.column("anchor").to_numpy()[heaps.row], "positive_id": cell.id_column(heaps.item), "positive_score": heaps.score})


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    cell = _Cell(anchors, rows)
    found = anchors.column("positives").to_pylist()
    # whole scores s with LOW p <= 100 s <= HIGH p, by integers of any size
    windows = [[(-(-LOW * p["positive_score"] // 100), HIGH * p["positive_score"] // 100) for p in x] for x in found]
    heaps = Heaps(len(cell.a) * POSITIVES, NEGATIVES)
    of = [np.array([i for i, w in enumerate(windows) if len(w) > k and w[k][0] <= w[k][1]], np.int64) for k in range(POSITIVES)]
    bounds = [np.array([windows[i][k] for i in of[k]], np.int64).reshape(-1, 2) for k in range(POSITIVES)]
    for at, scores in cell.blocks():
        other = cell.labels[at] != cell.anchor_labels[:, None]
        for k in range(POSITIVES):
            own, low, high = scores[of[k]], bounds[k][:, :1], bounds[k][:, 1:]
            heaps.offer(of[k] * POSITIVES + k, own, other[of[k]] & (own >= low) & (own <= high), at)
    anchor, k = np.divmod(heaps.row, POSITIVES)
    chosen = [found[i][j] for i, j in zip(anchor.tolist(), k.tolist(), strict=True)]
    return pa.table({
        "anchor": anchors.column("anchor").to_numpy()[anchor], "k": k, "anchor_id": cell.anchor_ids[anchor], "positive_id": pa.array([p["positive_id"] for p in chosen], pa.int64()),
        "positive_score": pa.array([p["positive_score"] for p in chosen], pa.int64()), "negative_id": cell.id_column(heaps.item), "negative_score": heaps.score,
    })


def _odd(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))


def _each(tiles: int, groups: int, anchors: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on every tile of anchors with every group of rows."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = left.num_rows and right.num_rows
        return work(left, right) if kept else work(left.slice(0, 0), right.slice(0, 0))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("tile", F.pmod(F.xxhash64("anchor"), F.lit(tiles)).cast("int")).withColumn("group", every(groups))
    right = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")).withColumn("tile", every(tiles))
    return left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group")).applyInArrow(cell, schema)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Negatives of every anchor and positive in ``embeddings(vec_id, embedding, label)``: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A row with the anchor's own
    vec_id is never its positive; each of several anchor rows with one vec_id has rows of its own, other repeated rows
    count each. A null vec_id comes after all others (2^63 - 1 counts as null). Of vectors of different length the
    shorter are filled with zeros; components beyond 64 bits are held at their limit and scores beyond wrap around.
    Other columns are not read; without rows or anchors the result is empty.
    """
    scratch = Scratch(embeddings.sparkSession)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", _odd))
    anchors = scratch.staged(rows.filter(F.col("vec_id") % EVERY == 0).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    tiles, groups = -(-max(1, anchors.count()) // TILE), -(-max(1, embeddings.count()) // GROUP)

    found = _each(tiles, groups, anchors, rows, _positives, "anchor long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    best = found.withColumn("place", place).filter(F.col("place") <= POSITIVES)
    positives = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    windows = scratch.staged(anchors.join(positives, "anchor"), "windows")
    scratch.drop(anchors)

    schema = "anchor long, k long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _each(tiles, groups, windows, rows, _negatives, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""
WITH used AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM used a JOIN used c ON a.vec_id % {EVERY} = 0 AND a.vec_id IS DISTINCT FROM c.vec_id
), positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k
  FROM scored WHERE same QUALIFY k <= {POSITIVES}
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
