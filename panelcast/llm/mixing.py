"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is put into a fixed pseudo-random order and cut into BLOCKS blocks. Its target asks for a number of whole
passes and a part of one more, which is a run of whole blocks and the head of one block. So a source has an exact quota
of block draws. A tree splits the quotas of all sources among the output shards: a node with the draws of ``n`` shards
gives its left child the share of its shards, sampled without replacement from all sources at once (multivariate
hypergeometric), down to the leaves. Then each shard draws its run of the source's permuted blocks, disjoint from all
other shards', and orders its rows by a hash: the local shuffle. What a row is drawn for follows from the shards' runs.

The tree and the targets hold a row per source in one task: 24 bytes and SHARDS numbers each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import small_or_not, staged, text_bytes

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_HEX = 3  # 16 ** 3 blocks a source
BLOCKS = 16**BLOCK_HEX
SHARDS = 16
SEED = "mix-1"
#: A shard's rows are written in 2 ** LANE_BITS runs by the first bits of their places, so no task holds a shard.
LANE_BITS = 6


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len(t.split()) for t in batch.column("text").to_pylist()], pa.int64())
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), sizes], names=[*kept, "size"])


def _ranked(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """doc_id, source, key (the source, null told apart), rank (a hash of the row, which orders its source) and text as bytes."""
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), text_bytes(docs)
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), key, F.md5(text)).cast("binary"))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), key.alias("key"), rank.alias("rank"), text.alias("text"), *more)


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, key, rank, size (words) of every row."""
    return _ranked(docs, seed).mapInArrow(_sized, "doc_id long, source string, key string, rank string, size long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to ``per_source(source, source_size)``, a table with a row per source.

    Water filling: in order of the weight that would fill it, a source is full (MOST_TIMES its size) as long as the
    rest's share reaches it; all others get their weight's part of what the full ones leave.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    known = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    known = known.withColumn("most", MOST_TIMES * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    known = known.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    known = known.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    known = known.withColumn("open", F.col("most") * F.col("left_weight") > F.col("left_size") * F.col("weight"))
    known = known.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "left_size", "left_weight"))).over(everything))
    share = F.col("level.left_size") * F.col("weight") / F.col("level.left_weight")
    return known.select("source", "source_size", "weight", F.when(F.col("open"), share).otherwise(F.col("most")).cast("double").alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: str) -> np.ndarray:
    """(source, shard) draws: each source's quota split among the shards, all shards within one draw of each other."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(lo: int, hi: int, have: np.ndarray, node: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([zlib.crc32(seed.encode()), node])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        split(lo, mid, left, 2 * node)
        split(mid, hi, have - left, 2 * node + 1)

    split(0, shards, np.asarray(quotas, np.int64), 1)
    return out


def _tree(shards: int, seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        order = np.argsort(t.column("place").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ends = np.cumsum(split_quotas(t.column("quota").to_numpy(), shards, seed), axis=1)
        yield pa.RecordBatch.from_arrays([t.column("place").chunk(0), pa.array(list(ends), pa.list_(pa.int64()))], names=["place", "ends"])

    return run


def _planned(docs: DataFrame, shards: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized rows; per source its target and the shards' runs of block draws (``ends``); and the ranks of the rows in the
    head of the block in which a source's last pass ends."""
    rows = staged(sized(docs, seed).withColumn("block", F.substring("rank", 1, BLOCK_HEX)), "sized")
    blocks = staged(rows.groupBy("source", "key", "block").agg(F.sum("size").alias("words")), "blocks")
    known = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    known = known.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    known = known.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    known = known.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    known = staged(known.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "targets")

    # the block in which the part of the last pass ends, and the words of it before that block
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(known.select("key", "rest"), "key")
    edge = running.filter("before <= rest").groupBy("key").agg(F.max(F.struct("block", "before")).alias("edge"))
    plan = known.join(edge, "key", "left")
    last = F.conv(F.col("edge.block"), 16, 10).cast("long")
    plan = plan.withColumn("quota", F.col("full") * BLOCKS + F.when(F.col("rest") > 0, last + 1).otherwise(0))
    ends = plan.select("place", "quota").coalesce(1).mapInArrow(_tree(shards, seed), "place int, ends array<long>")
    plan = plan.join(ends, "place").select("key", "source_size", "target", "full", "rest", F.col("edge.block").alias("edge"), F.col("edge.before").alias("edge_before"), "ends")
    plan = staged(plan, "plan")

    head = Window.partitionBy("key").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.join(small_or_not(plan.select("key", "rest", "edge", "edge_before")), "key").filter("block = edge AND rest > 0")
    cut = cut.withColumn("running", F.col("edge_before") + F.sum("size").over(head)).filter(F.col("running") - F.col("size") / 2 <= F.col("rest"))
    return rows, plan, staged(cut.select("rank").distinct(), "heads")


def _draws(seed: str) -> Column:
    """The draws of a row, given its rank, its source's plan and whether it is in the head: for every pass whose block lies in
    a shard's run, (pass, shard, place)."""
    index = F.conv(F.substring("rank", 1, BLOCK_HEX), 16, 10).cast("long")
    at_edge = lambda p: (F.col("rest") > 0) & (p == F.col("full")) & (F.substring("rank", 1, BLOCK_HEX) == F.col("edge"))
    in_run = lambda p: (p * BLOCKS + index < F.element_at("ends", -1)) & (~F.coalesce(at_edge(p), F.lit(False)) | F.col("head"))
    passes = F.filter(F.array(*[F.lit(p) for p in range(MOST_TIMES)]), in_run)
    shard = lambda p: F.size(F.filter("ends", lambda e: e <= p * BLOCKS + index))
    return F.transform(passes, lambda p: F.struct(p.alias("pass"), shard(p).alias("shard"), F.xxhash64(F.lit(seed), p, "rank").alias("place")))


def _with_draws(rows: DataFrame, plan: DataFrame, heads: DataFrame, seed: str) -> DataFrame:
    """``rows(key, rank, ..)`` with their source's plan and their draws; plan and heads are small, so the rows are not moved."""
    marked = rows.join(small_or_not(plan), "key").join(small_or_not(heads.withColumn("in_head", F.lit(True))), "rank", "left")
    return marked.withColumn("head", F.coalesce("in_head", F.lit(False))).withColumn("draws", _draws(seed))


def mix(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The mix of all rows of ``docs(doc_id, text, source, ...)``.

    Returns a row per row of ``docs``: doc_id, source, size, source_size, target and draws, an array with a
    struct (pass, shard, place) for every time that the mix takes the row; rows sorted by place within a shard are its
    shuffled content. A null source is a source of its own, the last; null, empty and blank texts have size 0; a
    source without words has target 0. Rows equal in doc_id, source and text are drawn alike and share their places; rows that
    only repeat a doc_id do not. Other columns are not read; an empty table gives an empty result. A source's taken
    words miss its target by half a document (and its equal rows) at most.
    """
    return _with_draws(*_planned(docs, shards, seed), seed).select("doc_id", "source", "size", "source_size", "target", "draws")


def draw(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to MOST_TIMES times), in the mix's order: a shard's rows lie in
    2 ** LANE_BITS runs, each of them sorted by place. The columns stay the same; null and repeated ids are rows like all others."""
    _, plan, heads = _planned(docs, shards, seed)
    rows = _ranked(docs, seed, F.struct(*docs.columns).alias("whole")).select("key", "rank", "whole")
    drawn = _with_draws(rows, plan, heads, seed).select("whole", F.explode("draws").alias("d")).select("whole", "d.shard", "d.place")
    lane = F.shiftrightunsigned("place", 64 - LANE_BITS)
    return drawn.repartition("shard", lane).sortWithinPartitions("shard", lane, "place").select("whole.*")


def source_targets(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size and target of every row: what the mix is held to, without the draws."""
    rows = sized(docs, SEED)
    due = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).select(F.col("source").alias("_source"), "source_size", "target")
    return rows.join(due, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target")


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::BIGINT AS left_size, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, most * left_weight > left_size * weight AS is_open FROM l),
f AS (SELECT left_size AS fs, left_weight AS fw FROM o WHERE is_open ORDER BY most / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_open THEN (fs * weight)::DOUBLE / fw ELSE most::DOUBLE END AS target FROM o LEFT JOIN f ON true)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
