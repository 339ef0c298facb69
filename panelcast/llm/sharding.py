"""Shards along a Hilbert curve over document metadata. DataFrame functions only.

Source, language and size are quantised to BITS bits each and mixed into an index on the Hilbert curve, so rows that
are close in all three lie close on the curve. The table is ordered by index and cut into runs: each shard covers a
small box of metadata, which file statistics can prune in any of the dimensions.

Law: ``rows``. Shard sizes in rows differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import small_or_not, staged

SHARDS = 40
BITS = 8
#: Rows of one cell of the curve are ranked in so many parts, so that a hot cell is not one task.
SALTS = 64
_COARSE_BITS = 12


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with integer coordinates of ``bits`` bits each.

    Walks from the highest bit down. At each bit a coordinate with the bit set reflects the first axis below it; one
    without it swaps the lower bits of the first axis and its own. A Gray code over the axes, a last reflection by
    the bits of the last axis, and interleaving give the index.
    """
    n = len(axes)
    point = F.array(*[a.cast("int") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turned(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.get(x, s["i"])
        is_set = own.bitwiseAND(s["q"]) != 0
        swap = x[0].bitwiseXOR(own).bitwiseAND(low)
        first = F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
        return F.array(*[F.when(~is_set & (s["i"] == k), own.bitwiseXOR(swap)).otherwise(x[k]) if k else first for k in range(n)])

    point = F.aggregate(steps, point, turned)
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)),
        point,
        lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v)),
    )
    last = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
        F.struct(gray.alias("x"), F.lit(0).alias("t")),
        lambda s, q: F.struct(s["x"].alias("x"), F.when(F.get(s["x"], F.lit(n - 1)).bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t")),
        lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(s["t"])),
    )
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda x, s: F.call_function("shiftright", F.get(x, s["i"]), s["b"]).bitwiseAND(F.lit(1))
    whole = F.aggregate(
        order,
        F.struct(last.alias("x"), F.lit(0).cast("long").alias("h")),
        lambda a, s: F.struct(a["x"].alias("x"), (a["h"] * 2 + bit(a["x"], s)).alias("h")),
        lambda a: a["h"],
    )
    return whole


def _places(docs: DataFrame, column: str) -> DataFrame:
    """Each value of a label column with its place in code-point order, scaled to the curve's side; null is last."""
    values = docs.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n")).drop("n")
    place = F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1
    total = F.count("*").over(Window.partitionBy())
    values = values.withColumn(f"{column}_place", F.floor(place * (1 << BITS) / total).cast("int"))
    return staged(values.withColumn(f"{column}_key", F.coalesce(F.concat(F.lit("="), column), F.lit("null"))).drop(column), column)


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of ``docs(doc_id, text, lang, source, ...)``.

    Returns doc_id, size (UTF-8 bytes of the text, null as none, plus 16), text_crc32, curve (the Hilbert index),
    law, shard, slot (gapless from 0 in a shard) and grown_shard (null: the law is not ``key``). Null lang and source
    are values of their own, placed last. Rows of one cell of the curve are ordered by a hash of doc_id and
    then by doc_id, checksum and size; rows equal in all of them are interchangeable. Other columns are not read; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null")).alias("lang_key"),
    )
    for column in ("source", "lang"):
        rows = rows.join(small_or_not(_places(docs, column)), f"{column}_key")
    extent = F.least(F.floor(F.log2(F.col("size").cast("double")) * 8), F.lit((1 << BITS) - 1))
    rows = rows.withColumn("curve", hilbert_index([F.col("source_place"), F.col("lang_place"), extent], BITS))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = staged(rows.select("doc_id", "size", "text_crc32", "curve", "salt"), "curve")

    cells = rows.groupBy("curve", "salt").agg(F.count("*").alias("n")).withColumn("coarse", F.shiftright("curve", 3 * BITS - _COARSE_BITS))
    cells = staged(cells, "cells")
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = cells.groupBy("coarse").agg(F.sum("n").alias("n"))  # 2 ** _COARSE_BITS rows at most
    total = coarse.agg(F.sum("n")).first()[0] or 0
    coarse = coarse.select("coarse", F.coalesce(F.sum("n").over(ahead(["coarse"])), F.lit(0)).alias("coarse_start"))
    inside = F.coalesce(F.sum("n").over(ahead("coarse", ["curve", "salt"])), F.lit(0))
    starts = cells.withColumn("inside", inside).join(coarse, "coarse").select("curve", "salt", (F.col("coarse_start") + F.col("inside")).alias("start"))

    own = F.row_number().over(Window.partitionBy("curve", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("own", own).join(starts, ["curve", "salt"]).withColumn("rank", F.col("start") + F.col("own"))
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} AS int)"))
    first = F.expr(f"(cast(shard AS bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes ``docs`` as Parquet, one folder per shard, rows in curve order. Needs unique, non-null doc_id."""
    placed = staged(assign_shards(docs, shards).select("doc_id", "shard", "slot"), "shards")
    docs.join(placed, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
