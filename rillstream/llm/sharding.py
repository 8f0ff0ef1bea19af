"""Contiguous shards of nearly equal bytes, cut from a global prefix sum of sizes.

Rows are ordered by id. A range partitioning gives every partition a contiguous stretch of that order; only the ids,
sizes and check sums move, never the texts. The partitions' totals (one small row each) give every partition
its global offset, and a running sum inside the partition gives every row its own. The total divided by the number of
shards is the target; a row belongs to the shard in whose stretch its first byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of (id, size, check sum) that one range partition should hold.
ROWS_EACH = 500_000


def byte_shards(spark: SparkSession, df: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``<id_col>, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no bytes and the check sum of an
    empty one. Null ids come first in the order; rows of one id are ordered by check sum and size, and rows equal in all three get
    neighbouring slots. An empty table gives an empty table. Other columns are not read.
    """
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
    )
    rows = scratch.table(rows, "rows")
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_EACH))
    ranged = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "crc", "size").select("*", F.spark_partition_id().alias("part"))
    ranged = scratch.table(ranged, "ranged")  # the bounds are sampled: kept, so that no later read cuts them anew

    totals = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    # one row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("bytes_all"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "crc", "size", "tie")
    placed = (
        ranged.withColumn("tie", F.monotonically_increasing_id())
        .withColumn("row", F.row_number().over(inside) - 1)
        .withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(offsets), "part")
        .select("id", "size", "crc", (F.col("row") + F.col("rows_before")).alias("row"), F.expr(f"((bytes_before + start) * {shards}) div bytes_all").cast("int").alias("shard"))
    )
    placed = scratch.table(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder for each shard, in slot order. Ids must be unique."""
    both = df.join(placed.select(id_col, "shard", "slot"), id_col)
    both.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
