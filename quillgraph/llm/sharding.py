"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Documents are put in ascending order of doc_id (ties by the text's CRC-32, then by place in the input) by a
range partitioning of narrow rows; each partition's row count and bytes go to the driver (two numbers a
partition), whose running sums give every partition its global offset. A row's shard is the target interval
in which its first byte falls, so shards are contiguous, in order, and equal up to one document.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm._table import saved, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (null text: 1), text_crc32 the CRC-32 of those bytes (null: 0). slot
    counts from 0 in each shard, without gaps. Rows with the same doc_id and text are interchangeable; a null
    doc_id sorts first. An empty table gives an empty result; with fewer rows than shards some shards are empty.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "text_crc32", "place"]
    # kept, so that partition numbers and totals speak of the same partitions even after an executor is lost
    ranged = saved(narrow.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    totals = {r.part: (r.n, r.b) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    parts = sorted(totals)
    rows_before = list(accumulate((totals[p][0] for p in parts), initial=0))
    bytes_before = list(accumulate((totals[p][1] for p in parts), initial=0))
    total = max(1, bytes_before[-1])
    offsets = spark.createDataFrame([(p, rows_before[i], bytes_before[i]) for i, p in enumerate(parts)], "part int, rows_before long, bytes_before long")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(offsets), "part")  # one row a partition
        .withColumn("row", F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        .withColumn("begin", F.col("bytes_before") + F.sum("size").over(within) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(begin * {shards} div {total} as int)"))
        .select("doc_id", "size", "text_crc32", "row", "shard")
    )
    placed = saved(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op3_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
