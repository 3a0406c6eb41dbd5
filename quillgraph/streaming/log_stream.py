"""A growing folder of JSON log files as a stream of changes, and counts kept up to date from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(op, id, label) of the log's lines as files appear; blank lines are passed over."""
    lines = spark.readStream.text(path).where("trim(value) <> ''")
    r = F.from_json("value", "op string, id bigint, node struct<id:bigint,label:string>, edge struct<id:bigint,label:string>")
    return lines.select(r.alias("r")).select("r.op", F.coalesce("r.node.id", "r.edge.id", "r.id").alias("id"), F.coalesce("r.node.label", "r.edge.label").alias("label"))


def counts(stream: DataFrame) -> DataFrame:
    """(op, label, n) so far, for output mode complete or update."""
    return stream.groupBy("op", "label").agg(F.count(F.lit(1)).alias("n"))
