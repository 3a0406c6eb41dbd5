"""What iterative operators share: reliable checkpoints, and global positions without a single-partition sort."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only where that is unset, on one machine, one of ours.

    Checkpoints go with their DataFrames where spark.cleaner.referenceTracking.cleanCheckpoints is set, else they are the
    caller's to delete.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir", None) or (None if set_.isEmpty() else set_.get())
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if set_.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], column: str, first: int = 0) -> DataFrame:
    """``df`` with the global position of each row in ``order``: ranges, a count for each, and positions within them."""
    spark = df.sparkSession
    ranged = saved(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    before = list(accumulate((n for _, n in counts), initial=first))
    offsets = spark.createDataFrame([(p, before[i]) for i, (p, _) in enumerate(counts)], "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + within - 1).drop("_part", "_before")
