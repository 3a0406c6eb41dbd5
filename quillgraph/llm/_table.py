"""Tables, checkpoints and union-find over links, as the operators of this subpackage need them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph._ship import ship


#: Rows and bytes of an Arrow batch: a Python worker holds a few of them, whatever the length of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors and bounds the session's Arrow batches; every query begins with it."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, after :func:`prepare`."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that setting is absent, as in tests on one machine, a folder of our own is made.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage,
#: which on larger inputs comes long after the disk is full; a plan has the setting that held when it was made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in spark.checkpoint.dir; what it shuffled is deleted."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Bits by which rows are told apart before they are shuffled: a million words at most, which each executor has.
BITS = 1 << 26


def perhaps(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` with a column perhaps: false only where doc_id isn't among those of ``ids``, of which there may be any number.

    An exact join of the rows where it is true follows; it needn't move the others, and their texts.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = ids.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    met = df.withColumn("place", place).withColumn("word", F.expr("place div 64")).join(F.broadcast(saved(words)), "word", "left")
    return met.withColumn("perhaps", F.expr("coalesce(getbit(bits, cast(place % 64 as int)) = 1, false)")).select(*df.columns, "perhaps")


def set_aside(df: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``df`` with every column but the needed ones under a number, so that none can clash with an operator's own."""
    return df.toDF(*_numbered(df.columns, needed))


def put_back(df: DataFrame, columns: list[str], results: tuple[str, ...] = (), needed: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns of the table before :func:`set_aside`, then the results; a column of a result's name is replaced."""
    kept = [(own, c) for own, c in zip(_numbered(columns, needed), columns, strict=True) if c.lower() not in {r.lower() for r in results}]
    return df.select(*(own for own, _ in kept), *results).toDF(*(c for _, c in kept), *results)


def _numbered(columns: list[str], needed: tuple[str, ...]) -> list[str]:
    return [c if c in needed else f"_{i}" for i, c in enumerate(columns)]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): rows of ``labels`` with 0 or 1 in ``column``, one a doc_id; one whose labels differ has none."""
    both = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most"))
    return both.where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of ``chosen``, which has one row a doc_id and is small: as many rows at most.

    Of rows that share a doc_id the text with the smallest hash is taken.
    """
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text")
    return one.join(F.broadcast(chosen), "doc_id")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches, by small-star/large-star rounds.

    Every round is a few grouped joins over the remaining edges, which never exceed the links given; a round
    about halves the longest path. Nodes without links aren't in the result. Raises if ``rounds`` don't suffice.
    """
    edges = saved(
        links.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # what a hub's neighbours need of it is kept as a table of one row a node: a join with it that meets a hub of many
        # rows can then be split by adaptive execution, which it can't behind an aggregate of the same key
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        following = saved(small.where("u <> v").distinct())
        # settled: every node has one edge, and no node is both an end and a centre
        ends = following.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(following.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        done = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
        edges = following
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
