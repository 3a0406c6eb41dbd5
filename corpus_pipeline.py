"""A corpus from raw documents to token ids: five stages, each by one operator of quillgraph.llm.

Every stage works on all that the one before kept, written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, near_dedup, pii, sentencepiece_codec, toxicity
from quillgraph.llm._table import checkpoint_folder, prepare, put_back, removed, set_aside, table


# In all stages null and empty texts are texts without findings and stay, rows that repeat are each decided alike, other
# columns pass through whatever their names, long texts are read whole, and an empty table gives an empty one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic; it is fitted on the labelled documents at hand.

    Labels of ids that aren't at hand, null ones and ids whose labels differ are passed over; without any, all stay.
    """
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.score(set_aside(docs), toxicity.fit(docs, labels))
    return put_back(scored.where(F.col("score") < toxicity.TOXIC), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more), that with the smallest doc_id.

    All rows of that doc_id stay; texts without words, and rows without a doc_id, are nobody's duplicates.
    """
    prepare(spark)
    return near_dedup.deduplicate(docs, 80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that are little else go as a whole. n_chars follows."""
    return with_length(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks. n_chars follows."""
    prepare(spark)
    return with_length(pii.mask_pii(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document; a null or empty text has no ids."""
    prepare(spark)
    out = sentencepiece_codec.encode(docs, sentencepiece_codec.default_model())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("pii", mask_personal_data),
    ("sentencepiece", tokenize),
]

#: The model of the first stage and the identifiers of the fourth aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared checkpoint folder and read again.

    A stage's folder goes once the next one is written; the last one, which the result reads, is the caller's to delete.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            removed(spark, before)
        before = out
    return docs
