import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import toxicity


def test_the_pipeline_rejects_what_the_operator_predicts_toxic(spark, tmp_path, monkeypatch):
    n = 11
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": ["a"] * n, "lang": ["en"] * n, "source": ["web"] * n, "n_chars": [1] * n}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [0], "quality": [1], "toxic": [0]}), f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model: docs.withColumn("score", F.col("doc_id") / 10))
    predicted = {r.doc_id for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect() if r.predicted}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == set(range(n)) - predicted and 4 in predicted and 2 in kept
