import numpy as np

from quillgraph.llm import quality


def test_fitting_sees_every_passage(spark, monkeypatch):
    texts = [(i, " ".join(f"{'Wx'[i % 2]}{k}." for k in range(n)), i % 2) for i, n in enumerate([64 * 100, 64 * 65 + 1, 20_000, 10, 0])]
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", classmethod(lambda cls, bags, y: seen.append((bags, y))))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int"))
    bags, y = seen[0]
    assert [len(b) for b in bags] == [100, 66, 313, 1, 1] and list(y) == [0, 1, 0, 1, 0]
    raw = texts[0][1].encode()
    every, _ = quality.passages(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert np.array_equal(bags[0], every)
