import numpy as np

from quillgraph.llm import fingerprints


def test_texts_without_a_rarest_window_still_have_fingerprints():
    # with any ranks, some of these texts have no window of 16 points
    rng = np.random.default_rng(31)
    rank = np.stack([np.arange(fingerprints.BINS)] * 2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(127, 200, 400)]
    for ranks in (rank, rank[:, ::-1].copy(), np.zeros_like(rank)):
        prints = fingerprints._digests(texts, ranks)
        assert all(prints)
        assert fingerprints._digests([b""], ranks) == [b""]
        assert max(fingerprints.likeness(a, b) for a, b in zip(prints[:-1], prints[1:], strict=True)) < 1


def test_real_texts_all_have_features(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ranks = fingerprints.learn_ranks(docs)
    texts = [r.text.encode() for r in docs.collect() if r.text]
    assert all(fingerprints._digests(texts, ranks))
