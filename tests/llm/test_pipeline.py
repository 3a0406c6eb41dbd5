"""The corpus pipeline, stage by stage, against plain Python, and as a whole."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillgraph.llm import sentencepiece_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "which river flows through the old town of lower marsh and past nine mills"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(31)
    fine, foul = [f"word{k}" for k in range(300)], ["idiot", "trash", "hate", "vile", "scum"]
    texts, toxic = [], []
    for k in range(240):
        y = k % 4 == 0
        # lengths, marks and capitals of all kinds in both classes, so that only the words tell them apart
        ends, calls = (str(rng.choice(["", ".", "!", " a@b.", " 10.1", "?!", " Or. So, it", " You."])) for _ in range(2))
        n = int(rng.integers(2, 60))
        texts.append(" ".join(rng.choice(fine, n)) + ends + (" " + " ".join(rng.choice(foul, 4 + n // 3)) if y else "") + calls)
        toxic.append(int(y))
    texts += [texts[1], texts[1] + " tail", f"Start. {ITEM} End of it all, with some more words than that one had, and more.", "write to a.b@example.org or 10.0.0.1 now", "", None]
    pq.write_table(
        pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": [len(t or "") for t in texts]}), f"{at}/documents.parquet"
    )
    pq.write_table(pa.table({"doc_id": list(range(240)), "quality": [1] * 240, "toxic": toxic}), f"{at}/labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [ITEM.upper()]}), f"{at}/benchmark.parquet")
    return at, texts, toxic


def test_every_stage_takes_effect(spark, folder):
    at, texts, toxic = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(at))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
        out.write.parquet(f"{at}/stage-{name}")
        docs = spark.read.parquet(f"{at}/stage-{name}")
        after[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(len(texts)) if i >= 240 or not toxic[i]}
    assert set(after["toxicity"]) == clean
    # 240 is a copy of 1, 241 nearly one; nothing else is alike
    assert set(after["near_duplicates"]) == clean - {240, 241}
    cut = after["benchmark_decontamination"]
    assert set(cut) == clean - {240, 241}
    assert {i for i in cut if cut[i].text != texts[i]} == {242} and "river" not in cut[242].text and "Start." in cut[242].text
    masked = after["pii"]
    assert {i for i in masked if masked[i].text != cut[i].text} == {243} and masked[243].text == "write to <EMAIL> or <IP> now"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.values())
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    coded = after["sentencepiece"]
    assert set(coded) == set(masked)
    for i, r in coded.items():
        assert list(r.ids or []) == theirs.encode(masked[i].text or ""), i
        assert r.n_tokens in (len(r.ids or []), None if r.ids is None else len(r.ids))
    whole = {r.doc_id: list(r.ids or []) for r in corpus_pipeline.run(spark, str(at)).collect()}
    assert whole == {i: list(r.ids or []) for i, r in coded.items()}


def test_an_empty_table(spark, folder, tmp_path):
    at, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{at}/{name}.parquet").slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_decontamination", "pii", "sentencepiece"]
    assert all(re.fullmatch("[a-z_]+", n) for n, _ in corpus_pipeline.STAGES)
