"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is a vector of dense rates, encoded by a tanh layer; gated
attention, tanh(V h) times sigmoid(U h), weighs the passages, and the label's probability is read from the weighted
representation. All weights are learned together from document labels, by Adam on a bounded sample of bags; executors
hold the few thousand numbers that result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import labelled_texts, one_label, put_back, set_aside, table
from quillgraph.llm._text import SPACED, Words, blocks, mix
from quillgraph.llm.toxicity import held_out

PASSAGE = 64
#: Labelled rows that the model is fitted on, at most; each with all of its passages.
MAX_ROWS = 8_000
HIDDEN, ATTENTION = 16, 8
N_RATES = 16


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of each passage, and the len+1 offsets of each text's passages. A text without words is one passage of zeros."""
    words = Words(data, at, SPACED)
    n = np.maximum(1, -(-words.count // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(doc)) - bounds[doc]
    lo = words.first[doc] + step * PASSAGE
    hi = np.minimum(lo + PASSAGE, words.first[doc + 1])
    some = hi > lo
    start = np.concatenate([words.start, [0]])
    end = np.concatenate([words.end, [0]])
    a = np.where(some, start[np.minimum(lo, len(words))], 0)
    b = np.where(some, end[np.maximum(hi, 1) - 1], 0)
    size, count = np.maximum(1, b - a).astype(float), np.maximum(1, hi - lo).astype(float)

    def rate(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[b] - total[a]) / size

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[hi] - total[lo]) / count

    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    usual = np.isin(data, np.frombuffer(b".,", np.uint8))
    length = (words.end - words.start).astype(np.int64)
    repeated = np.zeros(len(words), bool)
    if len(words):
        repeated[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    # distinct words of each passage: first of equal (passage, word) after sorting
    passage_of_word = np.repeat(np.arange(len(doc)), hi - lo)
    tags = np.sort(passage_of_word.astype(np.uint64) << np.uint64(40) | mix(words.hash) >> np.uint64(24))
    fresh = np.concatenate([[True], tags[1:] != tags[:-1]]) if len(tags) else np.zeros(0, bool)
    distinct = np.bincount((tags[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(doc)) / count
    last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    first = data[words.start] if len(words) else np.zeros(0, np.uint8)
    x = np.stack(
        [
            rate(upper), rate(digit), rate(sign & ~usual), rate(usual), rate(data >= 128), rate(data == 10), rate((data == 33) | (data == 63)), rate(data == 124),
            share(length) / 10, share(length * length) / 100, share(length == 1), share(repeated), distinct, share(np.isin(last, np.frombuffer(b".!?", np.uint8))), share((first >= 65) & (first <= 90)), count / PASSAGE,
        ],
        axis=1,
    )
    x[~some] = 0
    return x, bounds


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def _forward(self, x: np.ndarray, bounds: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        s = np.exp(s - np.maximum.reduceat(s, bounds[:-1])[bag])
        alpha = s / np.add.reduceat(s, bounds[:-1])[bag]
        z = np.add.reduceat(alpha[:, None] * h, bounds[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(bounds) - 1, self.prior)
        return self._forward((x - self.mean) / self.scale, bounds, self.weights)["p"]

    def attention(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each passage's weight in its document."""
        return self._forward((x - self.mean) / self.scale, bounds, self.weights)["alpha"]

    def _gradients(self, f: dict[str, np.ndarray], y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        d = (f["p"] - y) / len(y)
        bag, h, alpha = f["bag"], f["h"], f["alpha"]
        dz = d[:, None] * w["c"]
        # through the softmax: how much more than the bag's mean a passage's encoding would help
        gain = (h * dz[bag]).sum(1)
        ds = alpha * (gain - (f["z"] * dz).sum(1)[bag])
        dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = alpha[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
        de = dh * (1 - h**2)
        return {"c": f["z"].T @ d, "d": np.array(d.sum()), "a": (f["t"] * f["g"]).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "E": f["x"].T @ de, "e": de.sum(0)}

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> AttentionModel:
        prior = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return cls(np.zeros(N_RATES), np.ones(N_RATES), {}, prior)
        every = np.concatenate(bags)
        model = cls(every.mean(0), every.std(0) + 1e-3, {}, prior)
        scaled = [(b - model.mean) / model.scale for b in bags]
        rng = np.random.default_rng(3)
        w = {"E": rng.normal(0, 0.3, (N_RATES, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.array(np.log(prior / (1 - prior)))}
        m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                part = [scaled[i] for i in order[lo : lo + batch]]
                bounds = np.concatenate([[0], np.cumsum([len(b) for b in part])])
                g = model._gradients(model._forward(np.concatenate(part), bounds, w), y[order[lo : lo + batch]], w)
                t += 1
                for k in w:
                    step = g[k] + decay * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * step
                    v[k] = 0.999 * v[k] + 0.001 * step**2
                    w[k] = w[k] - rate * (0.1 ** (epoch / epochs)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        model.weights = w
        return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in blocks(batch.column(0)):
            x, bounds = passages(data, at)
            rows = [x[a:b].astype(np.float64).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in (1, 2)), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AttentionModel:
    """Fits on at most ``max_rows`` rows of ``labels`` (doc_id, quality 0 or 1), those with the smallest hash of doc_id.

    Null labels and ids, and labels of texts that are missing, are passed over, and so is a doc_id whose labels differ;
    equal ones count once. Of rows that share a doc_id one is taken, with all its passages. Without labelled texts, or
    with a single class, every document gets the share of label 1 (0.5 without any).
    """
    chosen = one_label(labels, "quality").orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_rows)
    of = labelled_texts(docs, chosen).select("text", "doc_id", "label")
    rows = of.mapInArrow(_bags, T.StructType([of.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])).collect()
    rows.sort(key=lambda r: (str(r.doc_id), len(r.x), r.x))
    return AttentionModel.fit([np.frombuffer(r.x, np.float64).reshape(-1, N_RATES) for r in rows], np.array([r.label for r in rows], float))


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AttentionModel = held.value
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "score"]
            scores = [model.score(*passages(data, at)) for _, _, data, at in blocks(batch.column(batch.schema.names.index("text")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in kept), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*kept, "score"])

    return run


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``docs`` with score, 0 to 1, from the whole text alone; a column of that name is replaced, all others stay.

    A null text counts as empty, and an empty one is a single passage of zeros. Equal texts have equal scores, rows that
    repeat each have theirs. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    of = set_aside(docs)
    return put_back(of.mapInArrow(_scorer(held), T.StructType([*of.schema.fields, T.StructField("score", T.DoubleType())])), docs.columns, ("score",))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
