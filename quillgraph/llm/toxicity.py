"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words (whole words and word beginnings, learned from labelled
training texts, a few known insults first), nearness of second-person words to them, and rates of capitals, punctuation, digits, repeats and
obfuscation (letters written as digits or signs, or parted by signs). All are computed from the text's bytes for a
whole batch at once. A bounded sample of labelled rows is split by document in folds: each fold's features come
from the others' lexicon, and its margins for the calibration from trees fitted on the others; the model itself has
the lexicon and trees of all. It is a few arrays that every executor holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import labelled_texts, one_label, put_back, saved, set_aside, table
from quillgraph.llm._text import _POW, ALNUM, WordClass, Words, blocks, mix

#: Texts with a calibrated probability of this or more are predicted toxic, and rejected by the pipeline.
TOXIC = 0.3
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
#: Toxic texts that a lexicon's word stands in, at least, and how much likelier it is in them than in clean ones. All such
#: words of the bounded sample are in the lexicon.
SUPPORT, LIFT = 3, 5.0
#: Parts of the sample, of which each is measured by what the others teach.
FOLDS = 5
PREFIXES = (4, 6)
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus su vosotros".split()
#: Insults that the lexicon of whole words begins with; the rest is learned.
SEEDS = "idiot idiots idiotic moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile jerk ugly freak vermin filth dummkopf arschloch abschaum crétin imbécile connard ordure estúpido basura escoria".split()
#: Digits and signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SIGNS = b"\"#%&'()*+,-./:;<=>?[\\]^_`{|}~"
#: Words between white space without signs, look-alikes read as letters
_DISGUISED = WordClass(bytes([*range(0x00, 0x21), 0x7F]), {ord(a): ord(b) for a, b in LOOKALIKE.items()})


def _word_hash(word: str) -> int:
    raw = word.lower().encode()
    return int(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hash[0])


_SEEDS = np.array([_word_hash(w) for w in SEEDS], np.uint64)
_YOU = np.array(sorted(_word_hash(w) for w in SECOND_PERSON), np.uint64)


def _prefix_hashes(words: Words, k: int) -> np.ndarray:
    """Hashes of the first k bytes of words of more than k bytes (0 for the rest)."""
    out = np.zeros(len(words), np.uint64)
    long = np.flatnonzero(words.end - words.start > k)
    total = np.zeros(len(long), np.uint64)
    for j in range(k):
        total += words.kind.value[words.data[words.start[long] + j]] * _POW[j]
    out[long] = mix(total + np.uint64(k))
    return out


def _inside(sorted_hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(x), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, x), len(sorted_hashes) - 1)] == x


_TERM_KINDS = 1 + len(PREFIXES)


def _terms(words: Words) -> list[np.ndarray]:
    return [words.hash, *(_prefix_hashes(words, k) for k in PREFIXES)]


N_FEATURES = 18


def features(data: np.ndarray, at: np.ndarray, lexicon: list[np.ndarray]) -> np.ndarray:
    """One row of dense features for each text; zeros for an empty one."""
    n = len(at) - 1
    size = np.maximum(1, np.diff(at)).astype(float)
    words = Words(data, at, ALNUM)
    count = np.maximum(1, words.count).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    def per_word(flags: np.ndarray, w: Words = words) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(float)

    terms = _terms(words)
    hits = [_inside(lexicon[k], terms[k]) for k in range(_TERM_KINDS)]
    anyhit = np.logical_or.reduce(hits)
    you = _inside(_YOU, words.hash)
    # words since the last, and to the next, second-person word of the same text
    place = np.arange(len(words))
    last = np.maximum.accumulate(np.where(you, place, -1)) if len(words) else place
    following = np.minimum.accumulate(np.where(you, place, len(words) + 1000)[::-1])[::-1] if len(words) else place
    near = np.full(len(words), 1000)
    if len(words):
        back = (last >= 0) & (words.doc[np.maximum(last, 0)] == words.doc)
        near = np.where(back, place - last, near)
        ahead = (following < len(words)) & (words.doc[np.minimum(following, len(words) - 1)] == words.doc)
        near = np.minimum(near, np.where(ahead, following - place, 1000))
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    same[at[:-1][at[:-1] < len(data)]] = False  # a text's first byte follows none
    letters = np.maximum(1, per_text(upper | lower))
    # the text without signs, look-alikes read as letters
    plain = np.isin(data, np.frombuffer(_SIGNS, np.uint8), invert=True)
    moved = np.concatenate([[0], np.cumsum(plain)])
    disguised = Words(data[plain], moved[at], _DISGUISED)
    seen = [_inside(lexicon[k], h) for k, h in enumerate(_terms(disguised))]
    hidden = np.maximum(0, per_word(np.logical_or.reduce(seen), disguised) - per_word(anyhit))
    inner_digit = np.zeros(len(data), bool)
    if len(data) > 2:
        inner_digit[1:-1] = (digit | sign)[1:-1] & (lower | upper)[:-2] & (lower | upper)[2:]
        ends = np.concatenate([at[:-1], at[1:] - 1])
        inner_digit[ends[(ends >= 0) & (ends < len(data))]] = False
    total_hits = per_word(anyhit)
    out = np.stack(
        [
            *(np.log1p(per_word(h)) for h in hits),
            *(per_word(h) / count for h in hits),
            np.log1p(total_hits),
            per_word(anyhit & (near <= 3)),
            per_word(anyhit & (near <= 10)) / np.maximum(1, total_hits),
            per_word(you) / count,
            per_text(upper) / letters,
            per_text(sign) / size,
            per_text((data == 33) | (data == 63)) / size,
            per_text(digit) / size,
            per_text(same) / size,
            per_text(inner_digit) / count,
            np.log1p(hidden),
            np.log1p(words.count),
        ],
        axis=1,
    )
    assert out.shape == (n, N_FEATURES)
    return out


@dataclass
class Trees:
    """Boosted trees of one depth over binned features: splits (feature, bin) by node in heap order, and leaf values."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, s, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (b[rows, f[node]] > s[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, n_bins: int = 48, l2: float = 2.0, least: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), n_bins, np.int64), np.zeros((rounds, 2**depth)), float(np.log(mean / (1 - mean))))
    b, margin, rows = model.bins(x), np.full(len(x), model.base), np.arange(len(x))
    width = n_bins + 1
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for j in range(x.shape[1]):
                key = (node - first) * width + b[:, j]
                gs = np.bincount(key, g, n * width).reshape(n, width)
                hs = np.bincount(key, h, n * width).reshape(n, width)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least * 0.1) | (ht - hl < least * 0.1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                model.feature[r, first : first + n][better] = j
                model.split[r, first : first + n][better] = k[better]
            node = 2 * node + 1 + (b[rows, model.feature[r, node]] > model.split[r, node])
        at = node - (2**depth - 1)
        model.leaf[r] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        margin += model.leaf[r][at]
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block ends (ascending scores) and their levels, each smoothed by one row of the mean."""
    order = np.argsort(score, kind="stable")
    ends: list[float] = []
    sums: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        if ends and ends[-1] == s:
            sums[-1][0] += v
            sums[-1][1] += 1
        else:
            ends.append(float(s))
            sums.append([float(v), 1.0])
        while len(sums) > 1 and sums[-2][0] * sums[-1][1] >= sums[-1][0] * sums[-2][1]:
            v2, n2 = sums.pop()
            end = ends.pop()
            sums[-1][0] += v2
            sums[-1][1] += n2
            ends[-1] = end
    prior = float(y.mean()) if len(y) else 0.5
    return np.array(ends), np.array([(v + prior) / (n + 1) for v, n in sums])


@dataclass
class Toxicity:
    lexicon: list[np.ndarray]
    trees: Trees | None
    ends: np.ndarray
    levels: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(self.ends):
            return np.full(len(x), self.prior)
        margin = self.trees.margin(x)
        level = self.levels[np.minimum(np.searchsorted(self.ends, margin, "left"), len(self.ends) - 1)]
        # ranks rows within a level too, by a thousandth at most
        return np.clip(level * 0.999 + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, fold, term, toxic texts, clean texts) of each batch's texts, each term once a text."""
    for batch in batches:
        label, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lo, hi, data, at in blocks(batch.column(0)):
            words = Words(data, at, ALNUM)
            for kind, terms in enumerate(_terms(words)):
                for h in range(FOLDS):
                    mine = (terms != 0) & (fold[lo:hi][words.doc] == h)
                    pairs = np.unique(np.stack([words.doc.astype(np.uint64), terms], axis=1)[mine], axis=0)
                    if not len(pairs):
                        continue
                    found, at_term = np.unique(pairs[:, 1], return_inverse=True)
                    toxic = np.bincount(at_term, label[lo:hi][pairs[:, 0].astype(np.int64)], len(found)).astype(np.int64)
                    total = np.bincount(at_term, minlength=len(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), kind, np.int32)), pa.array(np.full(len(found), h, np.int64)), pa.array(found.view(np.int64)), pa.array(toxic), pa.array(total - toxic)],
                        ["kind", "fold", "term", "toxic", "clean"],
                    )


def _measure(held):
    """Features by the lexicon of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for lexicon_of, lexicon in enumerate(held.value):
                part = batch.filter(pa.array(fold == lexicon_of))
                for lo, hi, data, at in blocks(part.column(0)):
                    x = features(data, at, lexicon)
                    yield pa.RecordBatch.from_arrays([*(part.column(i)[lo:hi] for i in (1, 2)), pa.array(list(x), pa.list_(pa.float64()))], ["label", "fold", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Toxicity:
    """Fits on at most ``max_rows`` rows of ``labels`` (doc_id, toxic 0 or 1), those with the smallest hash of doc_id.

    Null labels and ids, and labels of texts that are missing, are passed over, and so is a doc_id whose labels differ;
    equal ones count once. Of rows that share a doc_id one is taken, so that the sample never exceeds ``max_rows`` texts.
    Without any row, or with a single class, the model gives every text the share of toxic rows (0 without rows).
    Columns other than doc_id, text and toxic don't matter.
    """
    spark = docs.sparkSession
    known = one_label(labels, "toxic")
    chosen = known.withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit("toxicity"))).orderBy("draw", "doc_id").limit(max_rows).select("doc_id", "label", F.pmod("draw", F.lit(FOLDS)).alias("fold"))
    sample = saved(labelled_texts(docs, chosen).select("text", "label", "fold"))
    counts = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sum(n for (_, label), n in counts.items() if label == 1) / max(1, sum(counts.values()))
    seen = saved(sample.mapInArrow(_label_counts, "kind int, fold long, term long, toxic long, clean long").groupBy("kind", "fold", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))

    def lexicon(folds: list[int]) -> list[np.ndarray]:
        toxic, clean = (sum(n for (h, label), n in counts.items() if h in folds and label == k) for k in (1, 0))
        lift = (F.col("toxic") + 0.5) * (max(1, clean) / max(1, toxic)) / (F.col("clean") + 0.5)
        terms = seen.where(F.col("fold").isin(*folds)).groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        rows = terms.where((F.col("toxic") >= SUPPORT) & (lift >= LIFT)).select("kind", "term").collect()  # words of max_rows texts
        found = [np.array([r.term for r in rows if r.kind == k], np.int64).view(np.uint64) for k in range(_TERM_KINDS)]
        return [np.unique(np.concatenate([found[0], _SEEDS])), *(np.sort(x) for x in found[1:])]

    held = spark.sparkContext.broadcast([lexicon([h for h in range(FOLDS) if h != f]) for f in range(FOLDS)])
    every = lexicon(list(range(FOLDS)))
    rows = sample.mapInArrow(_measure(held), "label int, fold long, x array<double>").collect()
    x = np.array([r.x for r in rows]).reshape(-1, N_FEATURES)
    y, fold = np.array([r.label for r in rows], float), np.array([r.fold for r in rows])
    order = np.lexsort((*x.T, y))  # the same model whatever order rows arrive in
    x, y, fold = x[order], y[order], fold[order]
    if any(len(np.unique(y[fold != h])) < 2 for h in range(FOLDS)):
        return Toxicity(every, None, np.zeros(0), np.zeros(0), prior)
    margin = np.empty(len(y))
    for h in range(FOLDS):
        margin[fold == h] = fit_trees(x[fold != h], y[fold != h]).margin(x[fold == h])
    ends, levels = fit_isotonic(margin, y)
    return Toxicity(every, fit_trees(x, y), ends, levels, prior)


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Toxicity = held.value
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            kept = [n for n in batch.schema.names if n != "score"]
            scores = [model.score(features(data, at, model.lexicon)) for _, _, data, at in blocks(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in kept), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*kept, "score"])

    return run


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with score, 0 to 1, from the whole text alone; a column of that name is replaced, all others stay.

    A null text counts as empty, and an empty one has the score of all-zero features. Equal texts have equal scores,
    rows that repeat each have theirs. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    of = set_aside(docs)
    return put_back(of.mapInArrow(_scorer(held), T.StructType([*of.schema.fields, T.StructField("score", T.DoubleType())])), docs.columns, ("score",))


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    out = score(docs, model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
