"""Fingerprints and likeness against a slow version, and what likeness tells of edits of texts of all lengths."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import fingerprints as fp
from quillgraph.llm._text import mix

MASK = (1 << 64) - 1


def slow_features(text, ranks):
    """Hashes of the features of one text in order of place, by the words of the module's description."""
    number, scale = (0, fp.LONG) if len(text) >= fp.SHORT else (1, fp.FINE)
    w, nb = scale.window, scale.neighbours
    if len(text) < w:
        return [int.from_bytes(hashlib.sha256(text).digest()[:8], "little")] if text else []
    clog = lambda c: round(c * math.log2(c) * 65536)
    keys = []
    for p in range(len(text) - w + 1):
        total = sum(clog(c) for c in Counter(text[p : p + w]).values())
        keys.append((ranks[number][fp.BINS - 1 - total * (fp.BINS - 1) // clog(w)], p))
    if len(keys) < nb:
        chosen = [min(keys)[1]]
    else:
        around = len(keys) - nb + 1
        points = Counter(min(keys[p : p + nb])[1] for p in range(around))
        enough = min(scale.points, around // 2 + 1, max(points.values()))
        chosen = sorted(p for p, n in points.items() if n >= enough)
    raw = [sum(int(fp._BYTE[text[p + j]]) * int(fp._PLACE[j]) for j in range(w)) & MASK for p in chosen]
    return [int(x) for x in mix(np.array(raw, np.uint64))]


def slow_filters(features):
    own, out = list(dict.fromkeys(features)), []
    for lo in range(0, len(own), fp.PER_FILTER):
        out.append({f >> 11 * k & fp.BITS - 1 for f in own[lo : lo + fp.PER_FILTER] for k in range(fp.HASHES)})
    return out


def slow_likeness(x, y):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    if len(x) > len(y):
        x, y = y, x

    def score(a, b):
        chance = len(a) * len(b) / fp.BITS
        return min(1.0, max(0.0, (len(a & b) - chance) / max(min(len(a), len(b)) - chance, 1e-9)))

    return sum(max(score(a, b) for b in y) for a in x) / len(x)


def bits(digest):
    return [set(np.flatnonzero(np.unpackbits(np.frombuffer(digest[lo : lo + 256], np.uint8))).tolist()) for lo in range(0, len(digest), 256)]


def prose(rng, n):
    words = ["".join(rng.choice(list("etaoinshrdlucmé"), rng.integers(1, 10))) for _ in range(2000)]
    return " ".join(words[int(k)] for k in rng.integers(0, 2000, n))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(n)) for n in np.exp(rng.uniform(0, 7.5, 150))] + ["", "x", "a" * 700, "ab" * 40, "0123456789a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = fp.learn_ranks(docs)
    return texts, ranks, {r.doc_id: r for r in fp.compare_with_next(docs, ranks).collect()}


def test_ranks_count_all_windows(table):
    texts, ranks, _ = table
    for number, scale in ((0, fp.LONG), (1, fp.FINE)):
        counts = np.zeros(fp.BINS, np.int64)
        for t in texts:
            raw = t.encode()
            if (len(raw) >= fp.SHORT) == (number == 0):
                counts += np.bincount(fp.entropy_bins(np.frombuffer(raw, np.uint8), scale.window), minlength=fp.BINS)
        assert np.array_equal(fp.rarity(counts), ranks[number])
        order = np.argsort(ranks[number])
        high = [b for b in order if b >= fp.LEAST_ENTROPY * fp.BINS]
        assert list(order[: len(high)]) == sorted(high, key=lambda b: (counts[b], b))


def test_fingerprints_and_likeness_against_a_slow_version(table):
    texts, ranks, out = table
    slow = [slow_filters(slow_features(t.encode(), ranks)) for t in texts]
    for i, t in enumerate(texts):
        assert bits(base64.b64decode(out[i].fingerprint)) == slow[i], t[:80]
        n = texts[(i + 1) % len(texts)]
        edited = slow_filters(slow_features((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode(), ranks))
        assert bits(base64.b64decode(out[i].edited_fingerprint)) == edited
        assert out[i].near_edited == pytest.approx(slow_likeness(slow[i], edited))
        assert out[i].near_next == pytest.approx(slow_likeness(slow[i], slow[(i + 1) % len(texts)]))


@pytest.mark.parametrize(("low", "high"), [(40, 100), (100, 200), (200, 500), (600, 1200), (1200, 6000)])
def test_an_edited_text_is_nearer_than_another(spark, low, high):
    rng = np.random.default_rng(low)
    texts = [prose(rng, high)[: int(n)] for n in rng.integers(low, high, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fp.compare_with_next(docs, fp.learn_ranks(docs)).collect()
    nearer = np.mean([r.near_edited > r.near_next for r in rows])
    assert nearer >= (0.9 if low < 100 else 0.97), nearer
    assert np.mean([r.near_edited for r in rows]) > 0.3 and np.mean([r.near_next for r in rows]) < 0.1


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_null_text_and_repeated_ids(spark, kind):
    ids = [None, None, 3, 3, 3, 12, 12, 20] * 8
    texts = [f"text {k % 11} of some length {k % 5}" if k % 7 else None for k in range(len(ids))]
    rows = [(None if i is None else str(i) if kind == "string" else i, t) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as part", "3 as guest", "4 as h")
    out = fp.compare_with_next(docs, fp.learn_ranks(docs), per_part=2)
    assert out.schema["doc_id"] == docs.schema["doc_id"]
    got = out.collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    # the order is by doc_id, a null one first, then by the text's hash
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", hashes[r[1]]) if kind == "string" else (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
