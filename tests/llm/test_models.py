"""Features of both classifiers against plain Python, and how well they tell held-out documents apart."""

import math
import re

import numpy as np
import pytest

from quillgraph.llm import near_dedup, pii, quality, toxicity
from quillgraph.llm._text import ALNUM, Words

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def columns(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


WHOLE, FOUR, SIX = {"idiot", "vile", "schlimm", "é"}, {"tras", "hate"}, {"worthl"}


def lexicon():
    def prefix(p, k):
        raw = np.frombuffer((p + "x").encode(), np.uint8)
        return toxicity._prefix_hashes(Words(raw, np.array([0, len(raw)]), ALNUM), k)[0]

    return [np.sort(np.array([toxicity._word_hash(w) for w in WHOLE], np.uint64)), np.sort(np.array([prefix(p, 4) for p in FOUR], np.uint64)), np.sort(np.array([prefix(p, 6) for p in SIX], np.uint64))]


def kinds(word):
    raw = word.encode()
    return [word in WHOLE, len(raw) > 4 and raw[:4].decode(errors="replace") in FOUR, len(raw) > 6 and raw[:6].decode(errors="replace") in SIX]


def slow_features(t):
    raw, words = t.encode(), [low(w) for w in LETTERS.findall(t)]
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [[kinds(w)[k] for w in words] for k in range(3)]
    anyhit = [any(kinds(w)) for w in words]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = [min([abs(k - y) for y in you], default=1000) for k in range(len(words))]
    chars = [chr(b) for b in raw]
    upper, lower, digit = (sum(a <= c <= b for c in chars) for a, b in ("AZ", "az", "09"))
    sign = lambda c: "!" <= c <= "~" and not c.isalnum()
    letter = lambda c: c.isascii() and c.isalpha()
    plain = "".join(c for c in t if c.encode()[:1] not in [bytes([b]) for b in toxicity._SIGNS])
    plain = "".join(toxicity.LOOKALIKE.get(c, c) for c in plain)
    seen = sum(any(kinds(low(w))) for w in re.findall(r"[^\x00-\x20\x7F]+", plain))
    inner = sum((("0" <= b <= "9") or sign(b)) and letter(a) and letter(c) for a, b, c in zip(chars, chars[1:], chars[2:], strict=False))
    total = sum(anyhit)
    return [
        *(math.log1p(sum(h)) for h in hits), *(sum(h) / n for h in hits), math.log1p(total), sum(h and d <= 3 for h, d in zip(anyhit, near, strict=True)), sum(h and d <= 10 for h, d in zip(anyhit, near, strict=True)) / max(1, total),
        len(you) / n, upper / max(1, upper + lower), sum(map(sign, chars)) / size, sum(c in "!?" for c in chars) / size, digit / size, sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / size, inner / n,
        math.log1p(max(0, seen - total)), math.log1p(len(words)),
    ]


def scraps(seed, n=300):
    rng = np.random.default_rng(seed)
    parts = ["idiot", "IDIOT", "v.i.l.e", "1d10t", "trashy", "tras", "hates", "worthless", "w0rthless", "you", "Your", "du", "calm", "river", "é", "Über", "!!", "?", "...", "a1b", "77", " ", "\n", "aa", "$", "schlimm", "sch-limm"]
    return ["".join(str(x) + str(rng.choice(["", " ", " "])) for x in rng.choice(parts, rng.integers(0, 25))) for _ in range(n)] + ["", " ", "!", "a", "7"]


def test_toxicity_features_against_plain_python():
    texts = scraps(1)
    found = toxicity.features(*columns(texts), lexicon())
    for t, row in zip(texts, found, strict=True):
        assert row.tolist() == pytest.approx(slow_features(t)), t
        # a text's features don't depend on its neighbours
        assert row.tolist() == toxicity.features(*columns([t]), lexicon())[0].tolist(), t


def slow_passages(t):
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
    raw, out = t.encode(), []
    words = [raw[a:b] for a, b in spans]
    for lo in range(0, max(1, len(words)), quality.PASSAGE):
        own = words[lo : lo + quality.PASSAGE]
        if not own:
            return [[0.0] * quality.N_RATES]
        part = raw[spans[lo][0] : spans[lo + len(own) - 1][1]]
        count = lambda test: sum(map(test, part)) / len(part)
        share = lambda values: sum(values) / len(own)
        sign = lambda b: 33 <= b <= 126 and not chr(b).isalnum()
        before = [words[k - 1].lower() if k else None for k in range(lo, lo + len(own))]
        out.append([
            count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57), count(lambda b: sign(b) and b not in b".,"), count(lambda b: b in b".,"), count(lambda b: b >= 128), count(lambda b: b == 10), count(lambda b: b in b"!?"), count(lambda b: b == 124),
            share(len(w) for w in own) / 10, share(len(w) ** 2 for w in own) / 100, share(len(w) == 1 for w in own), share(w.lower() == p for w, p in zip(own, before, strict=True)), len({w.lower() for w in own}) / len(own),
            share(w[-1] in b".!?" for w in own), share(65 <= w[0] <= 90 for w in own), len(own) / quality.PASSAGE,
        ])
    return out


def test_passages_against_plain_python():
    rng = np.random.default_rng(2)
    parts = ["Word", "word", "WORD", "a", "I", "x1", "end.", "Why?", "no!", "|", "é", "a,b", "...", "77", "=", "word\nnext"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 200))) for _ in range(60)] + ["", " \n", "x"]
    found, bounds = quality.passages(*columns(texts))
    for k, t in enumerate(texts):
        want = slow_passages(t)
        got = found[bounds[k] : bounds[k + 1]]
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a.tolist() == pytest.approx(b), t[:60]
    every = quality.AttentionModel.fit([found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.array([k % 2 for k in range(len(texts))], float), epochs=2)
    whole = every.score(found, bounds)
    for k, t in enumerate(texts):
        w, x = every.weights, (found[bounds[k] : bounds[k + 1]] - every.mean) / every.scale
        h = np.tanh(x @ w["E"] + w["e"])
        s = np.exp([w["a"] @ (np.tanh(r @ w["V"]) / (1 + np.exp(-(r @ w["U"])))) for r in h])
        assert whole[k] == pytest.approx(1 / (1 + np.exp(-((s / s.sum()) @ h @ w["c"] + w["d"])))), t[:60]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    for s in np.unique(scores):
        order[scores == s] = order[scores == s].mean()
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize(("query", "column", "least"), [(toxicity.op1_toxicity, "toxic", 0.97), (quality.op4_attention_mil, "quality", 0.97)])
def test_held_out_documents_are_told_apart(spark, query, column, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in query(spark, sf).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    y, score, predicted = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])
    assert len(rows) > 500 and auc(score, y) > least
    assert (predicted[y == 1].mean() + 1 - predicted[y == 0].mean()) / 2 > 0.94


def test_planted_identifiers(spark):
    """Identifiers without a form of their own, in contexts that e-mail addresses and the like prove; numbers elsewhere stay."""
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    seeds = [lambda: f"u{digits(4)}@x{digits(2)}.example.org", lambda: f"10.{rng.integers(256)}.{rng.integers(256)}.7", lambda: f"+49 30 {digits(7)}"]
    forms = {
        "token": lambda: f"ID-{digits(4)}-{digits(4)}x", "tokens": lambda: f"{digits(2)} {digits(3)} {digits(3)}", "mixed": lambda: f"AB{digits(3)} {digits(2)}C {digits(4)}", "failing ip": lambda: f"{300 + rng.integers(600)}.{digits(2)}.12.{digits(3)}", "failing card": lambda: "4111-1111-1111-" + str(rng.choice(["1112", "1113", "1114"])) + "-" + digits(3),
    }
    contexts = ["reach me: {} today", "write to {} please", "kontakt {} heute", "konto {} gehört"]
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 8))
    texts, want = [], []
    for k in range(400):
        texts.append(f"{prose()} {contexts[k % 4].format(seeds[k % 3]())} {prose()}")
        want.append(None)
    for k in range(100):
        form = list(forms)[k % 5]
        found = forms[form]()
        texts.append(f"{prose()} {contexts[k % 4].format(found)} {prose()}")
        want.append((form, found))
    for _ in range(300):
        texts.append(f"{prose()} order {digits(6)} of {digits(2)} {digits(5)} pieces, {prose()} {digits(5)}")
        want.append(None)
    right = {form: [] for form in forms}
    wrong = 0
    for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got = [texts[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "context"]
        if want[r.doc_id]:
            form, found = want[r.doc_id]
            right[form].append(found in got)
            wrong += sum(g not in found for g in got)
        else:
            wrong += len(got)
    assert all(np.mean(x) >= 0.9 for x in right.values()), {k: np.mean(x) for k, x in right.items()}
    assert wrong <= 2


def test_near_duplicates_of_every_fiftieth_document_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = [low(x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        sets[r.doc_id] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
    component = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    asked = [i for i in sets if i % 50 == 0 and sets[i]]
    pairs = missed = 0
    for q in asked:
        for i, s in sets.items():
            small, large = sorted((len(s), len(sets[q])))
            if i != q and 100 * small >= 85 * large and 100 * (both := len(s & sets[q])) >= 85 * (small + large - both):
                pairs += 1
                missed += component[i] != component[q]
    assert pairs > 20 and not missed
