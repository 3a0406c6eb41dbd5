"""The battery's statistics, p-values and thresholds against plain Python, and planted secrets of every encoding."""

import math
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import secret_scan as ss

ALPHABETS = {name: chars for name, _, chars in ss.ENCODINGS}


def infer(body):
    for name, chars in ALPHABETS.items():
        if set(body) <= set(chars) or name == "base64_url":
            return name


def upper_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def slow_battery(token):
    body = token.rstrip("=")
    name = infer(body)
    alphabet = ALPHABETS[name]
    n, size = len(body), len(alphabet)
    chi2 = sum((Counter(body).get(c, 0) - n / size) ** 2 / (n / size) for c in sorted(set(alphabet) | set(body)))
    df = size - 1
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [alphabet.index(c) >= size // 2 for c in body]
    runs = 1 + sum(a != b for a, b in zip(high[:-1], high[1:], strict=True))
    ones = sum(high)
    mean = 2 * ones * (n - ones) / n + 1
    about = abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    codes = [alphabet.index(c) + 1 - (size + 1) / 2 for c in body]
    serial = abs(sum(a * b for a, b in zip(codes[:-1], codes[1:], strict=True))) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    clamp = lambda p: math.log(min(max(p, 1e-300), 1.0))
    f = -2 * (clamp(upper_tail(z)) + clamp(2 * upper_tail(about)) + clamp(2 * upper_tail(serial)))
    digit = [c in string.digits for c in body]
    mixed = sum(a != b for a, b in zip(digit[:-1], digit[1:], strict=True))
    return {"encoding": name, "n": n, "chi2": chi2, "mixed": mixed, "z": (z, about, serial), "p": math.exp(-f / 2) * (1 + f / 2 + f * f / 8)}


def slow_bin(t, kappa):
    size = len(ALPHABETS[t["encoding"]])
    rival = max(kappa, 0.1) if t["encoding"] in ("hex", "hex_upper") else kappa
    away, df = max(size * rival - 1, 0.05) * t["n"], size - 1
    z = (t["chi2"] - df - away) / math.sqrt(2 * (df + 2 * away))
    changes = 2 * (math.sqrt(t["mixed"] + 0.375) - math.sqrt(t["n"] / ss.TEXT_STRETCH))
    first, second = (-math.log(max(upper_tail(x), 1e-30)) for x in (-z, changes))
    half = first + second
    return 10 * (first if t["encoding"] in ("lower", "upper", "letters") else half - math.log1p(half))


def tokens(rng, n=250):
    out = []
    for name, chars in ALPHABETS.items():
        out += ["".join(rng.choice(list(chars), int(k))) for k in rng.integers(20, 120, n // 10)]
    words = ["report", "final", "of", "the", "user", "account", "settings", "internationalisation", "index", "page"]
    out += ["_".join(rng.choice(words, int(k))) + str(rng.integers(1990, 2030)) for k in rng.integers(3, 9, n // 2)]
    out += ["".join(w.title() for w in rng.choice(words, int(k))) for k in rng.integers(4, 9, n // 2)]
    return [t for t in out if len(t) >= 20]


def test_statistics_against_plain_python(spark):
    every = tokens(np.random.default_rng(1)) + ["a" * 30, "ab" * 20, "0123456789" * 3, "QUJDREVGR0hJSktMTU5PUFFSU1RVVg=="]
    df = spark.createDataFrame([(t,) for t in every], "token string").select(F.array(F.struct("token")).alias("a"))
    df = df.select(F.explode(ss.battery(F.col("a"))).alias("t")).withColumn("bin", ss._text_bin(F.col("t"), 0.07))
    for r in df.collect():
        want = slow_battery(r.t.token)
        assert (r.t.encoding, r.t.n, r.t.mixed) == (want["encoding"], want["n"], want["mixed"])
        assert r.t.chi2 == pytest.approx(want["chi2"], rel=1e-9, abs=1e-6)
        assert list(r.t.z) == pytest.approx(list(want["z"]), rel=1e-9, abs=1e-9)
        assert r.t.p == pytest.approx(want["p"], rel=0.02, abs=1e-12)
        wanted = min(slow_bin(want, 0.07), 600)
        assert abs(r.bin - wanted) <= 1 + 0.005 * wanted  # tails are right to a few thousandths


def test_thresholds_against_plain_python(spark):
    rng = np.random.default_rng(2)
    every = tokens(rng)
    texts = [(k, f"see {t} and onthtionwhonattionnd or queelleaiierelletion") for k, t in enumerate(every)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kappa, cut = ss.thresholds(docs)
    equal = pairs = 0
    runs = ["onthtionwhonattionnd", "queelleaiierelletion"] * len(every)
    runs += [run for t in every for run in __import__("re").findall("[a-z]{20,}", t)]
    for run in runs:
        equal += sum(c * (c - 1) for c in Counter(run).values())
        pairs += len(run) * (len(run) - 1)
    assert kappa == pytest.approx(equal / pairs, abs=1e-4)
    groups = defaultdict(list)
    for t in every + ["onthtionwhonattionnd", "queelleaiierelletion"] * len(every):
        found = slow_battery(t)
        groups[found["encoding"], int(math.log2(found["n"]))].append(int(min(slow_bin(found, kappa), 600)))
    # Benjamini-Hochberg, p-values rounded up to their bins' ends
    for key, bins in groups.items():
        p = sorted(math.exp(-b / 10) for b in bins)
        passed = max((k for k, x in enumerate(p, 1) if x <= ss.FDR * k / len(p)), default=0)
        got = sum(b >= cut[key] for b in bins) if key in cut else 0
        assert abs(got - passed) <= max(1, 0.03 * len(bins)), key


def test_planted_secrets_of_every_encoding(spark):
    rng = np.random.default_rng(3)
    planted = {}
    for name, lengths in {"hex_upper": (32, 40, 64), "base32": (32, 52), "alnum_lower": (28, 32, 40), "alnum_upper": (32, 40), "base62": (24, 32, 40, 64), "base64": (44, 88), "base64_url": (32, 43, 86), "lower": (160,), "upper": (160,), "letters": (96,)}.items():
        for n in lengths:
            planted[name, n] = ["".join(rng.choice(list(ALPHABETS[name]), n)) for _ in range(20)]
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 11)))) for _ in range(500)]
    like = ["_".join(rng.choice(words, int(k))) + str(rng.integers(1990, 2030)) for k in rng.integers(4, 9, 300)]
    like += ["".join(w.title() for w in rng.choice(words, int(k))) for k in rng.integers(4, 20, 150)] + ["".join(rng.choice(words, int(k))) for k in rng.integers(4, 40, 150)]
    like += ["-".join(rng.choice(words, int(k))) for k in rng.integers(4, 9, 150)]
    secrets = {t for ts in planted.values() for t in ts}
    texts = list(enumerate(f"note {t} is kept" for t in [*secrets, *like]))
    found = set()
    for r in ss.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found |= {texts[r.doc_id][1][s["start"] : s["end"]] for s in r.spans if s["kind"] == "random"}
    for (name, n), ts in planted.items():
        assert np.mean([t in found for t in ts]) >= 0.9, (name, n, np.mean([t in found for t in ts]))
    assert len(found - secrets) <= 0.02 * len(like), found - secrets


def test_clashing_names_and_runs_of_letters(spark):
    docs = spark.createDataFrame([(1, "0123456789abcdef " + "e" * 300_000), (1, None)], "doc_id long, text string").selectExpr("doc_id", "text", "1 as _base", "2 as _candidates", "3 as _random", "4 as spans", "5 as _0")
    out = ss.find_secrets(docs)
    assert out.columns == ["doc_id", "text", "_base", "_candidates", "_random", "_0", "spans"]
    assert sorted((len(r.spans), r._base, r._candidates, r._random, r._0) for r in out.collect()) == [(0, 1, 2, 3, 5), (2, 1, 2, 3, 5)]
