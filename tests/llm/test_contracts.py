"""The queries' results against plain Python that follows their contracts word by word."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillgraph.llm import queries

ODD = ["", None, " ", "é" * 40, "😀 x", "a"]


def stored(folder, name, rows, schema):
    pq.write_table(pa.table({c: [r[k] for r in rows] for k, (c, _) in enumerate(schema)}, pa.schema(schema)), f"{folder}/{name}.parquet")


def documents(folder, texts):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    stored(folder, "documents", rows, [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def scraps(seed, parts, n=400):
    """Texts put together from pieces that nearly match, without regard to where one ends."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(n)] + ODD


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


SECRETS = [
    "password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "API__key", '"', "'", " ", "  ", ":", "=", "==", "abcdefghijkl", "abcdefghijk", "x", "A1+/_.-", "AKIA", "AKIAABCDEFGHIJKLMN", "AKIAABCDEFGHIJKLM", "0123456789abcdef",
    "0123456789abcde", "f", "F", "é", "😀", "\n", "\t", "k=v", "q8Zt2Wv9Lx4Rb7Kd1Ny6Ps3Hc5Gm0Ja",
]


def secret_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_against_brute_force(spark, tmp_path):
    texts = scraps(21, SECRETS) + ["token=abcdefghijkl12 é " * 1500]  # several chunks of matches
    documents(tmp_path, texts)
    out = {r.doc_id: r for r in queries.QUERIES["op2_randomness_battery"](spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = secret_spans(t or "")
        assert [getattr(out[i], f"n_{k}") for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")], t
        assert out[i].base_sha256 == digest(want), t
        every = [s for s in out[i].spans.split(",") if s]
        assert [s for s in every if not s.startswith("random")] == [f"{k}:{a}:{b}" for k, a, b in want]


PERSONAL = [
    "a", "b.c", "@", "@@", "x@y", "u@v.w", ".", "-", "+", "%", "_", " ", "  ", "(", ")", "1", "10", "255", "256", "300", "0001", "1.2.3.4", "10.0.0.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+49 (30)", "+1",
    "12345678", "é", "😀", "\n", " ", "٣",
]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data_against_brute_force(spark, tmp_path):
    texts = scraps(22, PERSONAL)
    documents(tmp_path, texts)
    out = {r.doc_id: r for r in queries.QUERIES["op10_bootstrapped_pii"](spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = personal_spans(t or "")
        assert [getattr(out[i], f"n_{k}") for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")], t
        assert out[i].base_sha256 == digest(want), t
        assert [s for s in out[i].spans.split(",") if s and not s.startswith("context")] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_shards_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(23)
    texts = ["é" * int(n) for n in rng.integers(0, 300, 300)] + ["same text"] * 200 + ODD
    documents(tmp_path, texts)
    rows = sorted(queries.QUERIES["op3_prefix_shards"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    begin, slots = 0, [0] * 16
    for r, t, n in zip(rows, texts, sizes, strict=True):
        shard = begin * 16 // sum(sizes)
        assert (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (n, zlib.crc32((t or "").encode()), "bytes", shard, slots[shard], None)
        begin, slots[shard] = begin + n, slots[shard] + 1


def test_fingerprint_query(spark, tmp_path):
    rng = np.random.default_rng(24)
    texts = ["".join(rng.choice(list("abcdé😀 \n"), rng.integers(0, 200))) for _ in range(60)] + ODD
    texts += [texts[3], texts[3]]
    documents(tmp_path, texts)
    out = {r.doc_id: r for r in queries.QUERIES["op7_improbable_features"](spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    prints = {}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
        assert prints.setdefault(t, out[i].fingerprint) == out[i].fingerprint


@pytest.mark.parametrize(("name", "modulus", "rest", "cut"), [("op1_toxicity", 4, 2, 0.3), ("op4_attention_mil", 3, 1, 0.5)])
def test_held_out_rows_are_never_learned(spark, tmp_path, name, modulus, rest, cut):
    rng = np.random.default_rng(25)
    words = [["good", "calm", "kind", "river", "stone"], ["bad", "vile", "hate", "idiot", "trash"]]
    of = [int(x) for x in rng.integers(0, 2, 240)]
    texts = [" ".join(rng.choice(words[y], 30)) + "." for y in of] + ODD
    documents(tmp_path, texts)
    label = [("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())]
    scores = []
    for flipped in (False, True):
        held = lambda i: zlib.crc32(str(i).encode()) % modulus == rest
        stored(tmp_path, "labels", [(i, y ^ (flipped and held(i)), y ^ (flipped and held(i))) for i, y in enumerate(of)], label)
        rows = sorted(queries.QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
        assert [r.held_out for r in rows] == [held(r.doc_id) for r in rows] and len(rows) == len(texts)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
        scores.append([r.score for r in rows])
    assert scores[0] == scores[1]
