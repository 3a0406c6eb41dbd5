import re

import numpy as np
import pytest

from quillgraph.llm import substring_dedup


def brute_force(texts):
    """doc_id -> (sentences, covered sentences), from the words themselves."""
    sentences, spans = {}, {}
    for i, t in sorted(texts):
        cut = []
        for line in re.split("\n", t or ""):
            own: list[str] = []
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                own.append(re.sub("[A-Z]", lambda m: m[0].lower(), w))
                if w[-1] in ".!?":
                    cut.append(own)
                    own = []
            cut += [own] if own else []
        pieces = []
        for s in cut:
            pieces += [s[k : k + 12] for k in range(0, len(s), 12)] if len(s) > 24 else [s]
        sentences[i] = pieces
        for a in range(len(pieces)):
            b, words = a, []
            while b < len(pieces) and (b - a < 2 or len(words) < 20):
                words += pieces[b]
                b += 1
            if b - a >= 2 and len(words) >= 20:
                spans.setdefault(tuple(words), []).append((i, a, b))
    gone = {i: set() for i in sentences}
    for places in spans.values():
        for i, a, b in places[1:]:
            gone[i] |= set(range(a, b))
    return {i: (len(sentences[i]), len(gone[i])) for i in sentences}


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_repeated_spans_against_brute_force(spark, hot_rows, monkeypatch):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"{'W' if k % 3 else 'w'}{s}x{k}" for k in range(rng.integers(2, 40))) + str(rng.choice([".", "!", "?", "\n"])) for s in range(12)]
    texts = [(i, " ".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(60)] + [(100, None), (101, "")]
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda docs, f=substring_dedup.repeated_spans: f(docs, hot_rows))
    out = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in out} == brute_force(texts)


def test_rows_without_a_doc_id_and_repeated_ids(spark):
    passage = " ".join(f"Sentence {i} tells of item {i * 7} in the long shared story." for i in range(6))
    own = lambda k: " ".join(f"Own{k} words number {i * k} stand alone here today." for i in range(1, 4))
    rows = [(None, f"{own(1)} {passage}"), (7, f"{own(2)} {passage}"), (None, f"{own(3)} {passage}"), (None, f"{own(3)} {passage}"), (8, own(4)), (8, own(4)), (8, f"{own(5)} {own(4)}"), (9, own(4)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as cuts", "2 as text_key", "3 as hash_a", "4 as n_removed")
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "cuts", "text_key", "hash_a", "n_sentences", "n_removed"]
    got = sorted(((r.doc_id, (r.text or "").strip(), r.cuts, r.text_key, r.hash_a, r.n_removed > 0) for r in out.collect()), key=str)
    # a document with a doc_id comes first, whatever row it is; what rows of one doc_id share stays
    want = [(None, own(1), True), (7, f"{own(2)} {passage}", False), (None, own(3), True), (None, own(3), True), (8, own(4), False), (8, own(4), False), (8, f"{own(5)} {own(4)}", False), (9, "", True), (None, "", False), (None, "", False)]
    assert got == sorted(((i, t, 1, 2, 3, cut) for i, t, cut in want), key=str)


def test_hashes_of_equal_words_agree_wherever_they_stand():
    import numpy as np

    texts = [b"zero one two. three four", b"a b c d e one TWO. three x", b"two. one"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    s = substring_dedup._Sentences(data, at)
    words = [w for t in texts for w in t.lower().split()]
    places = [(a, a + k) for k in (1, 2, 3) for a in range(len(words) - k + 1) if s.words.doc[a] == s.words.doc[a + k - 1]]
    hashes = s._hashes(np.array([a for a, _ in places]), np.array([b for _, b in places]))
    seen = {}
    for (a, b), h, g in zip(places, *hashes.tolist(), strict=True):
        assert seen.setdefault(tuple(words[a:b]), (h, g)) == (h, g)
    assert len(set(seen.values())) == len(seen) and len({h for h, _ in seen.values()}) == len({g for _, g in seen.values()}) == len(seen)
