"""The streaming walk against the library's encoder, and the query's own columns."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from quillgraph.llm import queries
from quillgraph.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def both():
    path = sc.default_model()
    return sc.Codec(sc.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(rng, n=300):
    words = ["internationalisation", "Donaudampfschifffahrtsgesellschaft", "aaaa", "the", "é", "中国", "あ", "😀", "supercalifragilistic", "\t", "x1y2z3", "0000000000", "=-=-=-"]
    out = ["", " ", "\n", "\n \n", "x" * 5000, "ab" * 3000, "中" * 700, "👍" * 100 + "x" * 300]
    for _ in range(n):
        out.append(str(rng.choice(["", " ", "  ", "\n"])).join(rng.choice(words, int(rng.integers(1, 30)))))
    for k in (70, 200, 900):  # segments without a space, of all lengths
        out += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß中😀"), k)) for _ in range(80)]
    return out


@pytest.mark.parametrize(("few", "look"), [(64, 8), (1, 8), (1, 1), (1, 40), (10**9, 8)])
def test_all_segments_stream_to_the_same_ids(both, few, look, monkeypatch):
    codec, theirs = both
    monkeypatch.setattr(sc, "_FEW", few)
    monkeypatch.setattr(sc, "_LOOK", look)
    texts = odd_texts(np.random.default_rng(1))
    ids, at = codec.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == theirs.encode(t), t[:80]
        assert codec.decode(ids[at[k] : at[k + 1]]) == t


def test_ids_are_final_long_before_a_segment_ends(both):
    codec, _ = both
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("etaoinshrdlu"), 5000))
    seen, given = 0, []

    class Text(str):
        def __getitem__(self, key):
            nonlocal seen
            seen = max(seen, key.stop)
            return str.__getitem__(self, key)

    codec._final = None
    for piece in codec.stream(Text(text)):
        given.append((seen, len(piece)))
    behind = [read - done for (read, _), done in zip(given, np.cumsum([n for _, n in given]), strict=True)]
    assert max(behind) <= 8 * codec.longest


def test_texts_beyond_a_block(both, monkeypatch):
    codec, theirs = both
    rng = np.random.default_rng(3)
    monkeypatch.setattr(sc, "_INV", sc._INV[:4000])
    texts = ["short", " ".join("".join(rng.choice(list("abcdefg \n"), 40)) for _ in range(600)), "y" * 9000 + " tail", "z" * 5000]
    ids, at = codec.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == theirs.encode(t), k


def test_equal_hashes_of_unlike_segments_do_no_harm(both, monkeypatch):
    codec, theirs = both
    monkeypatch.setattr(sc, "mix", lambda x: x & np.uint64(3))
    fresh = sc.Codec(codec.pieces, codec.alone)
    monkeypatch.setattr(fresh, "_stable_ids", lambda a, b: np.array([fresh._stable(fresh._text_of(x), fresh._text_of(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool))
    fresh._maybe[:] = True
    texts = ["one two three four five six seven", "eight nine ten", "two two two"] * 30
    ids, at = fresh.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == theirs.encode(t)


def test_codecs_are_told_apart_by_their_vocabulary(both):
    codec, _ = both

    class Held:
        def __init__(self, value):
            self.value = value

    few = [p for p in codec.pieces if p[2] != 1 or len(p[0]) == 1]
    for pieces, name in ((codec.pieces, "a"), (few, "b"), (codec.pieces, "a")):
        assert len(sc._codec(Held((pieces, None, name))).pieces) == len(pieces)


def test_query_columns(spark, both, tmp_path):
    _, theirs = both
    texts = [*odd_texts(np.random.default_rng(4), 40), None, "x" * 300_000, "same", "same"]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}), f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.QUERIES["op5_streaming_viterbi"](spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        ids = theirs.encode(t or "")
        assert (out[k].n_ids, out[k].ids_sha256, out[k].round_trip) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)
