"""Substring deduplication by sliding spans of sentences.

A sentence ends with a word that ends in . ! or ?, or with its line; one of more than 24 words counts as pieces of 12.
From each sentence a span runs over the next ones until it has two sentences and ``WORDS`` words. The spans' hashes of
all documents are joined; of equal spans the first, by doc_id and place, stays, and the sentences that any other
covers go. Hashes are of words without regard to white space and ASCII capitals, of 128 bits, so that no two of 10^15
different spans are likely to meet.

So that a passage is found wherever it stands in a sentence, runs of ``RUN`` words at places that the words themselves
decide are joined too: of each ``NEAR`` successive runs of a text, that with the smallest hash. Any ``RUN`` + ``NEAR`` - 1
words that repeat share a run, and the words of all but the first go; of a longer repeat at most ``NEAR`` - 1 words stay
at either end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import put_back, saved, set_aside, table
from quillgraph.llm._text import SPACED, Words, _powers, blocks, mix

WORDS, SENTENCES = 20, 2
_LONG, _PIECE = 24, 12
#: A single sentence of up to _LONG words may repeat, so runs are longer.
RUN, NEAR = _LONG + 1, 16
#: A span that more rows have than this, and than one in HOT_SPANS of all repeated rows, is dealt to several tasks.
HOT_ROWS, HOT_SPANS = 10_000, 10_000
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class _Sentences:
    """Sentences of a run of texts: first word of each, and of one past the last; and the text each belongs to."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.words = words = Words(data, at, SPACED)
        n = len(words)
        ends = _ENDS[data[words.end - 1]] if n else np.zeros(0, bool)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        if n:
            ends[:-1] |= feeds[words.start[1:]] > feeds[words.end[:-1]]
            ends[:-1] |= words.doc[1:] != words.doc[:-1]
            ends[-1] = True
        first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        pieces = np.where(size > _LONG, -(-size // _PIECE), 1)
        which = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first = np.append(first[which] + step * _PIECE, n).astype(np.int64)
        self.doc = words.doc[self.first[:-1]] if n else np.zeros(0, np.int64)
        #: sentences of text i are bounds[i]:bounds[i+1]
        self.bounds = np.searchsorted(self.doc, np.arange(len(at)))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, end sentence, hashes) of every whole span."""
        n = len(self.doc)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.uint64)
        begin = np.arange(n)
        # the first boundary with enough words, and not before two sentences
        end = np.maximum(np.searchsorted(self.first, self.first[:-1] + WORDS, "left"), begin + SENTENCES)
        good = end <= self.bounds[1:][self.doc]
        begin, end = begin[good], end[good]
        return begin, end, self._hashes(self.first[begin], self.first[end])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hashes) of the runs of words that stand for their neighbourhoods."""
        lo = np.arange(max(0, len(self.words) - RUN + 1))
        lo = lo[self.words.doc[lo] == self.words.doc[lo + RUN - 1]]
        if len(lo) < NEAR:
            return lo[:0], np.zeros((2, 0), np.uint64)
        hashes = self._hash(0, lo, lo + RUN)
        least = np.arange(len(lo) - NEAR + 1) + np.lib.stride_tricks.sliding_window_view(hashes, NEAR).argmin(axis=1)
        doc = self.words.doc[lo]
        chosen = lo[np.unique(least[doc[: len(least)] == doc[NEAR - 1 :]])]
        return chosen, self._hashes(chosen, chosen + RUN) ^ _RUNS

    def _hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.stack([self._hash(0, lo, hi), self._hash(1, lo, hi)])

    def _hash(self, which: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first or second 64 bits of the hashes of words lo:hi."""
        # sums of scrambled word hashes weighted by odd powers, the same wherever the span stands
        weight, inverse = _powers_of(which, len(self.words))
        words = mix(self.words.hash + _SECOND) if which else self.words.hash
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * weight)])
        return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


#: Sets the hashes of runs apart from those of spans, and the second hash of a word from the first.
_RUNS, _SECOND = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_STEPS = (0xD6E8FEB86659FD93, 0xCA5A826395121157)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _cache or len(_cache[which][0]) < n:
        size = max(n, 1 << 16)
        _cache[which] = (_powers(_STEPS[which], size), _powers(pow(_STEPS[which], -1, 1 << 64), size))
    return _cache[which][0][:n], _cache[which][1][:n]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash_a, hash_b, doc_id, text_key, first, n, again): ``again`` where the same document has the span before."""
    for batch in batches:
        for lo, hi, data, at in blocks(batch.column(2)):
            s = _Sentences(data, at)
            begin, end, hashes = s.spans()
            doc = s.doc[begin]
            own = begin - s.bounds[doc]
            word, of_runs = s.runs()
            doc = np.concatenate([doc, s.words.doc[word]])
            own = np.concatenate([own, word - s.words.first[s.words.doc[word]]])
            n = np.concatenate([end - begin, np.full(len(word), -RUN)])
            hashes = np.concatenate([hashes, of_runs], axis=1)
            order = np.lexsort((own, hashes[1], hashes[0], doc))
            same = np.zeros(len(order), bool)
            if len(order):
                same[order[1:]] = (np.diff(doc[order]) == 0) & (hashes[:, order[1:]] == hashes[:, order[:-1]]).all(axis=0)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), *(batch.column(c)[lo:hi].take(rows) for c in (0, 1)), pa.array(own.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(same)],
                ["hash_a", "hash_b", "doc_id", "text_key", "first", "n", "again"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with text_key, which tells rows without a doc_id apart by their texts: null for all others."""
    return docs.withColumn("text_key", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def repeated_spans(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text_key, first, n): n sentences, or for a negative n as many words, from the text's first on, that repeat
    earlier ones; ``docs`` has doc_id, text_key (:func:`_keyed`) and text.

    The rows of a hash that more than ``hot_rows`` have are joined in parts of about that many.
    """
    of = docs.select("doc_id", "text_key", "text")
    long, number = T.LongType(), T.IntegerType()
    spans = of.mapInArrow(
        _spans,
        T.StructType([T.StructField("hash_a", long), T.StructField("hash_b", long), of.schema["doc_id"], of.schema["text_key"], T.StructField("first", number), T.StructField("n", number), T.StructField("again", T.BooleanType())]),
    )
    hashes = ["hash_a", "hash_b"]
    # counted, and the first document found, before rows of a hash meet, so that a common span is no hot key here; a document
    # with a doc_id comes before all without
    found = spans.groupBy(*hashes).agg(F.min("doc_id").alias("kept"), F.min("text_key").alias("kept_key"), F.count(F.lit(1)).alias("rows"))
    shared = saved(found.where("rows > 1"))
    limit = max(hot_rows, (shared.agg(F.sum("rows")).first()[0] or 0) // HOT_SPANS)
    shared = shared.select(*hashes, "kept", "kept_key", F.ceil(F.col("rows") / limit).cast("int").alias("parts"))
    hot = shared.where("parts > 1").select(*hashes, "parts")  # fewer than HOT_SPANS rows by the limit
    dealt = spans.join(F.broadcast(hot), hashes, "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", "first"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    shared = shared.select(*hashes, "kept", "kept_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    stays = ~F.col("again") & F.coalesce(F.col("doc_id") == F.col("kept"), F.col("kept").isNull() & (F.col("text_key") == F.col("kept_key")), F.lit(False))
    return dealt.join(shared, [*hashes, "part"]).where(~stays).select("doc_id", "text_key", "first", "n")


def _apart(run: np.ndarray, hit: np.ndarray, sentence: np.ndarray) -> int:
    """Sentences that lose words to repeats in which spans cover no sentence."""
    edges = np.flatnonzero(np.diff(run.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return len({k for a, b in edges.tolist() if not hit[a:b].any() for k in sentence[a:b].tolist()})


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        column = batch.column(names.index("text"))
        cuts = batch.column(names.index("cuts"))
        total, gone, texts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), column.to_pylist()
        for lo, hi, data, at in blocks(column):
            s = _Sentences(data, at)
            total[lo:hi] = np.diff(s.bounds)
            for i in range(hi - lo):
                if not cuts[lo + i].is_valid:
                    continue
                n, word = int(total[lo + i]), int(s.words.first[i])
                n_words = int(s.words.count[i])
                out, runs = np.zeros(n + 1, np.int64), np.zeros(n_words + 1, np.int64)
                for c in cuts[lo + i].as_py():
                    counts, most, length = (out, n, c["n"]) if c["n"] > 0 else (runs, n_words, -c["n"])
                    if c["first"] < most:
                        counts[c["first"]] += 1
                        counts[min(most, c["first"] + length)] -= 1
                hit, run = np.cumsum(out[:n]) > 0, np.cumsum(runs[:n_words]) > 0
                first = s.first[s.bounds[i] : s.bounds[i] + n + 1] - word
                if n:
                    first[n] = n_words
                sentence = np.repeat(np.arange(n), np.diff(first))
                gone[lo + i] = hit.sum() + _apart(run, hit[sentence], sentence)
                # a covered sentence goes as one, other words as runs; white space between them stays
                label = np.where(hit[sentence], sentence + 1, np.where(run, -1, 0))
                edges = np.flatnonzero(np.diff(label, prepend=0, append=0))
                raw, pieces, done = data[at[i] : at[i + 1]], [], 0
                for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if not label[p]:
                        continue
                    a, b = int(s.words.start[word + p] - at[i]), int(s.words.end[word + q - 1] - at[i])
                    pieces.append(raw[done:a].tobytes())
                    done = b
                texts[lo + i] = b"".join([*pieces, raw[done:].tobytes()]).decode()
        kept = [n for n in names if n not in ("cuts", "text_key")]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(texts, pa.string()) if n == "text" else batch.column(names.index(n)) for n in kept), pa.array(total), pa.array(gone)], [*kept, "n_sentences", "n_removed"]
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated spans and runs, with n_sentences (before) and n_removed; columns of those names are replaced.

    n_removed counts, of each repeat, the sentences that spans cover or, where they cover none, those that lose words.
    Null and empty texts stay as they are. Rows sharing a doc_id count as one document and get the same cuts; what two of
    them share stays. Rows without a doc_id come after all others, each text of theirs being a document of its own.
    Other columns stay, whatever their names; an empty table gives an empty one; long texts are read whole.
    """
    of = _keyed(set_aside(docs))
    # a document's cuts, neighbouring spans merged by the set; no more than it has sentences and words
    cuts = repeated_spans(of).groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key")).agg(F.collect_set(F.struct("first", "n")).alias("cuts"))
    schema = T.StructType([*(f for f in of.schema.fields if f.name != "text_key"), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    both = of.join(cuts, of["doc_id"].eqNullSafe(cuts["cut_id"]) & of["text_key"].eqNullSafe(cuts["cut_key"]), "left").select(*of.columns, "cuts")
    return put_back(both.mapInArrow(_remover, schema), docs.columns, ("n_sentences", "n_removed"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeats"), "text")
