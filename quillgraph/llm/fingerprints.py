"""Document fingerprints: improbable-feature digests.

Every run of 64 bytes of a text is ranked by how rare its entropy is among all windows of the corpus; in each
neighbourhood of 64 windows the rarest (the first of equals) gets a point, and windows with 16 points or more are the
text's features; where none has so many, those with the most are. Texts of less than 512 bytes, which have few such
windows, are read by runs of 12 bytes in neighbourhoods of 8, ranked among their own kind. The features' hashes go into
Bloom filters of 2048 bits, five bits each, a new filter after 160 features. Likeness is the filters' bit overlap beyond
what chance gives, each filter of the shorter chain against its best match in the other, averaged.

Entropies come from integer sums over the counts in a window, kept up as it slides, for whole batches at once.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import put_back, set_aside, table
from quillgraph.llm._text import blocks, mix

@dataclass(frozen=True)
class Scale:
    """Bytes of a window, windows of a neighbourhood, and the points that make a feature."""

    window: int
    neighbours: int
    points: int


#: For texts of SHORT bytes or more, and for shorter ones.
LONG, FINE, SHORT = Scale(64, 64, 16), Scale(12, 8, 2), 512
BITS, HASHES, PER_FILTER = 2048, 5, 160
BINS = 512
#: Windows of less than this share of the largest entropy (repetitions) come last, whatever their rarity.
LEAST_ENTROPY = 0.25
_UNIT = 1 << 16
#: c log2 c for counts in a window, as integers, so that sums are the same wherever a window stands
_CLOG = np.array([round(c * np.log2(c) * _UNIT) if c else 0 for c in range(LONG.window + 2)], np.int64)
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, LONG.window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 16


def entropy_bins(data: np.ndarray, window: int = LONG.window) -> np.ndarray:
    """Bin, 0 to BINS-1, of the entropy of each window of ``data``."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    out = np.empty(n, np.int16)
    for lo in range(0, n, _CHUNK):
        x = data[lo : min(len(data), lo + _CHUNK + window - 1)]
        m = len(x)
        after, before = np.ones(m, np.uint8), np.ones(m, np.uint8)  # equal bytes in the window from, and up to, each place
        for d in range(1, window):
            same = (x[d:] == x[:-d]).view(np.uint8)
            after[:-d] += same
            before[d:] += same
        # the first window's sum, then what leaving and entering bytes change
        first = int(_CLOG[np.bincount(x[:window], minlength=256)].sum())
        lost = _CLOG[after[: m - window]] - _CLOG[after[: m - window] - 1]
        # before[] counts back window-1 places: exactly the window without the byte that left
        gained = _CLOG[before[window:]] - _CLOG[before[window:] - 1]
        sums = first + np.concatenate([[0], np.cumsum(gained - lost)])
        out[lo : lo + len(sums)] = (sums * (BINS - 1) // _CLOG[window]).astype(np.int16)
    return (BINS - 1 - out).astype(np.int16)  # 0: one byte throughout


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each bin, 0 the rarest; bins of low entropy come last."""
    low = np.arange(BINS) < LEAST_ENTROPY * BINS
    return np.argsort(np.lexsort((np.arange(BINS), counts, low))).astype(np.int64)


def _scaled(data: np.ndarray, at: np.ndarray, ranks: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of texts by one scale. A text shorter than a window is one feature."""
    n = len(data) - scale.window + 1
    size = np.diff(at)
    owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        # the last window's start of each text, and each window's neighbourhoods, stay within the text
        key = ranks[entropy_bins(data, scale.window)] << 40 | np.arange(n)
        none = np.iinfo(np.int64).max
        least = np.concatenate([key, np.full(scale.neighbours, none)])
        step = 1
        while step < scale.neighbours:
            least[:-step] = np.minimum(least[:-step], least[step:])
            step *= 2
        windows = size - scale.window + 1  # of each text
        whole = np.maximum(0, windows - scale.neighbours + 1)
        many = np.flatnonzero(whole > 0)
        begins = np.repeat(at[many], whole[many]) + np.arange(whole[many].sum()) - np.repeat(np.cumsum(whole[many]) - whole[many], whole[many])
        winner = least[begins] & ((1 << 40) - 1)
        text = np.repeat(many, whole[many])
        starts = np.flatnonzero(np.concatenate([[True], (winner[1:] != winner[:-1]) | (text[1:] != text[:-1])])) if len(winner) else np.zeros(0, np.int64)
        points = np.diff(np.append(starts, len(winner)))
        enough = np.minimum(scale.points, whole[text[starts]] // 2 + 1)
        most = np.zeros(len(size), np.int64)
        np.maximum.at(most, text[starts], points)
        best = starts[points >= np.minimum(enough, most[text[starts]])]
        few = np.flatnonzero((windows > 0) & (whole == 0))  # one neighbourhood of all windows
        alone = np.array([key[at[i] : at[i] + windows[i]].min() & ((1 << 40) - 1) for i in few], np.int64)
        chosen = np.concatenate([winner[best], alone])
        owner = np.concatenate([text[best], few])
        hashes = np.empty(len(chosen), np.uint64)
        for lo in range(0, len(chosen), 1 << 13):
            part = chosen[lo : lo + (1 << 13)]
            hashes[lo : lo + (1 << 13)] = mix((_BYTE[data[part[:, None] + np.arange(scale.window)]] * _PLACE[: scale.window]).sum(axis=1, dtype=np.uint64))
    short = np.flatnonzero((size > 0) & (size < scale.window))
    if len(short):
        extra = np.array([int.from_bytes(hashlib.sha256(data[at[i] : at[i + 1]].tobytes()).digest()[:8], "little") for i in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, extra])
    return owner, hashes


def by_scale(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, Scale, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, scale, texts, their bytes, their offsets) of the texts that each scale reads."""
    size = np.diff(at)
    for number, (scale, mine) in enumerate(((LONG, size >= SHORT), (FINE, size < SHORT))):
        which = np.flatnonzero(mine)
        if len(which):
            yield number, scale, which, data[np.repeat(mine, size)], np.concatenate([[0], np.cumsum(size[which])])


def features(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of a run of texts, in order; ``ranks`` has a row for each scale."""
    owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for number, scale, which, part, bounds in by_scale(data, at):
        text, found = _scaled(part, bounds, ranks[number], scale)
        owner, hashes = np.concatenate([owner, which[text]]), np.concatenate([hashes, found])
    order = np.argsort(owner, kind="stable")
    return owner[order], hashes[order]


def digest(hashes: np.ndarray) -> bytes:
    """Chained Bloom filters of one text's features; equal ones count once. Empty without features, as only an empty text is."""
    _, first = np.unique(hashes, return_index=True)
    own = hashes[np.sort(first)]
    out = []
    for lo in range(0, len(own), PER_FILTER):
        bits = np.zeros(BITS, bool)
        for k in range(HASHES):
            bits[(own[lo : lo + PER_FILTER] >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits).tobytes())
    return b"".join(out)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal digests, also for two of empty texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, BITS // 8), axis=1) for d in (a, b))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = x.sum(1).astype(float), y.sum(1).astype(float)
    both = x.astype(np.int32) @ y.astype(np.int32).T
    chance = nx[:, None] * ny[None, :] / BITS
    most = np.minimum(nx[:, None], ny[None, :])
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)
    return float(score.max(axis=1).mean())


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BINS), np.int64)
    for batch in batches:
        for _, _, data, at in blocks(batch.column(0)):
            for number, scale, _, part, bounds in by_scale(data, at):
                if len(part) >= scale.window:
                    inside = np.zeros(len(part) - scale.window + 1, bool)
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        inside[a : max(a, b - scale.window + 1)] = True
                    total[number] += np.bincount(entropy_bins(part, scale.window)[inside], minlength=BINS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * BINS, dtype=np.int32)), pa.array(total.ravel())], ["bin", "n"])


def learn_ranks(docs: DataFrame) -> np.ndarray:
    """Rarity ranks of entropy bins over all windows of all texts: BINS numbers for each scale.

    Null and empty texts have no windows; repeated rows count each. An empty table gives ranks by bin.
    """
    rows = docs.where("text is not null").select("text").mapInArrow(_histogram, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(2 * BINS, np.int64)
    for r in rows:
        counts[r.bin] = r.n
    return np.stack([rarity(c) for c in counts.reshape(2, BINS)])


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    out: list[bytes] = []
    for lo, hi, data, at in blocks(pa.array([t.decode() for t in texts], pa.large_string()), 1 << 19):
        owner, hashes = features(data, at, ranks)
        first = np.searchsorted(owner, np.arange(hi - lo + 1))
        out += [digest(hashes[first[i] : first[i + 1]]) for i in range(hi - lo)]
    return out


def fingerprint(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``docs`` with fingerprint (base64 of the digest) of the whole text; a column of that name is replaced, others stay.

    A null text counts as empty, whose fingerprint is empty; equal texts have equal ones. An empty table gives an empty one.
    """
    of = set_aside(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            prints = [base64.b64encode(d).decode() for d in _digests(texts, ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, "fingerprint"])

    return put_back(of.mapInArrow(run, T.StructType([*of.schema.fields, T.StructField("fingerprint", T.StringType())])), docs.columns, ("fingerprint",))


def _place(doc_id, h: int) -> tuple:
    """Places of rows compare as (doc_id, hash of the text), a null doc_id first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, h)


def _placer(bounds: list[tuple], first: tuple):
    """Gives each row its range of places, and a copy of a range's first row to the range before, as its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(bounds)
        for batch in batches:
            places = [_place(i, h) for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            part = [bisect_right(bounds, p) for p in places]
            guests = [k for k, p in enumerate(places) if p in known or p == first]
            before = [len(bounds) if places[k] == first else part[k] - 1 for k in guests]
            rows = pa.array(np.concatenate([np.arange(len(places)), guests]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(rows) for c in batch.columns), pa.array(part + before, pa.int32()), pa.array([False] * len(places) + [True] * len(guests))],
                [*batch.schema.names, "part", "guest"],
            )

    return run


def _pairs(ranks: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of rows of about a megabyte, each beginning with the last row of the run before."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[1] or "")
                if size > 1 << 19:
                    yield held
                    held, size = held[-1:], len(held[-1][1] or "")
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for held in rows(keep := _Watched(batches)):
            kind = keep.kind
            own = [(a, b) for a, b in zip(held[:-1], held[1:], strict=True) if a[2] == b[2] and not a[3]]
            if not own:
                continue
            texts = [h[1] or "" for h in held]
            prints = dict(zip((id(h) for h in held), _digests([t.encode() for t in texts], ranks), strict=True))
            edited = []
            for a, b in own:
                t, half = a[1] or "", len(a[1] or "") // 2
                edited.append((t[: len(t) - half] + (b[1] or "")[:half]).encode())
            changed = _digests(edited, ranks)
            b64 = lambda d: base64.b64encode(d).decode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in own], kind),
                    pa.array([len(a[1] or "") for a, _ in own], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([b64(prints[id(a)]) for a, _ in own]),
                    pa.array([b64(d) for d in changed]),
                    pa.array([likeness(prints[id(a)], d) for (a, _), d in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([likeness(prints[id(a)], prints[id(b)]) for a, b in own], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


class _Watched:
    """Batches, and the type of their first column."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self._batches, self.kind = batches, None

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for batch in self._batches:
            self.kind = batch.schema.field(0).type
            yield batch


def compare_with_next(docs: DataFrame, ranks: np.ndarray, per_part: int = 64) -> DataFrame:
    """doc_id, fingerprints of each text and of its edited text (the last half replaced by the next document's beginning),
    and their likeness, by ascending doc_id, the first following the last.

    One shuffle of the texts, by ranges of (doc_id, hash of the text) whose bounds are such places of the table; a range's
    first row goes to the range before too. Null doc_ids come first. Rows that share a doc_id are in the order of
    their texts' hashes; whole rows that repeat lie in one range, next to each other. A null text counts as
    empty. Other columns don't matter; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    of = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = T.StructType([of.schema["doc_id"], *T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = of.agg(F.min(F.struct("doc_id", "h")).alias("x"), F.count(F.lit(1)).alias("n")).first()  # nulls come first
    if not least["n"]:
        return spark.createDataFrame([], schema)
    first = _place(*least["x"])
    # per_part places of each range at most; each bound is one of them
    share = min(1 << 20, 2 + 2 * parts * per_part * (1 << 20) // least["n"])  # about twice as many by hash, so that tasks send few
    draw = F.xxhash64("doc_id", "h", F.lit("range"))
    sampled = of.select("doc_id", "h", draw.alias("draw")).where(F.pmod(draw, F.lit(1 << 20)) < share)
    drawn = sorted({_place(r.doc_id, r.h) for r in sampled.orderBy("draw", "doc_id", "h").limit(parts * per_part).collect()})
    bounds = [p for p in drawn[per_part::per_part] if p > first]
    placed = of.mapInArrow(_placer(bounds, first), T.StructType([*of.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("guest", T.BooleanType())]))
    # a guest comes last, whatever its id
    ordered = placed.repartition("part").sortWithinPartitions("part", "guest", "doc_id", "h").select("doc_id", "text", "part", "guest")
    return ordered.mapInArrow(_pairs(ranks), schema)


def op7_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_next(docs, learn_ranks(docs))
