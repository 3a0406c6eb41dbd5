"""SentencePiece encoding and decoding by a streaming Viterbi over a published byte-pair vocabulary.

A segmentation is the vocabulary's own (that of merging the best pair again and again) exactly if each of its
pieces merges to itself, and any two neighbours, merged alone, stay as they are: merges inside two pieces happen in
the same order whatever surrounds them, so the first merge across a boundary would happen for the two alone too.
Hence a lattice whose edges are pieces, and where an edge may follow another only if the two are stable, has one
surviving path to each position, and the last piece of that path is its backpointer. The walk keeps backpointers
of a window bounded by the longest piece: only the positions from which a piece may still begin are live, and whenever
the paths to all live positions share a boundary, ids up to the last such one are final and what lies before it is forgotten.

No piece spans the place before a run of spaces or either side of a line feed, so all paths meet there. The distinct
segments between such places, of a whole batch of texts, are walked side by side with array operations: the boundaries of
a path in the window are the bits of one number, and what live paths share is the conjunction of theirs. When only a few
segments are left, or paths stay apart for a whole window, the same walk goes on from the last final boundary for each
segment by itself. A character outside the vocabulary is a piece of its own on the way, and bytes in the end.
Pieces and equal segments are found by hash and compared by their characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import put_back, set_aside, table
from quillgraph.llm._text import _INV, _POW, mix, utf8

SPACE = "▁"
CACHE = 100_000
#: Positions of a window of the side-by-side walk; bits of a number.
WINDOW = 64
#: Shared boundaries are looked for at every so many positions. Segments walked side by side, at least.
_LOOK, _FEW = 8, 64
_CELLS = 1 << 20


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file: field 1 of its protocol buffer, by the public format."""
    with open(path, "rb") as f:
        raw = f.read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, object]]:
        while at < end:
            key, at = varint(at)
            if key & 7 == 0:
                value, at = varint(at)
                yield key >> 3, value
            elif key & 7 == 2:
                n, at = varint(at)
                yield key >> 3, (at, at + n)
                at += n
            else:
                n = 4 if key & 7 == 5 else 8
                yield key >> 3, raw[at : at + n]
                at += n

    out = []
    for number, where in fields(0, len(raw)):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for k, v in fields(*where):
                if k == 1:
                    piece = raw[v[0] : v[1]].decode()
                elif k == 2:
                    score = float(np.frombuffer(v, np.float32)[0])
                elif k == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


@dataclass
class Codec:
    """Ids and texts by a byte-pair vocabulary with byte fallback and a dummy prefix; no other normalisation."""

    pieces: list[tuple[str, float, int]]
    #: whether each piece merges to itself; found here if not given
    alone: np.ndarray | None = None
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (1, 4)}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == 6:
                self.bytes[int(p[3:5], 16)] = i
            self.raw.append(bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(SPACE, " ").encode())
        self.longest = max((len(p) for p in self.ids), default=1)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece spans the place before a space or a line feed")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._history: dict[str, list[tuple[float, str, str]]] = {}  # of pieces, so no more than the vocabulary and single characters
        if self.alone is None:
            self.alone = np.array([p in self.ids and (len(p) == 1 or self.merged(p) == [p]) for p, _, _ in self.pieces], bool)
        self._prepare()

    def _prepare(self) -> None:
        """Arrays for walking many segments at once: pieces by hash, single characters, and a cache of stable pairs."""
        good = [(i, p.replace(SPACE, " ")) for p, i in self.ids.items() if self.alone[i] and len(p) > 1]
        hashes = np.array([int(_sums(_codes(p))[-1]) for _, p in good], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self._hashes, self._hash_ids = hashes[order], np.array([i for i, _ in good], np.int32)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[(mix(hashes) >> np.uint64(42)).astype(np.int64)] = True
        self._lengths = np.array(sorted({len(p) for _, p in good}), np.int64)
        #: piece -> its characters
        self._spelled = np.zeros((len(self.pieces), self.longest), np.int64)
        for i, p in good:
            self._spelled[i, : len(p)] = _codes(p)
        # a character outside the vocabulary is the piece len(pieces) + its code
        self._single = np.arange(len(self.pieces), len(self.pieces) + 0x110002, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self._single[ord(p.replace(SPACE, " ")) + 1] = i
        self._cell_key, self._cell_good = np.full(_CELLS, -1, np.int64), np.zeros(_CELLS, bool)
        self._size = np.array([len(p) for p, _, _ in self.pieces], np.int64)

    def _text_of(self, piece: int) -> str:
        return self.pieces[piece][0] if piece < len(self.pieces) else chr(piece - len(self.pieces) - 1)

    def _sizes(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces < len(self._size), self._size[np.minimum(pieces, len(self._size) - 1)], 1)

    def _stable_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        cell = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        missing = self._cell_key[cell] != key
        out = self._cell_good[cell]
        if missing.any():
            fresh, where = np.unique(key[missing], return_inverse=True)
            good = np.array([self._stable(self._text_of(k >> 32), self._text_of(k & 0xFFFFFFFF)) for k in fresh.tolist()], bool)[where]
            out[missing] = good
            # of keys that share a cell the last stays; both arrays are written in the same order
            self._cell_key[cell[missing]], self._cell_good[cell[missing]] = key[missing], good
        return out

    def _walk(self, sums: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of segments, longest first, and the offsets of each segment's."""
        n, longest = len(start), int(size[0]) if len(size) else 0
        # of each segment: where its final part ends and with which piece; by position modulo WINDOW the last piece of the path
        # that ends there (-1: none) and the path's boundaries since the final part
        done, before = np.zeros(n, np.int64), np.full(n, -1, np.int32)
        n_long = int(np.searchsorted(-size, -self.longest, "left"))
        last, path = np.full((n, WINDOW), -1, np.int32), np.zeros((n_long, WINDOW), np.uint64)
        final: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (segment, position, piece)
        alone: list[int] = []
        gone = np.zeros(n, bool)

        def commit(rows: np.ndarray, to: np.ndarray) -> None:
            live, at, begin = rows, to.copy(), done[rows]
            newest = last[rows, to % WINDOW]
            while len(live):
                piece = last[live, at % WINDOW]
                final.append((live, at, piece))
                at = at - self._sizes(piece)
                on = at > begin
                live, at, begin = live[on], at[on], begin[on]
            before[rows], done[rows] = newest, to

        for end in range(1, longest + 1):
            active = int(np.searchsorted(-size, -end, "right"))
            todo = np.flatnonzero(~gone[:active])
            if len(todo) < _FEW:
                alone += todo.tolist()
                break
            column = end % WINDOW
            last[todo, column] = -1
            for length in (1, *self._lengths.tolist()):
                begin = end - length
                if begin < 0 or not len(todo):
                    break
                at = start[todo]
                if length == 1:
                    piece, rows = self._single[codes[at + begin]], todo
                else:
                    value = (sums[at + end] - sums[at + begin]) * _INV[at + begin]
                    some = np.flatnonzero(self._maybe[(mix(value) >> np.uint64(42)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(self._hashes, value[some]), len(self._hashes) - 1)
                    found = np.flatnonzero(self._hashes[place] == value[some])
                    piece, rows = self._hash_ids[place[found]], todo[some[found]]
                # a piece begins where the final part ends, after its last piece, or where a path ends after it
                if begin:
                    here = done[rows]
                    left = np.where(here == begin, before[rows], np.where(here < begin, last[rows, begin % WINDOW], -1))
                    fits = np.flatnonzero(left >= 0)
                    fits = fits[self._stable_ids(left[fits], piece[fits])]
                    piece, rows = piece[fits], rows[fits]
                if length > 1 and len(rows):
                    spelled = (codes[(start[rows] + begin)[:, None] + np.arange(length)] == self._spelled[piece, :length]).all(axis=1)
                    piece, rows = piece[spelled], rows[spelled]
                if len(rows):
                    last[rows, column] = piece
                    todo = todo[last[todo, column] < 0]
                    # segments that end within a window of the longest piece need no path
                    rows = rows[: np.searchsorted(rows, n_long)]
                    path[rows, column] = np.where(done[rows] == begin, np.uint64(0), path[rows, begin % WINDOW]) | np.uint64(1 << column)
            ended = np.flatnonzero((size[:active] == end) & ~gone[:active])
            commit(ended, np.full(len(ended), end))
            if end % _LOOK == 0 and end >= self.longest:
                rows = np.flatnonzero((size[:active] > end) & ~gone[:active] & (done[:active] <= end - self.longest))
                if len(rows):
                    shared = np.full(len(rows), ~np.uint64(0))
                    for p in range(end + 1 - self.longest, end + 1):
                        shared &= np.where(last[rows, p % WINDOW] >= 0, path[rows, p % WINDOW], ~np.uint64(0))
                    # the latest shared boundary, counted back from the end
                    turned = np.roll(((shared[:, None] >> np.arange(WINDOW, dtype=np.uint64)) & np.uint64(1)).astype(bool), WINDOW - 1 - column, axis=1)
                    back = np.argmax(turned[:, ::-1], axis=1)
                    some = np.flatnonzero(shared != 0)
                    rows, back = rows[some], back[some]
                    commit(rows, end - back)
                    # boundaries of the final part are forgotten
                    for row, to in zip(rows.tolist(), (end - back).tolist(), strict=True):
                        kept = sum(1 << p % WINDOW for p in range(to + 1, end + 1))
                        path[row] &= np.uint64(kept)
                # a window that is full before the next look goes on by itself
                full = np.flatnonzero((size[:active] > end) & ~gone[:active] & (end + _LOOK - done[:active] >= WINDOW))
                gone[full] = True
                alone += full.tolist()
        for row in alone:
            a, b = int(start[row] + done[row]), int(start[row] + size[row])
            text = (codes[a:b] - 1).astype("<u4").tobytes().decode("utf-32-le").replace(" ", SPACE)
            self._final = self._text_of(int(before[row])) if before[row] >= 0 else None
            pieces = list(self.stream(text))
            found = np.array([self._piece(x) for x in pieces], np.int32)
            final.append((np.full(len(found), row), done[row] + np.cumsum([len(x) for x in pieces]), found))
        if not final:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        segment, position, piece = (np.concatenate([f[k] for f in final]) for k in range(3))
        piece = piece[np.lexsort((position, segment))]
        return piece, np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=n))])

    def _piece(self, text: str) -> int:
        return self.ids[text] if text in self.ids else len(self.pieces) + ord(text) + 1

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the len+1 offsets of each text's."""
        # a space sign in the text itself is read as a space, as the vocabulary's own encoder does
        return self._encode([" " + t.replace(SPACE, " ") if t else "" for t in texts])

    def _encode(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts with their prefix; a long text is taken in parts that end where all paths meet."""
        if sum(map(len, whole)) >= len(_INV):
            if len(whole) > 1:
                half = len(whole) // 2
                (a, m), (b, n) = self._encode(whole[:half]), self._encode(whole[half:])
                return np.concatenate([a, b]), np.concatenate([m, n[1:] + m[-1]])
            parts, at = [], 0
            while len(whole[0]) - at >= len(_INV) and (end := _meeting(whole[0], at, at + len(_INV) // 2)) > at:
                parts.append(whole[0][at:end])
                at = end
            rest = whole[0][at:]
            if parts:
                ids, _ = self._encode([*parts, rest])
            else:  # a single segment
                self._final = None
                ids = self._expanded(np.array([self._piece(x) for x in self.stream(rest.replace(" ", SPACE))], np.int32), np.zeros(1, np.int64))[0]
            return ids, np.array([0, len(ids)])
        codes = _codes("".join(whole))
        at = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(whole) + 1, np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), _sums(codes)])
        feed, space = codes == 11, codes == 33
        first = feed.copy()
        first[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        first[at[:-1][at[:-1] < len(codes)]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(codes)))
        value = mix((sums[start + size] - sums[start]) * _INV[start]) ^ size.astype(np.uint64)
        _, pick, which = np.unique(value, return_index=True, return_inverse=True)
        # a segment whose characters aren't those of its like by hash stands for itself
        like = start[pick][which]
        differs = codes[np.arange(len(codes)) + np.repeat(like - start, size)] != codes
        if differs.any():
            odd = np.unique(np.searchsorted(start, np.flatnonzero(differs), "right") - 1)
            which[odd] = len(pick) + np.arange(len(odd))
            pick = np.concatenate([pick, odd])
        order = np.argsort(-size[pick], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pieces, offsets = self._walk(sums, codes, start[pick[order]], size[pick[order]])
        ids, offsets = self._expanded(pieces, offsets)
        begin, each = offsets[:-1][place[which]], np.diff(offsets)[place[which]]
        ends = np.cumsum(each)
        out = ids[np.repeat(begin - (ends - each), each) + np.arange(ends[-1])]
        segment_of_text = np.searchsorted(start, at)
        return out, np.concatenate([[0], ends])[segment_of_text]

    def _expanded(self, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, characters outside the vocabulary as their bytes, and the offsets moved along."""
        outside = np.flatnonzero(pieces >= len(self.pieces))
        if not len(outside):
            return pieces, offsets
        raw = [self._text_of(int(p)).encode() for p in pieces[outside]]
        each = np.ones(len(pieces), np.int64)
        each[outside] = [len(r) for r in raw]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = np.repeat(pieces, each)
        for k, r in zip(outside.tolist(), raw, strict=True):
            out[ends[k] : ends[k + 1]] = [self.bytes[b] for b in r]
        return out, ends[offsets]

    def merged(self, text: str, seen: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The pieces of a short text by merging the best pair (the leftmost of equals) again and again.

        ``seen`` gets each merge's score and the first and last piece after it.
        """
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.pieces[k][1] > best):
                    best, at = self.pieces[k][1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if seen is not None:
                seen.append((best, parts[0], parts[-1]))

    def _merges(self, piece: str) -> list[tuple[float, str, str]]:
        known = self._history.get(piece)
        if known is None:
            known = self._history[piece] = []
            self.merged(piece, known)
        return known

    def _stays(self, a: str, b: str) -> bool:
        """Whether no merge crosses the boundary while a and b are merged side by side, each in its own order."""
        left, right, ids, pieces = self._merges(a), self._merges(b), self.ids, self.pieces
        i = j = 0
        end, begin = a[-1], b[0]
        while True:
            k = ids.get(end + begin)
            x = left[i][0] if i < len(left) else None
            y = right[j][0] if j < len(right) else None
            if k is not None:
                cross = pieces[k][1]
                if (x is None or cross > x) and (y is None or cross >= y):
                    return False
            if x is not None and (y is None or x >= y):
                end = left[i][2]
                i += 1
            elif y is not None:
                begin = right[j][1]
                j += 1
            else:
                return True

    def _stable(self, a: str, b: str) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= 2 * CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self._stays(a, b)
        return known

    def _alone(self, a: str) -> bool:
        return len(a) == 1 or bool(self.alone[self.ids[a]])

    def stream(self, text: str) -> Iterator[str]:
        """Pieces of ``text`` (spaces already written as the space sign), each given out as soon as it is final."""
        ids, longest = self.ids, self.longest
        last: dict[int, str] = {}  # position -> last piece of the path that ends there, for positions not yet final
        done = 0
        for end in range(1, len(text) + 1):
            for begin in range(max(done, end - longest), end):
                piece = text[begin:end]
                if begin + 1 < end and piece not in ids:
                    continue
                before = last.get(begin) if begin > done else self._final
                if begin > done and before is None:
                    continue
                if self._alone(piece) and (before is None or self._stable(before, piece)):
                    last[end] = piece
                    break
            if end - done >= 4 * longest:
                done = yield from self._commit(last, done, end, range(end - longest + 1, end + 1))
        yield from self._commit(last, done, len(text), (len(text),))

    def _commit(self, last: dict[int, str], done: int, end: int, live) -> Iterator[str]:
        """Gives out what all paths to the live positions share, and forgets it; the new first open position."""
        common: set[int] | None = None
        for p in live:
            if p in last:
                boundaries = set()
                while p > done:
                    boundaries.add(p)
                    p -= len(last[p])
                common = boundaries if common is None else common & boundaries
        at = max(common or {done})
        path, p = [], at
        while p > done:
            path.append(last[p])
            p -= len(last[p])
        yield from reversed(path)
        if path:
            self._final = path[0]
        for p in range(done, at + 1):
            last.pop(p, None)
        return at

    _final: str | None = None

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian int32."""
        return self.encode_batch([text])[0].astype("<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid UTF-8 from byte pieces is replaced."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.decode(errors="replace").removeprefix(" ")


def _codes(text: str) -> np.ndarray:
    """Code points plus 1."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1


def _sums(codes: np.ndarray) -> np.ndarray:
    return np.cumsum(codes.astype(np.uint64) * _POW[: len(codes)])


#: Where all paths meet: before a run of spaces, and on either side of a line feed.
_MEETING = re.compile(r"(?<! )(?= )|(?=\n)|(?<=\n)")


def _meeting(text: str, at: int, to: int) -> int:
    """A place after ``at`` where all paths meet: the last one up to ``to``, or else the first one beyond; ``at`` without any."""
    for low in range(to - 1024, at, -65536):
        if found := [m.start() for m in _MEETING.finditer(text, max(low, at + 1), to) if m.start() > max(low, at + 1)]:
            return found[-1]
    found = next((m.start() for m in _MEETING.finditer(text, at + 1)), len(text))
    return found if found < len(text) else at


def _vocabulary(path: str) -> tuple[list[tuple[str, float, int]], np.ndarray, str]:
    """Pieces, which of them merge to themselves, and a digest that tells vocabularies apart."""
    codec = Codec(read_model(path))
    return codec.pieces, codec.alone, hashlib.sha256(repr(codec.pieces).encode()).hexdigest()


_CODECS: dict[str, Codec] = {}


def _codec(held) -> Codec:
    """The worker's codec of a broadcast vocabulary, with its caches, kept from task to task."""
    pieces, alone, key = held.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(pieces, alone)
    return _CODECS[key]


def _encoder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            names = batch.schema.names
            kept = [n for n in names if n != "ids"]
            _, at = utf8(batch.column(names.index("text")))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1)
                part = batch.slice(lo, hi - lo)
                coded, offsets = codec.encode_batch([t or "" for t in part.column(names.index("text")).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(coded))
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in kept), ids], [*kept, "ids"])
                lo = hi

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ids (array of int) of the whole text; a null or empty text has none (an empty array).

    A column named ids is replaced, all others stay; repeated rows each have theirs; an empty table gives an empty one.
    """
    of = set_aside(docs)
    held = docs.sparkSession.sparkContext.broadcast(_vocabulary(model_path))  # one vocabulary, about 1 MB
    return put_back(of.mapInArrow(_encoder(held), T.StructType([*of.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])), docs.columns, ("ids",))


def _decoder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            names = batch.schema.names
            kept = [n for n in names if n != "decoded"]
            column = batch.column(names.index("ids"))
            texts = [codec.decode(x.values.to_numpy()) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return run


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``coded`` with decoded, the text of its ids (null for null ids); a column of that name is replaced, all others stay."""
    of = set_aside(coded, ("ids",))
    held = coded.sparkSession.sparkContext.broadcast(_vocabulary(model_path))
    return put_back(of.mapInArrow(_decoder(held), T.StructType([*of.schema.fields, T.StructField("decoded", T.StringType())])), coded.columns, ("decoded",), ("ids",))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _round_trip(held):
    """Encodes and decodes in one pass, so that each core has one Python worker with one vocabulary."""
    encoder = _encoder(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in encoder(batches):
            ids = batch.column(2)
            bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [(t or "") == codec.decode(p) for t, p in zip(batch.column(1).to_pylist(), parts, strict=True)]
            sums = [hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    return run


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian int32), round_trip (decoding gives the text again)."""
    path = model_path or default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = spark.sparkContext.broadcast(_vocabulary(path))
    return docs.mapInArrow(_round_trip(held), T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_ids long, ids_sha256 string, round_trip boolean").fields]))
