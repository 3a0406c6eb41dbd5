"""Byte-level text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns, whose bytes already lie in one buffer; words and windows of words
are found and hashed for a whole batch with array operations, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240501)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW = _powers(_ODD, BLOCK_BYTES)
_INV = _powers(pow(_ODD, -1, 1 << 64), BLOCK_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordClass:
    """Which bytes belong to words, and the 64-bit value of each byte (ASCII capitals count as small letters)."""

    def __init__(self, separators: bytes, fold: dict[int, int] | None = None) -> None:
        self.member = np.ones(256, bool)
        self.member[list(separators)] = False
        self.value = _VALUES.copy()
        self.value[65:91] = self.value[97:123]
        for a, b in (fold or {}).items():
            self.value[a] = self.value[b]
        self.value[~self.member] = 0


#: Words are what stands between white space: [^\x20\x09-\x0D]+
SPACED = WordClass(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are letters, digits and all that isn't ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = WordClass(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, of about ``limit`` bytes or a single text."""
    data, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of a run of texts: byte ranges, hashes, and the text that each belongs to."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: WordClass) -> None:
        self.data, self.at, self.kind = data, at, kind
        inside = kind.member[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = at[:-1][at[:-1] < len(data)]
        first[begins] = inside[begins]
        last = inside
        last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i are first[i]:first[i+1]
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        self.hash = self._hash()

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            base = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, base + BLOCK_BYTES, "right")))
            stop = int(self.end[hi - 1])
            if stop - base <= BLOCK_BYTES:
                value = self.kind.value[self.data[base:stop]]
                value *= _POW[: stop - base]
                out[lo:hi] = np.add.reduceat(value, self.start[lo:hi] - base) * _INV[self.start[lo:hi] - base]
            else:  # one word longer than a block, in pieces
                total = 0
                for k, p in enumerate(range(base, stop, BLOCK_BYTES)):
                    piece = self.kind.value[self.data[p : min(stop, p + BLOCK_BYTES)]]
                    total += int(np.add.reduce(piece * _POW[: len(piece)])) * pow(_ODD, k * BLOCK_BYTES, 1 << 64)
                out[lo] = total & _MASK
            lo = hi
        return mix(out)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` consecutive words of one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = self.hash[:n].copy()
        for j in range(1, k):
            total += self.hash[j : j + n] * np.uint64(pow(_ODD, j, 1 << 64))
        whole = self.doc[:n] == self.doc[k - 1 :]
        at = np.flatnonzero(whole)
        return at, mix(total[at] + np.uint64(k))

    def sequence_hash(self, lo: int, hi: int) -> int:
        """Hash of words lo:hi as one window of that length; the same as windows(hi - lo) gives there."""
        k = hi - lo
        total = np.add.reduce(self.hash[lo:hi] * _powers(_ODD, k)) + np.uint64(k)
        return int(mix(np.array([total], np.uint64))[0])

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo:hi, lower-cased and joined by single spaces."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes().lower() for i in range(lo, hi))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, in text order, and the len+1 offsets of each text's.

    A text of fewer words has its whole sequence as one shingle; one without words has none. Repeats stay.
    """
    at, hashes = words.windows(k)
    owner = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.array([words.sequence_hash(words.first[i], words.first[i + 1]) for i in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, extra])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return hashes, np.searchsorted(owner, np.arange(len(words.at)))
