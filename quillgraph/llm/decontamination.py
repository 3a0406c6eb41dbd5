"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, and a scan of all documents.

Words are runs of letters, digits and non-ASCII characters, ASCII capitals folded. Every run of ``width``
consecutive item words is a window; an item of fewer words is one window as a whole. Each executor holds the
windows' 64-bit hashes with their words; a document's window hashes are looked up there and every hit is
verified word by word, so results are exact. The broadcast is bounded: the windows are counted first, and
beyond ``max_windows`` they are split by their words, so that even a single long item is, into blocks which scan
the documents one after the other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import put_back, saved, set_aside, table
from quillgraph.llm._text import ALNUM, Words, blocks

WIDTH = 10
#: Windows of one broadcast: flat arrays of about 100 bytes each, 100 MB at most.
MAX_WINDOWS = 1_000_000
#: Windows of a batch on the way from an item's text.
_PART = 50_000
NAMES = ("n_words", "n_hit", "spans", "items")


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1)):
                words = Words(data, at, ALNUM)
                for i, item in enumerate(batch.column(0)[lo:hi].to_pylist()):
                    first, end = int(words.first[i]), int(words.first[i + 1])
                    k = min(width, end - first)
                    for p in range(first, end - k + 1 if k else first, _PART):
                        part = range(p, min(end - k + 1, p + _PART))
                        hashes = np.array([words.sequence_hash(q, q + k) for q in part], np.uint64).view(np.int64)
                        texts = pa.array([words.text(q, q + k) for q in part], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(np.full(len(part), k, np.int32)), pa.array(hashes), texts], ["item", "size", "hash", "words"])

    return run


class _WindowSet:
    """Windows of a block of the benchmark as flat arrays: by window size the sorted hashes, and where each one's words and
    items stand."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        size, hashes = rows["size"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        order = np.lexsort((hashes, size))
        self.words = rows["words"].combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        named = rows["item"].combine_chunks().dictionary_encode()
        self.names = named.dictionary.to_pylist()
        self.item = named.indices.to_numpy()[order]
        size, hashes = size[order], hashes[order]
        #: window size -> (its first row, sorted hashes, a first look at 20 bits of the hash)
        self.by_size: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for k in np.unique(size).tolist():
            a, b = np.searchsorted(size, [k, k + 1])
            low = np.zeros(1 << 20, bool)
            low[(hashes[a:b] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[k] = (int(a), hashes[a:b], low)

    def scan(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end word, items) of every verified window."""
        for k, (base, hashes, low) in self.by_size.items():
            at, found = words.windows(k)
            likely = np.flatnonzero(low[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
            a, b = np.searchsorted(hashes, found[likely], "left"), np.searchsorted(hashes, found[likely], "right")
            for p, lo, hi in zip(at[likely].tolist(), a.tolist(), b.tolist(), strict=True):
                if lo < hi:
                    own = words.text(p, p + k)
                    if items := {self.names[self.item[base + r]] for r in range(lo, hi) if self.words[base + r].as_py() == own}:
                        yield p, p + k, items


def _scanner(held, carried: bool):
    """Adds the hits of one block of windows to n_words, spans (byte ranges of runs of hit words) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: _WindowSet = held.value
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            n_words, spans, n_hit, items = [], [], [], []
            for lo, hi, data, at in blocks(text):
                words = Words(data, at, ALNUM)
                hit = np.zeros(len(words) + 1, bool)
                found: dict[int, set[str]] = defaultdict(set)
                for p, q, their in windows.scan(words):
                    hit[p:q] = True
                    found[int(words.doc[p])] |= their
                if carried:
                    earlier = batch.column(batch.schema.names.index("spans"))[lo:hi].to_pylist()
                    before = batch.column(batch.schema.names.index("items"))[lo:hi].to_pylist()
                    for i, (a, b) in enumerate(zip(earlier, before, strict=True)):
                        for s in a:
                            inside = slice(*np.searchsorted(words.start, [at[i] + s["start"], at[i] + s["end"]]))
                            hit[inside] = True
                        found[i] |= set(b)
                total = np.concatenate([[0], np.cumsum(hit[:-1])])
                n_hit.append(total[words.first[1:]] - total[words.first[:-1]])
                n_words.append(words.count)
                own: dict[int, list] = defaultdict(list)
                begins = np.flatnonzero(hit[:-1] & ~np.concatenate([[False], hit[:-2]]) | hit[:-1] & (np.concatenate([[-1], words.doc[:-1]]) != words.doc)) if hit.any() else ()
                for b in begins:
                    d, e = int(words.doc[b]), int(b)
                    while hit[e] and words.doc[e] == d:
                        e += 1
                        if e == len(words):
                            break
                    own[d].append({"start": int(words.start[b] - at[d]), "end": int(words.end[e - 1] - at[d])})
                spans += [own.get(i, []) for i in range(hi - lo)]
                items += [sorted(found.get(i, ())) for i in range(hi - lo)]
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in ("n_words", "n_hit", "spans", "items")]
            columns = [c for _, c in kept] + [
                pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                pa.array(np.concatenate(n_hit) if n_hit else [], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in kept] + ["n_words", "n_hit", "spans", "items"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (byte ranges of hit words in the text) and items (ids as strings, sorted).

    A null or empty text has no words; items without words, or with null ids, match nothing; repeated items
    and documents count each. Columns of ``docs`` with the result's names are replaced. With an empty benchmark
    nothing is hit; an empty table of documents gives an empty one.
    """
    return put_back(_scanned(set_aside(docs), benchmark, width, max_windows), docs.columns, NAMES)


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, max_windows: int, drop_share: float | None = None) -> DataFrame:
    """What :func:`find_contamination` gives; with ``drop_share``, ``docs`` cut by it in the same pass over the texts."""
    spark = docs.sparkSession
    item = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    # a window that an item has twice counts once
    windows = saved(item.mapInArrow(_item_windows(width), "item string, size int, hash long, words binary").distinct())
    n = windows.count()
    parts = max(1, -(-n // max_windows))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>").fields])
    out = docs
    for k in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k).toArrow()  # about max_windows at most
        scan = _scanner(spark.sparkContext.broadcast(_WindowSet(rows)), k > 0)
        cuts = drop_share is not None and k == parts - 1
        out = out.mapInArrow(_cutting(scan, drop_share), docs.schema) if cuts else out.mapInArrow(scan, schema)
        if parts > 1:
            out = saved(out)
    return out


def _cutting(scan, drop_share: float):
    """The scan, then the cut, in one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            words, hit = (batch.column(batch.schema.names.index(n)).to_numpy() for n in ("n_words", "n_hit"))
            yield from _cutter(iter([batch.filter(pa.array((hit == 0) | (hit < drop_share * words)))]))

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, spans = batch.column(names.index("text")).to_pylist(), batch.column(names.index("spans"))
        for i in np.flatnonzero(np.diff(spans.offsets.to_numpy())) if len(spans) else ():
            raw, out, done = texts[i].encode(), [], 0
            for s in spans[int(i)].as_py():
                out.append(raw[done : s["start"]])
                done = s["end"]
            texts[i] = b"".join([*out, raw[done:]]).decode()
        kept = [n for n in names if n not in ("n_words", "n_hit", "spans", "items")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(names.index(n)) for n in kept], kept)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop_share: float = 0.8, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without hit words; documents of which ``drop_share`` of the words are hit go as a whole.

    Documents without hits stay as they are, empty and null ones too; repeated rows are cut alike; all columns stay.
    """
    return put_back(_scanned(set_aside(docs), benchmark, width, max_windows, drop_share), docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_OP6 = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w,
         row_number() over () as rid
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
items as (
  select item_id, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p, w from iw where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from items),
ks as (select distinct k from win),
dwin as (
  select rid, k, unnest(range(1, len(w) - k + 2)) as p, w from dw, ks where len(w) >= k),
hits as (
  select rid, p, win.k, item_id from (select rid, k, p, array_to_string(w[p:p + k - 1], ' ') as g from dwin) d join win on d.k = win.k and d.g = win.g),
hitwords as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + k)) as q from hits) group by rid),
found as (select rid, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(f.n, 0) as bigint) as n_items,
       sha256(coalesce(f.s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from dw left join hitwords h using (rid) left join found f using (rid)
"""
