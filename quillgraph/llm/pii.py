"""PII: bootstrapped contextual extraction.

Seed entities are e-mail addresses, IP addresses, card and phone numbers found by their form. The words around
them induce lexical patterns (the word before, the two words before, the word after). Spark scores the graph of
patterns and instances iteratively: a pattern's score is the share of all its places in the corpus that hold
identifiers believed so far, an instance's is the noisy-or of the patterns it stands in. Candidates are what isn't a seed
but has five digits or more: tokens, runs of successive tokens with digits, and matches of a seed's form that
fail its test. Those that high-confidence patterns vouch for are unseen identifiers; they are found wherever they stand.
Identifiers found prove further patterns, until neither the identifiers nor their scores change.

An identifier of fewer digits or of letters alone can't be told from a word wherever else it stands, so none is sought.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import put_back, saved, set_aside, table
from quillgraph.llm._text import SPACED, Words, blocks, mix

KINDS = ("email", "ip", "card", "phone", "context")
#: Scores have settled when a round adds less than this to all of them together.
SETTLED = 1e-6
#: Distinct believed instances that a pattern needs, and the confidence that patterns and instances need.
SUPPORT, CONFIDENCE = 3, 0.6
#: Digits of what may be an unseen identifier, at least, and tokens of a run that may be one, at most.
DIGITS, TOKENS = 5, 6
#: 64-bit hashes of one broadcast, 16 MB; more are taken in turn, in further passes.
MAX_HASHES = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start within a run of digits fails as its first digit does, so only that one is tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in time linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            end = m.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def formed_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes its kind's test) in code points, by kind and start."""
    for a, b in emails(text):
        yield "email", a, b, True
    for m in _IP.finditer(text):
        # parts are compared by length first: a very long run of digits isn't turned into a number
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and _luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    return [(kind, a, b) for kind, a, b, good in formed_spans(text) if good]


def _pattern(kind: int, value: int) -> int:
    return int(mix(np.array([value + kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0])


_EDGES = "\"'()[]{}<>.,;:!?#*&%$|=/\\-_+~`^"

_BLANK = " \t\n\v\f\r"


class _Document:
    """Base spans of one text, and its candidates outside of them: tokens with DIGITS digits, whole runs of two to TOKENS
    successive tokens with digits and DIGITS of them together, and matches that fail their test."""

    def __init__(self, words: Words, i: int, at: np.ndarray, digits_before: np.ndarray) -> None:
        self.words, self.first, self.end = words, int(words.first[i]), int(words.first[i + 1])
        self.origin = int(at[i])
        raw = words.data[at[i] : at[i + 1]]
        self.text = raw.tobytes().decode()
        #: code points before each byte
        self.points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        formed = list(formed_spans(self.text))
        self.base = [(kind, a, b) for kind, a, b, good in formed if good]
        taken = sorted((a, b) for _, a, b in self.base)
        #: where base spans start, ascending, and how far any of those up to each reaches
        self.starts, self.reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        found = {(a, b) for _, a, b, good in formed if not good and self._whole(a, b)}
        count = digits_before[words.end[self.first : self.end]] - digits_before[words.start[self.first : self.end]]
        run: list[tuple[int, int]] = []
        previous = -2
        for w in np.flatnonzero(count).tolist():
            a, b = (int(self.points[x - self.origin]) for x in (words.start[self.first + w], words.end[self.first + w]))
            if w != previous + 1 or not self.free(a, b):
                found |= self._of(run)
                run = []
            if self.free(a, b):
                run.append((a, b))
            previous = w
            if count[w] >= DIGITS:
                found.add(self._trimmed(a, b))
        found |= self._of(run)
        #: (start, end) in code points
        self.candidates = sorted((a, b) for a, b in found if len(_digits(self.text[a:b])) >= DIGITS and self.free(a, b))

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.reach[k - 1] <= a

    def _whole(self, a: int, b: int) -> bool:
        """Whether nothing but marks stands between a:b and the white space around."""
        while a and self.text[a - 1] in _EDGES:
            a -= 1
        while b < len(self.text) and self.text[b] in _EDGES:
            b += 1
        return (not a or self.text[a - 1] in _BLANK) and (b == len(self.text) or self.text[b] in _BLANK)

    def _trimmed(self, a: int, b: int) -> tuple[int, int]:
        inside = self.text[a:b].strip(_EDGES)
        a += self.text[a:b].find(inside)
        return a, a + len(inside)

    def _of(self, run: list[tuple[int, int]]) -> set[tuple[int, int]]:
        return {self._trimmed(run[0][0], run[-1][1])} if 2 <= len(run) <= TOKENS else set()

    def instance(self, a: int, b: int) -> int:
        raw = np.frombuffer(self.text[a:b].lower().encode(), np.uint8)
        # folded as a word of all its bytes; white space inside (phone numbers) counts as nothing
        raw = raw[SPACED.member[raw]]
        return int(Words(raw, np.array([0, len(raw)]), SPACED).hash[0])

    def patterns(self, a: int, b: int) -> list[int]:
        """Hashes of the patterns around code points a:b."""
        w, out = self.words, []
        lo = self.origin + int(np.searchsorted(self.points, a, "right")) - 1
        hi = self.origin + int(np.searchsorted(self.points, b, "left"))
        left = int(np.searchsorted(w.end, lo, "right")) - 1  # the last word that ends before
        right = int(np.searchsorted(w.start, hi, "left"))
        if left >= self.first:
            out.append(_pattern(1, int(w.hash[left])))
            if left - 1 >= self.first:
                out.append(_pattern(2, w.sequence_hash(left - 1, left + 1)))
        if right < self.end:
            out.append(_pattern(3, int(w.hash[right])))
        return out


def _documents(column: pa.Array) -> Iterator[tuple[int, _Document]]:
    """(row, document) of the texts that have a digit or an @."""
    for lo, hi, data, at in blocks(column):
        digit = (data >= 48) & (data <= 57)
        marks = np.concatenate([[0], np.cumsum(digit | (data == 64))])
        some = np.flatnonzero(marks[at[1:]] > marks[at[:-1]])
        if len(some):
            words, before = Words(data, at, SPACED), np.concatenate([[0], np.cumsum(digit)])
            for i in some.tolist():
                yield lo + i, _Document(words, i, at, before)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int, int, bool]] = []
        for _, d in _documents(batch.column(0)):
            for seed, found in ((True, [(a, b) for _, a, b in d.base]), (False, d.candidates)):
                for a, b in found:
                    inst = d.instance(a, b)
                    rows += [(p, inst, seed) for p in d.patterns(a, b)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (0, 1)] + [pa.array([r[2] for r in rows], pa.bool_())], ["pattern", "instance", "seed"]
        )


def _places(held):
    """How often each pattern occurs at all, whatever stands in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: np.ndarray = held.value
        for batch in batches:
            total = np.zeros(len(wanted), np.int64)
            for _, _, data, at in blocks(batch.column(0)):
                words = Words(data, at, SPACED)
                inner = np.ones(len(words), bool)
                inner[words.first[1:][words.count > 0] - 1] = False  # a last word has nothing after it
                outer = np.ones(len(words), bool)
                outer[words.first[:-1][words.count > 0]] = False
                pair_at, pairs = words.windows(2)
                pairs = pairs[inner[pair_at + 1]]
                for kind, values in ((1, words.hash[inner]), (2, pairs), (3, words.hash[outer])):
                    h = mix(values + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    total += np.bincount(k[wanted[k] == h], minlength=len(wanted))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["pattern", "places"])

    return run


def _in_turn(hashes: DataFrame, column: str, limit: int) -> Iterator[np.ndarray]:
    """Distinct hashes in sorted arrays of about ``limit`` at most; none if there are none."""
    n = hashes.count()
    for k in range(-(-n // limit)):
        part = hashes.where(F.pmod(F.xxhash64(column), F.lit(-(-n // limit))) == k).select(column).toPandas()[column]
        if len(part):
            yield np.sort(part.to_numpy(np.int64).view(np.uint64))


def learn(docs: DataFrame, max_hashes: int = MAX_HASHES) -> DataFrame:
    """(instance): hashes of the unseen identifiers that high-confidence patterns vouch for.

    None without texts, seeds or candidates. Instances and places are counted over all rows, repeated ones too; scores
    don't depend on the order of rows.
    """
    spark = docs.sparkSession
    of = docs.where("text is not null").select("text")
    edges = saved(of.mapInArrow(_edges, "pattern long, instance long, seed boolean").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    # a token seen as a seed anywhere is one
    seeds = edges.where("seed").select("instance").distinct()
    # only patterns that some candidate stands in can find anything, and only those of enough instances, whatever these are
    useful = saved(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.min("seed").alias("seed")).where((F.col("support") >= SUPPORT) & ~F.col("seed")).select("pattern"))
    places: DataFrame | None = None
    for part in _in_turn(useful, "pattern", max_hashes):
        held = spark.sparkContext.broadcast(part)
        counted = saved(of.mapInArrow(_places(held), "pattern long, places long").groupBy("pattern").agg(F.sum("places").alias("places")))
        places = counted if places is None else places.unionByName(counted)
    if places is None:
        return spark.createDataFrame([], "instance long")
    graph = saved(edges.join(places, "pattern").select("pattern", "instance", "n", "places"))
    believed = saved(seeds.select("instance", F.lit(1.0).alias("belief")))
    # beliefs only grow from round to round, and none beyond 1
    before = believed.agg(F.count(F.lit(1)), F.sum("belief")).first()
    while True:
        patterns = (
            graph.join(believed, "instance")
            .groupBy("pattern")
            .agg((F.sum(F.col("n") * F.col("belief")) / F.max("places")).alias("score"), F.count(F.lit(1)).alias("support"))
            .where((F.col("score") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        )
        vouched = graph.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief")).where(F.col("belief") >= CONFIDENCE)
        # the greater of old and new, which differ the other way by rounding alone
        believed = saved(believed.unionByName(vouched).groupBy("instance").agg(F.max("belief").alias("belief")))
        now = believed.agg(F.count(F.lit(1)), F.sum("belief")).first()
        if now[0] == before[0] and now[1] - before[1] < SETTLED:
            break
        before = now
    return believed.join(seeds, "instance", "left_anti").select("instance")


def _finder(held, carried: bool, mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = held.value
        for batch in batches:
            names = batch.schema.names
            spans: list[list[dict]] = batch.column(names.index("spans")).to_pylist() if carried else [[] for _ in range(batch.num_rows)]
            changed: dict[int, str] = {}
            for row, d in _documents(batch.column(names.index("text"))):
                own = {(s["kind"], s["start"], s["end"]) for s in spans[row]} | set(d.base)
                vouched: list[tuple[int, int]] = []
                for a, b in d.candidates if len(known) else ():
                    h = np.uint64(d.instance(a, b))
                    k = min(int(np.searchsorted(known, h)), len(known) - 1)
                    if known[k] == h:
                        vouched.append((a, b))
                own |= {("context", a, b) for a, b in vouched}
                # of identifiers within others, the outer
                within = [("context", a, b) for k, a, b in own if k == "context" and any(n == "context" and x <= a and b <= y and (x, y) != (a, b) for n, x, y in own)]
                own -= set(within)
                ordered = sorted(own, key=lambda s: (KINDS.index(s[0]), s[1]))
                spans[row] = [{"kind": k, "start": a, "end": b} for k, a, b in ordered]
                if mask and own:
                    out, done = [], 0
                    for k, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
                        if b <= done:
                            continue
                        if a >= done:  # else it goes on behind the span before, under that mark
                            out += [d.text[done:a], f"<{k.upper()}>"]
                        done = b
                    changed[row] = "".join([*out, d.text[done:]])
            kept = [n for n in names if n != "spans"]
            columns = [batch.column(names.index(n)) for n in kept]
            if changed:
                texts = columns[kept.index("text")].to_pylist()
                for row, t in changed.items():
                    texts[row] = t
                columns[kept.index("text")] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*kept, "spans"])

    return run


def find_pii(docs: DataFrame, mask: bool = False, max_hashes: int = MAX_HASHES) -> DataFrame:
    """``docs`` with spans (kind, start, end in code points; by kind as listed, then start); with ``mask``, the text
    has <KIND> in place of each.

    Null and empty texts have no spans; repeated rows each have theirs, and what they repeat counts once as an instance; a
    column named spans is replaced, all others stay. An empty table gives an empty one. Long texts are read whole.
    """
    spark = docs.sparkSession
    of = set_aside(docs)
    schema = T.StructType([*of.schema.fields, *T._parse_datatype_string("spans array<struct<kind:string,start:long,end:long>>").fields])
    parts = list(_in_turn(saved(learn(of, max_hashes)), "instance", max_hashes)) or [np.zeros(0, np.uint64)]
    out = of
    for k, part in enumerate(parts):
        out = out.mapInArrow(_finder(spark.sparkContext.broadcast(part), k > 0, mask and k == len(parts) - 1), schema)
    return put_back(out, docs.columns, ("spans",))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by marks; all columns and rows stay, n_chars follows the text."""
    out = put_back(find_pii(set_aside(docs), mask=True), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(written(F.filter("spans", lambda s: s["kind"] != "context")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
