"""MinHash near-deduplication with HyperMinHash registers.

A document's 5-word shingles are hashed once; each of the ``bands * rows`` buckets scrambles that hash in its own
way, and its register keeps, of the smallest value, the number of leading zeros and the ten bits after the leading
one (16 bits instead of 64). Runs of ``rows`` registers are the band keys. (Buckets are independent hash functions
rather than a split of one hash, so that short documents fill all of them.) Candidates from equal band keys
must pass an estimate of the Jaccard similarity, corrected for chance register collisions, and then a check of the
full shingle sets.

No step lists all pairs of a group. Equal shingle sets are one class with one representative. In a band bucket each
representative is compared with one of the bucket only, its centre; links become components. Two that were compared with
one centre but still lie in different components may be alike nevertheless. Such members are joined by prefixes: of sets
ordered alike, rare shingles first, two that are alike enough share one of the first few, whatever the order. Texts
around a common passage have prefixes of their own words, so that they don't meet. A centre's members that share prefix
shingles with others, of other components, form a group, in which those outside the largest component are
compared with all, in pairs of blocks of bounded size; where many are outside, each shingle has a group of its own. After
that every candidate pair was either checked or is joined by checked links.

Texts are moved only where they may be needed, and in turns: what one moves is a fraction of all texts, and its shuffle files
go before the next begins.

Keys that many rows share (a set, a band key, a centre, a common shingle) meet only tables that are kept with one row a
key, in joins that adaptive execution can split, or are dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._table import components, perhaps, put_back, saved, set_aside, table
from quillgraph.llm._text import SPACED, Words, blocks, mix, shingle_sets

SHINGLE = 5
BANDS, ROWS = 24, 4
MANTISSA = 10
#: The estimate of 96 registers has a deviation of at most 0.05; pairs are verified from 4 of them below the threshold on.
MARGIN = 0.2
#: Shingles of a block of members that are compared with a centre, which each block has a copy of, or with those of another
#: block; and of members outside a group's largest component, from which on shingles have groups of their own.
BLOCK, APART = 1 << 14, 1 << 17
#: A turn moves texts of one in so many of all shingles, and of so many at least.
TURNS, TURN = 4, 1 << 22
#: Counters by which shingles are ordered, common ones last. More shingles share them; any order gives the same links.
COUNTERS = 1 << 18
_RNG = np.random.default_rng(7)
_FACTOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: 6 bits of leading zeros, 10 of mantissa) of sets hashes[first[i]:first[i+1]], none empty."""
    out = np.empty((len(first) - 1, len(_FACTOR)), np.uint16)
    for j, (f, a) in enumerate(zip(_FACTOR, _ADD, strict=True)):
        least = np.minimum.reduceat(hashes * f + a, first[:-1])
        # a float64 of the upper 53 bits has the position of the leading one as exponent and what follows as mantissa
        bits = ((least >> np.uint64(11)) | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
        out[:, j] = (bits - (np.uint64(1023) << np.uint64(MANTISSA))).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets of n and m shingles from their registers, without the expected chance collisions."""
    same = (a == b).mean(axis=1)
    ratio = np.minimum(n, m) / np.maximum(n, m)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same - chance) / (1 - chance)


def _set_key(own: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set of shingle hashes."""
    return np.array([np.add.reduce(mix(own)), np.bitwise_xor.reduce(mix(own + np.uint64(77)))], np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in blocks(batch.column(1)):
            hashes, first = shingle_sets(Words(data, at, SPACED), SHINGLE)
            size = np.zeros(hi - lo, np.int64)
            sets = np.zeros((hi - lo, 2), np.int64)
            some = np.flatnonzero(np.diff(first))
            regs: list[bytes | None] = [None] * (hi - lo)
            bands: list[np.ndarray | None] = [None] * (hi - lo)
            if len(some):
                for i in some:
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    size[i] = len(own)
                    sets[i] = _set_key(own)
                rows = registers(hashes, np.append(first[some], first[-1]))
                packed = rows.reshape(len(some), BANDS, ROWS).view(np.uint64)[:, :, 0]  # four registers of 16 bits
                keys = mix(mix(packed) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                for k, i in enumerate(some):
                    regs[i], bands[i] = rows[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], pa.array(size), pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "regs", "bands"],
            )


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
                n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                # sizes alone bound the similarity
                good = (estimate(a, b, n, m) >= threshold - MARGIN) & (np.minimum(n, m) >= (threshold - 1e-9) * np.maximum(n, m))
                yield batch.select(["a", "set_a", "n_a", "b", "set_b"]).filter(pa.array(good))

    return run


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    for lo, hi, data, at in blocks(column):
        hashes, first = shingle_sets(Words(data, at, SPACED), SHINGLE)
        for i in range(hi - lo):
            yield np.unique(hashes[first[i] : first[i + 1]])


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([_set_key(own)[0] if len(own) else 0 for own in _sets(batch.column(1))], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), batch.column(1)], ["doc_id", "set", "text"])


def _with_centre(percent: int):
    """Links of members to their centre, whose row comes before theirs, from full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("b", "set_b", "block", "role")), strict=True)
            good = np.zeros(batch.num_rows, bool)
            for i, ((*own_key, role), own) in enumerate(zip(rows, _sets(batch.column("text")), strict=True)):
                if role == 0:
                    key, centre = own_key, own
                elif key == own_key:
                    both = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum())
                    good[i] = both > 0 and 100 * both >= percent * (len(own) + len(centre) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for own in _sets(batch.column(0)):
            np.add.at(total, (mix(own) % np.uint64(COUNTERS)).astype(np.int64), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["counter", "n"])


def _prefixes(held, percent: int):
    """The first shingles of each set, common ones last, of which sets that are alike enough share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: np.ndarray = held.value
        for batch in batches:
            chosen: list[np.ndarray] = []
            size = np.zeros(batch.num_rows, np.int64)
            for i, own in enumerate(_sets(batch.column("text"))):
                size[i] = len(own)
                order = np.lexsort((own, common[(mix(own) % np.uint64(COUNTERS)).astype(np.int64)]))
                chosen.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]])
            rows = np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen])
            shingles = np.concatenate([*chosen, np.zeros(0, np.uint64)]).view(np.int64)
            kept = batch.select(["a", "set", "root"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(shingles), *kept.columns, pa.array(size[rows])], ["shingle", "a", "set", "root", "n"])

    return run


def _between(percent: int):
    """Links between the members of a pair of blocks that lie in different components so far, from full shingle sets."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("block", "ascending"), ("doc_id", "ascending")])
        ids, roots = group["doc_id"].to_numpy(), group["root"].to_numpy()
        main, block = group["main"].to_numpy(), group["block"].to_numpy()
        sets = list(_sets(group["text"].combine_chunks()))
        size = np.array([len(x) for x in sets])
        known, members = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        two = block[0] != block[-1]
        found: list[tuple] = []
        marked = np.zeros(len(known), np.int32)
        for x in np.flatnonzero(~main):
            own = members[first[x] : first[x + 1]]
            marked[own] = 1
            running = np.concatenate([[0], np.cumsum(marked[members])])
            both = running[first[1:]] - running[first[:-1]]
            marked[own] = 0
            good = (roots != roots[x]) & (100 * both >= percent * (size + size[x] - both))
            if two:  # pairs within a block are looked at elsewhere
                good &= block != block[x]
            some = np.flatnonzero(good)
            # one link to each component tells as much as all
            for y in some[np.unique(roots[some], return_index=True)[1]]:
                found.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
        kind = group.schema.field("doc_id").type
        return pa.table({"a": pa.array([a for a, _ in found], kind), "b": pa.array([b for _, b in found], kind)})

    return run


def _in_turns(moved: int | None, most: int, part: Callable[[Column], DataFrame], *by: str) -> DataFrame:
    """``part`` of a condition, for as many conditions on the values of ``by`` as leave each ``most`` of ``moved`` shingles."""
    n = max(1, -(-(moved or 0) // most))
    done = [saved(part(F.pmod(F.xxhash64(F.lit("turn"), *by), F.lit(n)) == k if n > 1 else F.lit(True))) for k in range(n)]
    return reduce(DataFrame.unionByName, done)


def _compared(groups: DataFrame, key: list[str], plan: DataFrame, texts: DataFrame, percent: int, pair: T.StructType, most: int) -> DataFrame:
    """Links between members (a, set, root) of different roots in each group of ``key``; ``plan`` has a group's largest root
    (main), that one's shingles (most) and all (size)."""
    # p blocks of what is outside of the largest component, then q of that component; a single block of a small group
    whole = F.col("size") <= BLOCK
    p, q = F.when(whole, 1).otherwise(F.ceil((F.col("size") - F.col("most")) / BLOCK)), F.when(whole, 0).otherwise(F.ceil(F.col("most") / BLOCK))
    copies = (F.col("size") - F.col("most")) * (p + q) + F.col("most") * p
    plan = saved(plan.select(*key, "main", p.cast("int").alias("p"), q.cast("int").alias("q"), copies.cast("long").alias("copies")))
    moved = plan.agg(F.sum("copies")).first()[0]
    dealt = groups.join(plan.drop("copies"), key).withColumn("main", F.col("root") == F.col("main"))
    own, apart = F.xxhash64("a", "set"), F.col("main") & (F.col("q") > 0)
    dealt = dealt.withColumn("block", F.when(apart, F.col("p") + F.pmod(own, F.greatest("q", F.lit(1)))).otherwise(F.pmod(own, F.col("p"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("p")).otherwise(F.col("p") + F.col("q")) - 1)))
    dealt = dealt.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("a").alias("doc_id"), "set", "root", "main")
    # dealt by number, as partitions of few bytes, which take long here, would be put together otherwise
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def part(rows: Column) -> DataFrame:
        met = dealt.where(rows).join(texts, ["doc_id", "set"]).repartition(n, *key, "i", "j")
        return met.groupBy(*key, "i", "j").applyInArrow(_between(percent), pair)

    return _in_turns(moved, most, part, *key, "i", "j")


def _plan(groups: DataFrame, key: list[str]) -> DataFrame:
    by_root = groups.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"))
    largest = F.struct("n", "root")
    return by_root.groupBy(*key).agg(F.max_by("root", largest).alias("main"), F.max_by("size", largest).alias("most"), F.sum("size").alias("size"))


def _remainder(around: DataFrame, texts: DataFrame, percent: int, pair: T.StructType, most: int) -> DataFrame:
    """Links (a, b) between members (a, set, root) of different roots, of ``around`` (centre b, set_b)."""
    spark, key = around.sparkSession, ["b", "set_b"]
    torn = saved(around.groupBy(*key).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(*key))
    loose = saved(around.join(torn, key))
    if loose.isEmpty():
        return spark.createDataFrame([], pair)
    of = loose.select("a", "set", "root").distinct().join(texts.withColumnRenamed("doc_id", "a"), ["a", "set"])
    counted = saved(of.select("text").mapInArrow(_counters, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))).toArrow()  # COUNTERS rows
    common = np.zeros(COUNTERS, np.int64)
    common[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    held = spark.sparkContext.broadcast(common)  # 2 MB
    fields = {f.name: f for f in loose.schema.fields}
    prefix = saved(of.mapInArrow(_prefixes(held, percent), T.StructType([T.StructField("shingle", T.LongType()), fields["a"], fields["set"], fields["root"], T.StructField("n", T.LongType())])))
    # shingles of several components
    tags = [F.bit_xor(F.xxhash64("a", "set", F.lit(k))).alias(f"tag_{k}") for k in (1, 2)]
    shared = prefix.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("members"), *tags)
    shared = saved(shared.where("least <> most").drop("least", "most"))
    bound = prefix.join(shared.select("shingle"), "shingle").select("a", "set", "n").distinct()
    member = saved(loose.join(bound, ["a", "set"]))
    plan = saved(_plan(member, key).where("size > most"))
    outside = F.col("size") - F.col("most")
    found = _compared(member, key, plan.where(outside <= APART), texts, percent, pair, most)
    many = plan.where(outside > APART).select(*key)
    if not many.isEmpty():
        # of shingles that the same members have, one; a group of them needs no centre
        chosen = saved(shared.groupBy("members", "tag_1", "tag_2").agg(F.min("shingle").alias("shingle")).select("shingle"))
        groups = saved(prefix.join(chosen, "shingle").join(member.join(many, key).select("a", "set").distinct(), ["a", "set"]))
        found = found.unionByName(_compared(groups, ["shingle"], _plan(groups, ["shingle"]), texts, percent, pair, most))
    return saved(found.distinct())


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept (whether that is itself).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct 5-word shingles (words:
    runs without white space, ASCII capitals folded; fewer than five words: their whole sequence is the one shingle).
    Null, empty and blank texts have no shingles and no links. Rows with the same doc_id are one document, with the sets
    of each row: every row is returned, with the same component. A null doc_id has no links: component null, kept true.
    Other columns don't matter; an empty table gives an empty one. Shingles are compared by hashes of 64 bits, sets as a
    whole by 128.
    """
    of = docs.select("doc_id", "text")
    sig = saved(of.mapInArrow(_signatures, T.StructType([of.schema["doc_id"], *T._parse_datatype_string("n_shingles long, set_a long, set_b long, regs binary, bands array<long>").fields])))
    whole = ["set_a", "set_b", "n_shingles"]
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    some = sig.where(linkable)
    # a class is known by its representative and half of its set's key, as one doc_id may represent several
    reps = saved(some.groupBy(*whole).agg(F.min(F.struct("doc_id", "regs", "bands")).alias("x")).select(*whole, F.col("x.doc_id").alias("rep"), "x.regs", "x.bands"))
    several = saved(some.groupBy("doc_id").agg(F.min("set_a").alias("least"), F.max("set_a").alias("most")).where("least <> most").select("doc_id"))
    own = None
    if not several.isEmpty():
        own = some.select("doc_id", *whole).join(several, "doc_id").distinct().join(reps.select(*whole, "rep"), whole).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    # equal keys of several representatives
    member = reps.select(F.col("rep").alias("a"), F.col("set_a").alias("set"), F.explode("bands").alias("key"))
    centre = saved(member.groupBy("key").agg(F.min("a").alias("b"), F.min_by("set", "a").alias("set_b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    star = saved(member.join(centre, "key").where("a <> b or set <> set_b").select("a", F.col("set").alias("set_a"), "b", "set_b").distinct())
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("set_a").alias(f"set_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    pair = T.StructType([star.schema["a"], star.schema["b"]])
    both = star.join(side("a"), ["a", "set_a"]).join(side("b"), ["b", "set_b"]).select("a", "set_a", "n_a", "regs_a", "b", "set_b", "n_b", "regs_b")
    likely = saved(both.mapInArrow(_likely(percent / 100), T.StructType([star.schema["a"], star.schema["set_a"], T.StructField("n_a", T.LongType()), star.schema["b"], star.schema["set_b"]])))

    # texts of all that stand in a bucket with others, one of each class
    wanted = saved(star.select(F.col("a").alias("doc_id")).unionByName(star.select(F.col("b").alias("doc_id"))).distinct())
    most = max(TURN, (sig.agg(F.sum("n_shingles")).first()[0] or 0) // TURNS)
    near = perhaps(of, wanted).where("perhaps").select("doc_id", "text")
    with_set = T.StructType([of.schema["doc_id"], T.StructField("set", T.LongType()), T.StructField("text", T.StringType())])

    def gathered(rows: Column) -> DataFrame:
        return near.where(rows).join(wanted, "doc_id", "left_semi").mapInArrow(_with_set, with_set).dropDuplicates(["doc_id", "set"])

    moved = some.join(wanted, "doc_id", "left_semi").agg(F.sum("n_shingles")).first()[0]
    texts = _in_turns(moved, most, gathered, "doc_id")

    # a centre's text goes once to each block of its members
    heavy = saved(likely.groupBy("b", "set_b").agg(F.sum("n_a").alias("size")).where(F.col("size") > BLOCK))
    dealt = likely.join(heavy, ["b", "set_b"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("a", "set_a"), F.ceil(F.col("size") / BLOCK)), F.lit(0)).cast("int"))
    dealt = saved(dealt.select("b", "set_b", "block", F.lit(1).alias("role"), F.col("a").alias("doc_id"), F.col("set_a").alias("set")))
    centres = dealt.select("b", "set_b", "block").distinct().select("b", "set_b", "block", F.lit(0).alias("role"), F.col("b").alias("doc_id"), F.col("set_b").alias("set"))

    def checked(rows: Column) -> DataFrame:
        meet = dealt.unionByName(centres).where(rows).join(texts, ["doc_id", "set"]).select("b", "set_b", "block", "role", F.col("doc_id").alias("a"), "text")
        meet = meet.repartition("b", "set_b", "block").sortWithinPartitions("b", "set_b", "block", "role")
        return meet.mapInArrow(_with_centre(percent), pair)

    # with a centre's own text in each block
    links = _in_turns(2 * (likely.agg(F.sum("n_a")).first()[0] or 0), most, checked, "b", "set_b", "block")
    parts = components(links if own is None else links.unionByName(own))
    around = star.select("b", "set_b", "a", F.col("set_a").alias("set")).join(parts.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rest = _remainder(around, texts, percent, pair, most)
    # what is found there joins components that are settled otherwise
    roots = parts if rest.isEmpty() else components(rest.unionByName(parts.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    of_class = saved(reps.select(*whole, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*whole, F.coalesce("root", "rep").alias("component_id")))
    linked = some.select("doc_id", *whole).join(of_class, whole).select("doc_id", "n_shingles", "component_id")
    alone = sig.where(~linkable | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest doc_id, with all its rows."""
    gone = saved(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct())
    of = perhaps(set_aside(docs), gone)
    kept = of.where("not perhaps").unionByName(of.where("perhaps").join(gone, "doc_id", "left_anti"))
    return put_back(kept, docs.columns)


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP9 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select doc_id, list_distinct(case when text_w = 0 then [] when text_w < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, text_w - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from (select doc_id, w, coalesce(len(w), 0) as text_w from w)),
one as (select doc_id, unnest(s) as g from sh),
n as (select doc_id, cast(coalesce(len(s), 0) as bigint) as n from sh),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as c from one x join one y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
edges as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from n union select edges.b, reach.r from reach join edges on edges.a = reach.doc_id and reach.r < edges.b)
select n.doc_id, n.n as n_shingles, min(r) as component_id, min(r) = n.doc_id as kept from n join reach using (doc_id) group by n.doc_id, n.n
"""
