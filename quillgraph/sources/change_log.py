"""Change logs: line-delimited JSON and a checksummed binary format, read and written by Spark.

A log is a folder of files (or one file); its order is by file name, then by place in the file. All readers give
changes as rows (file, place, op, id, src, dst, label, weight, properties) with op in upsert_node, upsert_edge,
delete_node, delete_edge; :func:`replay` turns them into the live graph by last-write-wins.
"""

from __future__ import annotations

import itertools
import json
import math
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph._ship import ship
from quillgraph.errors import LogError
from quillgraph.functions.compare import Literal, kind_of
from quillgraph.model import VALUE, PropertyGraph, Table, tagged, untagged
from quillgraph.operators.adjacency import small

CHANGES = f"file string, place long, op string, id long, src long, dst long, label string, weight double, properties map<string,{VALUE}>"
# Fixed values of the formats.
_TAGS = {"Null": "null", "Boolean": "bool", "Integer": "int", "Float": "float", "Text": "text"}
_NAMES = {v: k for k, v in _TAGS.items()}
MAGIC, VERSION = b"AGDB", 2
UPSERT_NODE, UPSERT_EDGE, DELETE_NODE, DELETE_EDGE, BEGIN, COMMIT, ROLLBACK = range(1, 8)
_OPS = {"UpsertNode": "upsert_node", "UpsertEdge": "upsert_edge", "DeleteNode": "delete_node", "DeleteEdge": "delete_edge"}

Change = tuple  # (op, id, src, dst, label, weight, {name: Python value})


def json_line(change: Change) -> str:
    """A change as one line. Floats that aren't finite are written as null, since JSON has none."""

    def value(v: Literal):
        kind = kind_of(v)
        if kind == "null":
            return "Null"
        return {_NAMES[kind]: None if kind == "float" and not math.isfinite(v) else v}

    op, i, src, dst, label, weight, props = change
    if op == "upsert_node":
        body = {"op": "UpsertNode", "node": {"id": i, "label": label, "properties": {k: value(v) for k, v in props.items()}}}
    elif op == "upsert_edge":
        body = {"op": "UpsertEdge", "edge": {"id": i, "source": src, "target": dst, "label": label, "weight": weight if math.isfinite(weight) else None, "properties": {k: value(v) for k, v in props.items()}}}
    else:
        body = {"op": "DeleteNode" if op == "delete_node" else "DeleteEdge", "id": i}
    return json.dumps(body, ensure_ascii=False, separators=(",", ":"))


def _json_values(column):
    """map<string,string> of raw JSON values -> tagged values."""
    parsed = lambda v: F.from_json(v, "Boolean boolean, Integer bigint, Float double, Text string, Null string")

    def tag(_, v):
        p = parsed(v)
        kind = F.when(v == "Null", "null").when(v.startswith('{"Boolean"'), "bool").when(v.startswith('{"Integer"'), "int").when(v.startswith('{"Float"'), "float").when(v.startswith('{"Text"'), "text")
        return F.struct(kind.alias("t"), p["Boolean"].alias("b"), p["Integer"].alias("i"), p["Float"].alias("d"), p["Text"].alias("s"))

    return F.transform_values(column, tag)


_ELEMENT = "struct<id:bigint,source:bigint,target:bigint,label:string,weight:double,properties:map<string,string>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Changes of line-delimited JSON. Blank lines are passed over; any other malformed line raises LogError when rows are
    computed, naming the file and the line's place."""
    schema = f"op string, id bigint, node {_ELEMENT}, edge {_ELEMENT}, _bad string"
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.concat_ws(":", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    parsed = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    op = F.create_map(*(F.lit(x) for pair in _OPS.items() for x in pair))[F.col("r.op")]
    good = F.col("r._bad").isNull() & op.isNotNull() & F.when(F.col("r.op") == "UpsertNode", F.col("r.node.id").isNotNull()).when(F.col("r.op") == "UpsertEdge", F.col("r.edge.id").isNotNull() & F.col("r.edge.source").isNotNull()).otherwise(F.col("r.id").isNotNull())
    checked = F.when(F.coalesce(good, F.lit(False)), op).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))).cast("string"))
    return parsed.select(
        F.col("block").alias("file"),
        F.col("row").alias("place"),
        checked.alias("op"),
        F.coalesce("r.node.id", "r.edge.id", "r.id").alias("id"),
        F.col("r.edge.source").alias("src"),
        F.col("r.edge.target").alias("dst"),
        F.coalesce("r.node.label", "r.edge.label").alias("label"),
        F.col("r.edge.weight").alias("weight"),
        _json_values(F.coalesce("r.node.properties", "r.edge.properties")).alias("properties"),
    )


# ---- binary


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _value(v: Literal) -> bytes:
    kind = kind_of(v)
    if kind == "null":
        return b"\x00"
    if kind == "bool":
        return bytes([1, v])
    if kind == "int":
        return b"\x02" + struct.pack("<q", v)
    return b"\x03" + struct.pack("<d", v) if kind == "float" else b"\x04" + _text(v)


def record(kind: int, payload: bytes) -> bytes:
    body = bytes([kind]) + payload
    return body + struct.pack("<I", zlib.adler32(body))


def binary_record(change: Change) -> bytes:
    op, i, src, dst, label, weight, props = change
    if op in ("delete_node", "delete_edge"):
        return record(DELETE_NODE if op == "delete_node" else DELETE_EDGE, struct.pack("<Q", i))
    inside = struct.pack("<I", len(props)) + b"".join(_text(k) + _value(v) for k, v in props.items())
    if op == "upsert_node":
        return record(UPSERT_NODE, struct.pack("<Q", i) + _text(label) + inside)
    return record(UPSERT_EDGE, struct.pack("<QQQ", i, src, dst) + _text(label) + struct.pack("<d", weight) + inside)


def header() -> bytes:
    return MAGIC + struct.pack("<I", VERSION)


def transaction_bytes(txn: int, changes: Iterable[Change]) -> bytes:
    return record(BEGIN, struct.pack("<Q", txn)) + b"".join(map(binary_record, changes)) + record(COMMIT, struct.pack("<Q", txn))


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, form: str):
        n = struct.calcsize(form)
        if self.at + n > len(self.raw):
            raise EOFError
        found = struct.unpack_from(form, self.raw, self.at)
        self.at += n
        return found if len(found) > 1 else found[0]

    def text(self) -> str:
        n = self.take("<I")
        if self.at + n > len(self.raw):
            raise EOFError
        self.at += n
        return self.raw[self.at - n : self.at].decode(errors="replace")

    def value(self) -> Literal:
        tag = self.take("<B")
        if tag == 0:
            return None
        if tag == 1:
            return bool(self.take("<B"))
        if tag > 4:
            raise LogError(f"unknown value tag {tag}")
        return self.text() if tag == 4 else self.take("<q" if tag == 2 else "<d")

    def properties(self) -> dict[str, Literal]:
        return {self.text(): self.value() for _ in range(self.take("<I"))}


def decode(raw: bytes, name: str = "log") -> list[Change]:
    return list(decoded(raw, name))


def decoded(raw: bytes, name: str = "log") -> Iterator[Change]:
    """Changes of a binary log in order. Records with a wrong checksum are passed over with a warning; a cut-off record ends
    the log; changes of a transaction count from its COMMIT on, upserts before deletes, and not at all without it."""
    if not raw:
        return
    r = _Reader(raw)
    if raw[:4] != MAGIC or len(raw) < 8 or struct.unpack_from("<I", raw, 4)[0] != VERSION:
        raise LogError(f"{name}: not a version {VERSION} log")
    r.at = 8
    pending: list[Change] | None = None
    open_txn = None
    while r.at < len(raw):
        begin, number = r.at, None
        try:
            kind = r.take("<B")
            change: Change | None = None
            if kind == UPSERT_NODE:
                i = r.take("<Q")
                change = ("upsert_node", i, None, None, r.text(), None, r.properties())
            elif kind == UPSERT_EDGE:
                i, s, d = r.take("<QQQ")
                label = r.text()
                change = ("upsert_edge", i, s, d, label, r.take("<d"), r.properties())
            elif kind in (DELETE_NODE, DELETE_EDGE):
                change = ("delete_node" if kind == DELETE_NODE else "delete_edge", r.take("<Q"), None, None, None, None, {})
            elif kind in (BEGIN, COMMIT, ROLLBACK):
                number = r.take("<Q")
            else:
                warnings.warn(f"{name}: unknown record {kind} at byte {begin}; the rest is left out", stacklevel=2)
                break
            end = r.at
            if r.take("<I") != zlib.adler32(raw[begin:end]):
                warnings.warn(f"{name}: wrong checksum at byte {begin}; record left out", stacklevel=2)
                continue
        except EOFError:
            break
        if kind == BEGIN:
            pending, open_txn = [], number
        elif kind in (COMMIT, ROLLBACK):
            if kind == COMMIT and pending is not None and number == open_txn:
                yield from (c for c in pending if c[0].startswith("upsert"))
                yield from (c for c in pending if c[0].startswith("delete"))
            pending = open_txn = None
        elif change is not None and pending is None:
            yield change
        elif change is not None:
            pending.append(change)


def _decoder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            changes = enumerate(decoded(bytes(content), path))
            while rows := [(path, k, op, i, s, d, label, w, {n: dict(zip("tbids", tagged(v), strict=True)) for n, v in props.items()}) for k, (op, i, s, d, label, w, props) in itertools.islice(changes, 10_000)]:
                out = pd.DataFrame(rows, columns=["file", "place", "op", "id", "src", "dst", "label", "weight", "properties"])
                yield out.astype({"src": "Int64", "dst": "Int64", "weight": "Float64"})


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Changes of binary log files. A file's records can only be told apart from its beginning on, so one task decodes it, and
    holds its bytes and one transaction; files are decoded side by side. Spark reads files of up to 2 GB so."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_decoder, CHANGES)


def replay(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live (nodes, edges): for each id the last upsert, unless a delete follows; edges whose ends both live.

    An edge older than the last delete of one of its ends went with that node, even if the node came back.
    """
    at = F.struct("file", "place")
    rows = changes.withColumn("at", at)
    last = rows.groupBy(F.col("op").endswith("_node").alias("is_node"), "id").agg(F.max_by(F.struct("op", "src", "dst", "label", "weight", "properties", "at"), "at").alias("x"))
    live = last.where(F.col("x.op").startswith("upsert")).select("is_node", "id", "x.*")
    nodes = live.where("is_node").select("id", "label", "properties")
    edges = live.where("not is_node")
    deleted = rows.where("op = 'delete_node'").groupBy("id").agg(F.max("at").alias("gone"))
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        edges = edges.join(deleted.select(F.col("id").alias(end), F.col("gone").alias(f"gone_{end}")), end, "left").where(f"gone_{end} is null or gone_{end} < at")
    return nodes, edges.select("id", "src", "dst", "label", "weight", "properties")


def rows_of(spark: SparkSession, changes: list[Change], file: str, first: int = 0) -> DataFrame:
    """Changes as rows of the schema CHANGES, in their order."""
    rows = [(file, first + k, op, i, s, d, label, None if w is None else float(w), {n: tagged(v) for n, v in props.items()}) for k, (op, i, s, d, label, w, props) in enumerate(changes)]
    return spark.createDataFrame(rows, CHANGES)


def overlay(node_tables: list[Table], edge_tables: list[Table], changes: DataFrame, n: int) -> tuple[list[Table], list[Table]]:
    """The tables of a graph after ``n`` changes: what they touch is taken out of the tables, which keep their layout, and
    what lives of them is a further table. Edges that a deleted node had are gone."""
    last = changes.withColumn("at", F.struct("file", "place")).groupBy(F.col("op").endswith("_node").alias("is_node"), "id").agg(F.max_by(F.struct("op", "src", "dst", "label", "weight", "properties", "at"), "at").alias("x"))
    deleted = changes.where("op = 'delete_node'").groupBy("id").agg(F.max(F.struct("file", "place")).alias("gone"))
    touched = {kind: small(last.where("is_node" if kind == "node" else "not is_node").select("id"), n) for kind in ("node", "edge")}
    rest = [replace(t, df=t.df.join(touched["node"], "id", "left_anti")) for t in node_tables]
    nodes = last.where("is_node and x.op = 'upsert_node'").select("id", "x.label", "x.properties")
    edges = last.where("not is_node and x.op = 'upsert_edge'").select("id", "x.*")
    live = nodes.select("id")
    for t in rest:
        live = live.unionByName(t.df.select("id"))
    for end in ("src", "dst"):
        edges = edges.join(live.select(F.col("id").alias(end)), end, "left_semi")
        edges = edges.join(small(deleted.select(F.col("id").alias(end), F.col("gone").alias(f"gone_{end}")), n), end, "left").where(f"gone_{end} is null or gone_{end} < at")
    kept = []
    for t in edge_tables:
        df = t.df.join(touched["edge"], "id", "left_anti")
        for end in ("src", "dst"):
            df = df.join(small(deleted.select(F.col("id").alias(end)), n), end, "left_anti")
        kept.append(replace(t, df=df.select(*t.df.columns)))
    return [*rest, Table(nodes)], [*kept, Table(edges.select("id", "src", "dst", "label", "weight", "properties"))]


def graph_of(spark: SparkSession, path: str, form: str = "json") -> PropertyGraph:
    nodes, edges = replay(read_json(spark, path) if form == "json" else read_binary(spark, path))
    return PropertyGraph.of(nodes, edges)


# ---- writing


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any store that Spark reads, by a temporary name and a rename, so that it is there whole or not at all."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(content))
    out.close()
    if not fs.rename(temporary, target):
        raise LogError(f"can't write {path}")


def write_json(graph_nodes: DataFrame, graph_edges: DataFrame, path: str) -> None:
    """The whole graph as upserts, nodes in files before edges, written by the executors."""

    def raw(v):
        return (
            F.when(v["t"] == "null", F.lit('"Null"'))
            .when(v["t"] == "bool", F.to_json(F.struct(v["b"].alias("Boolean"))))
            .when(v["t"] == "int", F.to_json(F.struct(v["i"].alias("Integer"))))
            .when(v["t"] == "float", F.when(F.isnan(v["d"]) | (F.abs(v["d"]) == float("inf")), F.lit('{"Float":null}')).otherwise(F.to_json(F.struct(v["d"].alias("Float")))))
            .otherwise(F.to_json(F.struct(v["s"].alias("Text"))))
        )

    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    props = F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.map_entries(F.coalesce("properties", F.create_map().cast(f"map<string,{VALUE}>"))), lambda e: F.concat(quoted(e["key"]), F.lit(":"), raw(e["value"])))), F.lit("}"))
    s = lambda c: F.col(c).cast("string")
    node = F.concat(F.lit('{"op":"UpsertNode","node":{"id":'), s("id"), F.lit(',"label":'), quoted(F.col("label")), F.lit(',"properties":'), props, F.lit("}}"))
    edge = F.concat(F.lit('{"op":"UpsertEdge","edge":{"id":'), s("id"), F.lit(',"source":'), s("src"), F.lit(',"target":'), s("dst"), F.lit(',"label":'), quoted(F.col("label")), F.lit(',"weight":'), s("weight"), F.lit(',"properties":'), props, F.lit("}}"))
    graph_nodes.select(node.alias("value")).unionByName(graph_edges.select(edge.alias("value"))).write.mode("append").text(path)


def _separator() -> str:
    """A rollback record whose bytes are all ASCII: it means nothing outside a transaction, so it may stand between records."""
    return next(raw.decode() for raw in (record(ROLLBACK, struct.pack("<Q", k)) for k in itertools.count(1)) if max(raw) < 128 and 10 not in raw and 13 not in raw)


def _blocks(node: bool):
    """Rows as blocks of records, the first of a file after the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = header()
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                props = {k: untagged(v) for k, v in r["properties"] or ()}
                out.append(binary_record(("upsert_node", r["id"], None, None, r["label"], None, props) if node else ("upsert_edge", r["id"], r["src"], r["dst"], r["label"], r["weight"], props)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([first + b"".join(out)], pa.binary())], ["block"])
                first = b""

    return run


def write_binary(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The whole graph as upserts in binary log files, written by the executors; nodes in files before edges.

    Blocks of records go through Spark's text writer, whose line separator is a record without effect.
    """
    ship(nodes.sparkSession)
    for rows, name in ((nodes, "base-0-nodes"), (edges, "base-1-edges")):
        blocks = rows.hint("rebalance").mapInArrow(_blocks(name.endswith("nodes")), "block binary")
        blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", _separator()).text(f"{path}/{name}")


def log_bytes(spark: SparkSession, path: str) -> int:
    """Size of a log by the file system's content summary; 0 if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0
