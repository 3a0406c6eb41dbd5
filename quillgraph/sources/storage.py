"""Where a logged graph is kept: the changes since it was last compacted, and its tables as of then.

A generation is a folder with a log of batches, each a file that is there whole or not at all, and, if it came of a
compaction, the graph's tables as Parquet: by label, with a typed column for each property, so that conditions on labels pass
over folders and those on properties over row groups. It counts once its DONE file is there.
"""

from __future__ import annotations

import itertools
import json
import threading
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.model import EDGES, NODES, Table
from quillgraph.plans.planner import FOLDER_MARK
from quillgraph.sources import change_log

#: Properties that get a typed column, at most: the most frequent; conditions on others read the map.
MAX_COLUMNS = 400
_FIELD = {"bool": ("b", "boolean"), "int": ("i", "bigint"), "float": ("d", "double"), "text": ("s", "string")}
_FOLDER = "label_folder"


class Storage(Protocol):
    """What :class:`quillgraph.session.LoggedGraph` needs of a place to keep a graph in."""

    def append(self, changes: list[tuple], transaction: int | None = None) -> None:
        """Keeps a batch of changes, all of it or nothing."""

    def changes(self) -> DataFrame | None:
        """Rows of the schema CHANGES since the last compaction; None without any."""

    def tables(self) -> tuple[list[Table], list[Table]]:
        """Node and edge tables as of the last compaction."""

    def next_ids(self) -> dict[str, int]:
        """The least node and edge ids beyond all that the tables ever had."""

    def compact(self, nodes: DataFrame, edges: DataFrame, next_ids: dict[str, int]) -> None:
        """Replaces what is kept by these tables and an empty log."""

    def size(self) -> int:
        """Bytes kept."""


class FileStorage:
    """Generations of files in a folder of any store that Spark reaches; log batches as JSON lines or binary records."""

    def __init__(self, spark: SparkSession, path: str, form: str = "json") -> None:
        self.spark, self.path, self.form = spark, path.rstrip("/"), form
        self._lock = threading.Lock()
        self._generation = self._newest()
        self._file = itertools.count(self._last_file() + 1)

    def _names(self, folder: str) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _newest(self) -> int:
        done = [int(n[4:]) for n in self._names(self.path) if n.startswith("gen-") and "DONE" in self._names(f"{self.path}/{n}")]
        return max(done, default=0)

    @property
    def folder(self) -> str:
        return f"{self.path}/gen-{self._generation}"

    def _batches(self) -> list[str]:
        return [n for n in self._names(f"{self.folder}/log") if n.startswith("batch-") and n.endswith(".log")]

    def _last_file(self) -> int:
        return max((int(n[6:18]) for n in self._batches()), default=0)

    def append(self, changes: list[tuple], transaction: int | None = None) -> None:
        if self.form == "json":
            content = "".join(change_log.json_line(c) + "\n" for c in changes).encode()
        else:
            body = b"".join(map(change_log.binary_record, changes)) if transaction is None else change_log.transaction_bytes(transaction, changes)
            content = change_log.header() + body
        with self._lock:
            change_log.write_bytes(self.spark, f"{self.folder}/log/batch-{next(self._file):012d}.log", content)

    def changes(self) -> DataFrame | None:
        if not self._batches():
            return None
        paths = f"{self.folder}/log/batch-*.log"
        return change_log.read_json(self.spark, paths) if self.form == "json" else change_log.read_binary(self.spark, paths)

    def _manifest(self) -> dict | None:
        if "DONE" not in self._names(self.folder):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/DONE", wholetext=True).first()[0])

    def tables(self) -> tuple[list[Table], list[Table]]:
        manifest = self._manifest()
        if manifest is None:
            return [], []
        out = []
        for name, schema in (("nodes", NODES), ("edges", EDGES)):
            typed: dict[str, list[tuple[str, str]]] = {}
            fields = list(T._parse_datatype_string(schema).fields)
            for k, (key, kind) in enumerate(manifest[name]["columns"]):
                typed.setdefault(key, []).append((f"v{k}", kind))
                fields.append(T.StructField(f"v{k}", T._parse_datatype_string(_FIELD[kind][1])))
            df = self.spark.read.schema(T.StructType([*fields, T.StructField(_FOLDER, T.StringType())])).parquet(f"{self.folder}/{name}")
            out.append([Table(df, typed=typed, complete=manifest[name]["complete"], label_folder=_FOLDER)])
        return out[0], out[1]

    def next_ids(self) -> dict[str, int]:
        return (self._manifest() or {}).get("next", {"node": 0, "edge": 0})

    def compact(self, nodes: DataFrame, edges: DataFrame, next_ids: dict[str, int]) -> None:
        following = self._generation + 1
        folder, manifest = f"{self.path}/gen-{following}", {"next": next_ids}
        for name, df in (("nodes", nodes), ("edges", edges)):
            # names in use and their kinds, the most frequent first
            used = df.select(F.explode("properties").alias("key", "value")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("value.t")).alias("kinds"))
            rows = used.orderBy(F.desc("n"), "key").limit(MAX_COLUMNS + 1).collect()
            columns, complete = [], len(rows) <= MAX_COLUMNS
            for r in rows:
                # a name is typed with all its kinds, of which null needs no column, or not at all
                kinds = [k for k in r.kinds if k != "null"]
                if kinds and len(columns) + len(kinds) <= MAX_COLUMNS:
                    columns += [(r.key, kind) for kind in kinds]
                else:
                    complete = False
            value = lambda key, kind: F.when(F.col("properties")[key]["t"] == kind, F.col("properties")[key][_FIELD[kind][0]])
            typed = df.select("*", *(value(key, kind).alias(f"v{k}") for k, (key, kind) in enumerate(columns)), F.concat(F.lit(FOLDER_MARK), "label").alias(_FOLDER))
            # files of a label together, large labels in several
            typed.hint("rebalance", F.col(_FOLDER)).write.partitionBy(_FOLDER).parquet(f"{folder}/{name}")
            manifest[name] = {"columns": columns, "complete": complete}
        change_log.write_bytes(self.spark, f"{folder}/DONE", json.dumps(manifest).encode())
        with self._lock:
            self._generation = following
            self._file = itertools.count(1)

    def size(self) -> int:
        return change_log.log_bytes(self.spark, self.folder)


class MemoryStorage:
    """Keeps changes and tables in the session only, for tests and graphs that needn't last."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._changes: list[tuple] = []
        self._tables: tuple[list[Table], list[Table]] = ([], [])
        self._next = {"node": 0, "edge": 0}

    def append(self, changes: list[tuple], transaction: int | None = None) -> None:
        self._changes += changes

    def changes(self) -> DataFrame | None:
        return change_log.rows_of(self.spark, self._changes, "memory") if self._changes else None

    def tables(self) -> tuple[list[Table], list[Table]]:
        return self._tables

    def next_ids(self) -> dict[str, int]:
        return dict(self._next)

    def compact(self, nodes: DataFrame, edges: DataFrame, next_ids: dict[str, int]) -> None:
        from quillgraph.operators.rounds import saved

        self._tables, self._changes, self._next = ([Table(saved(nodes))], [Table(saved(edges))]), [], dict(next_ids)

    def size(self) -> int:
        return sum(len(change_log.binary_record(c)) for c in self._changes)
