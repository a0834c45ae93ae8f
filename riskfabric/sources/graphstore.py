"""Node and edge tables on files: a log of committed versions, each naming the files that make up a table.

Data files are written first, under names nobody has used; then one small manifest per version, for all tables of the store, is moved to its
final name, which succeeds for one writer only. A reader opens the newest manifest and sees what it names, no more: never half of a
batch, and no file that a later version has replaced goes away beneath it before `vacuum` is asked for. A writer that finds its version taken reads the newer
one and commits on top of it.

A version holds for each table a snapshot in hash ranges of the key and the deltas that came after it. Snapshot rows carry for each property the place (time) it was
written at, so folding is the same aggregate over snapshot and deltas whatever came in which order. Compaction folds the ranges that the deltas touch and
leaves the files of the others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash ranges of a snapshot.
PARTS = 16
PART = "_part"


class Manifests:
    """The versions of a store: small JSON files, numbered, never changed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.folder = folder
        self.files = self._path(folder).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def newest(self) -> dict:
        """The newest version, or an empty one numbered 0."""
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else {"version": 0, "tables": {}}

    def numbers(self) -> list[int]:
        if not self.files.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.files.open(self._path(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, content: dict) -> bool:
        """Whether the version is now this content; False if another writer has committed it."""
        made = self._path(f"{self.folder}/{uuid.uuid4().hex}.part")
        out = self.files.create(made)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.conf)
        never_over = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        target = self._path(f"{self.folder}/{content['version']:012d}.json")
        try:
            context.rename(made, target, never_over)
        except Exception:
            self.files.delete(made, False)
            if self.files.exists(target):
                return False
            raise
        return True

    def drop(self, number: int) -> None:
        self.files.delete(self._path(f"{self.folder}/{number:012d}.json"), False)

    def delete(self, folder: str) -> None:
        self.files.delete(self._path(folder), True)

    def folders(self, parent: str) -> list[str]:
        path = self._path(parent)
        return [f"{parent}/{f.getPath().getName()}" for f in self.files.listStatus(path)] if self.files.exists(path) else []


def _with(now: dict, table: str, **changed) -> dict:
    return now | {"tables": now["tables"] | {table: _table(now, table) | changed}}


def _table(now: dict, table: str) -> dict:
    """Snapshot folder by part, deltas, the folder of a table saved as a whole, and the schema of every folder."""
    return now["tables"].get(table, {"rows": None, "parts": {}, "deltas": [], "schemas": {}})


class GraphStore:
    """Tables of a graph: plain ones written as a whole (`save`, `load`) and logs that a streaming job appends to (`append`, `compact`, `current`).

    A delta is named by the run (the checkpoint that counts the batches) and the batch: a batch replayed after a failure replaces its
    own delta, a new run leaves those of earlier ones. A replay of what a snapshot already holds changes nothing, since the fold is the same.
    """

    def __init__(self, spark: SparkSession, root: str, run: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.run, self.parts = spark, root.rstrip("/"), run, parts
        self.log = Manifests(spark, f"{self.root}/versions")

    def _fresh(self) -> str:
        return f"{self.root}/files/{uuid.uuid4().hex}"

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        """change(newest version) until it is committed; the files it names are there before."""
        while True:
            content = change(self.log.newest())
            content["version"] += 1
            if self.log.commit(content):
                return content

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Both tables as they are, laid out for look-ups by label and type; one version."""
        folders = {}
        for table, rows, by in (("nodes", nodes, "label"), ("edges", edges, "type")):
            folders[table] = self._fresh(), rows.schema.json()
            rows.write.partitionBy(by).parquet(folders[table][0])

        def change(now: dict) -> dict:
            for table, (folder, schema) in folders.items():
                now = _with(now, table, rows=folder, parts={}, deltas=[], schemas={folder: schema})
            return now

        self._commit(change)

    def load(self) -> tuple[DataFrame, DataFrame]:
        now = self.log.newest()
        return tuple(self._read(_table(now, t), _table(now, t)["rows"]) for t in ("nodes", "edges"))

    def _read(self, table: dict, folder: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(table["schemas"][folder]))).parquet(folder)

    def write(self, rows: DataFrame, keys: list[str]) -> tuple[str, str]:
        """The files of a delta, which nobody sees before `publish`, and their schema."""
        folder = self._fresh()
        laid = rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int"))
        laid.write.partitionBy(PART).parquet(folder)
        return folder, laid.schema.json()

    def publish(self, written: Mapping[str, tuple[str, str]], batch_id: int) -> None:
        """The deltas of all tables of a batch become visible together."""
        def change(now: dict) -> dict:
            for name, (folder, schema) in written.items():
                table = _table(now, name)
                others = [d for d in table["deltas"] if (d["run"], d["batch"]) != (self.run, batch_id)]
                deltas = [*others, {"run": self.run, "batch": batch_id, "folder": folder}]
                held = {*table["parts"].values(), *(d["folder"] for d in deltas), table["rows"]}
                now = _with(now, name, deltas=deltas, schemas={f: s for f, s in (table["schemas"] | {folder: schema}).items() if f in held})
            return now

        self._commit(change)

    def append(self, batch_id: int, **tables: tuple[DataFrame, list[str]]) -> None:
        """(rows, keys) by table."""
        self.publish({name: self.write(rows, keys) for name, (rows, keys) in tables.items()}, batch_id)

    @staticmethod
    def _dated(rows: DataFrame, keys: list[str], order: list[str], stamp: str) -> DataFrame:
        """Delta rows as one-row snapshots: every property with the place it was written at."""
        values = [c for c in rows.columns if c not in (*keys, *order, stamp, PART)]
        place = F.struct(*order)
        return rows.select(*keys, PART, F.col(stamp).alias("first_seen"), F.col(stamp).alias("last_seen"),
                           *[F.when(F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("value"))).alias(c) for c in values])

    @staticmethod
    def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The latest value of every property; one aggregate that combines map-side."""
        values = [c for c in rows.columns if c not in (*keys, PART, "first_seen", "last_seen")]
        latest: list[Column] = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(c)["at"])).alias(c) for c in values]
        return rows.groupBy(*keys).agg(F.first(PART).alias(PART), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *latest)

    def _state(self, table: dict, parts: list[int], keys: list[str], order: list[str], stamp: str) -> DataFrame:
        """Snapshot and delta rows of the parts; one scan per folder, pruned to its parts."""
        frames = []
        for folder in dict.fromkeys(table["parts"].values()):
            own = [int(p) for p, f in table["parts"].items() if f == folder and int(p) in parts]
            if own:
                frames.append(self._read(table, folder).filter(F.col(PART).isin(own)))
        frames += [self._dated(self._read(table, d["folder"]).filter(F.col(PART).isin(parts)), keys, order, stamp) for d in table["deltas"]]
        if not frames:
            raise FileNotFoundError(f"{self.root} holds no such table")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def current(self, table: str, keys: list[str], order: list[str], stamp: str) -> DataFrame:
        """Keys, `first_seen`, `last_seen` and the latest properties: one snapshot and the deltas after it."""
        folded = self._folded(self._state(_table(self.log.newest(), table), list(range(self.parts)), keys, order, stamp), keys)
        return folded.select(*keys, "first_seen", "last_seen", *[F.col(c)["value"].alias(c) for c in folded.columns if c not in (*keys, PART, "first_seen", "last_seen")])

    def compact(self, table: str, keys: list[str], order: list[str], stamp: str) -> list[int]:
        """Folds the deltas into the parts that they touch, which are returned. Deltas committed meanwhile stay deltas."""
        held = _table(self.log.newest(), table)
        touched = sorted({int(f.rsplit("=", 1)[1]) for d in held["deltas"] for f in self.log.folders(d["folder"]) if f"/{PART}=" in f})
        done = {d["folder"] for d in held["deltas"]}
        if not touched:
            return []
        folder = self._fresh()
        rows = self._folded(self._state(held, touched, keys, order, stamp), keys)
        rows.repartition(PART, F.pmod(F.xxhash64(*keys), F.lit(4 * self.parts))).write.partitionBy(PART).parquet(folder)

        def change(now: dict) -> dict:
            newest = _table(now, table)
            if any(newest["parts"].get(str(p)) != held["parts"].get(str(p)) for p in touched):
                raise RuntimeError(f"{table}: another compaction has replaced the same parts")
            parts = newest["parts"] | {str(p): folder for p in touched}
            deltas = [d for d in newest["deltas"] if d["folder"] not in done]
            left = {*parts.values(), *(d["folder"] for d in deltas), newest["rows"]}
            schemas = {f: s for f, s in (newest["schemas"] | {folder: rows.schema.json()}).items() if f in left}
            return _with(now, table, parts=parts, deltas=deltas, schemas=schemas)

        self._commit(change)
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops all but the newest `keep` versions and the files that none of these names. Not for a time when a writer is between `write` and `publish`."""
        numbers, held = self.log.numbers(), set()
        for number in numbers[-keep:]:
            for table in self.log.read(number)["tables"].values():
                held |= {table["rows"], *table["parts"].values(), *(d["folder"] for d in table["deltas"])}
        for number in numbers[:-keep]:
            self.log.drop(number)
        gone = [f for f in self.log.folders(f"{self.root}/files") if f.rsplit("/", 1)[1] not in {str(h).rsplit("/", 1)[1] for h in held if h}]
        for folder in gone:
            self.log.delete(folder)
        return gone
