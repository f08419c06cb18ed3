"""Keyed tables below one folder, in hash buckets, of which a change writes only those that it touches.

A table is a set of buckets by a hash of its key, each a folder of Parquet files. A change reads the buckets that its keys fall into, writes them
anew and then one file of the manifest, which names the folder of every bucket; a reader uses the last file, so it sees all of a change or
nothing. A manifest file is named by its version and never written over: of two writers at once, the later one fails with STORAGE_BUSY. This
needs a file system on which creating a file that is there fails, such as HDFS or a local disk; on an object store without that, writers must
take turns. Folders that no manifest of the last versions names are deleted by vacuum() alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schema import ErrorCode, QuarryError

#: Buckets of a table unless it is made with another number.
BUCKETS = 64
_MANIFEST = "version long, tables map<string, struct<buckets: int, folders: map<string, string>>>, meta map<string, string>"


@dataclass
class Version:
    """A manifest as read: tables maps a name to its number of buckets and the folder of each bucket that has rows."""

    version: int = 0
    tables: dict[str, tuple[int, dict[int, str]]] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)


class Store:
    """Tables by name, each with its schema and the columns of its key."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[StructType, list[str]]], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets

    def version(self) -> Version:
        """What readers see now."""
        try:
            row = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest").where("version IS NOT NULL").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return Version()
        if row is None:
            return Version()
        return Version(row.version, {n: (t.buckets, {int(b): f for b, f in (t.folders or {}).items()}) for n, t in (row.tables or {}).items()}, dict(row.meta or {}))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str, at: Version | None = None) -> DataFrame:
        """A table as it is now, or as it was; empty if it was never written."""
        return self._read(name, sorted(set((at or self.version()).tables.get(name, (0, {}))[1].values())))

    def bucket(self, name: str, at: Version) -> Column:
        """The bucket of a row by the columns of the table's key."""
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(at.tables[name][0] if name in at.tables else self.buckets)).cast("int")

    def scratch(self, rows: DataFrame, name: str = "work") -> DataFrame:
        """rows as a table of their own, written once."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def changed(self, name: str, at: Version, put: DataFrame | None = None, drop: DataFrame | None = None) -> tuple[int, dict[int, str]]:
        """Buckets of a table after a change, to be named by publish(): rows of `put`, one for each key, in place of those with equal keys,
        and without the keys of `drop` that aren't in `put`. Only buckets of these keys are read and written; both are run more than once."""
        schema, keys = self.tables[name]
        count, folders = at.tables.get(name, (self.buckets, {}))
        place = self.bucket(name, at).alias("_bucket")
        given = [df for df in (put, drop) if df is not None]
        touched = {r[0] for df in given for r in df.select(place).distinct().collect()}  # as many as there are buckets at most
        old = sorted({folders[b] for b in touched if b in folders})
        kept = self._read(name, old)
        for df in given:
            kept = kept.join(df.select(*keys), keys, "left_anti")
        rows = kept.select(schema.fieldNames())
        if put is not None:
            rows = rows.unionByName(put.select(schema.fieldNames()))
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if touched:
            rows.withColumn("_bucket", self.bucket(name, at)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        made = self._buckets_in(folder) if touched else set()
        return count, {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in made}

    def replaced(self, name: str, rows: DataFrame, buckets: int | None = None) -> tuple[int, dict[int, str]]:
        """Buckets of a table that holds `rows` alone, which have no two equal keys; for a first load or another number of buckets."""
        count = buckets or self.buckets
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        place = self.bucket(name, Version(tables={name: (count, {})}))
        rows.select(self.tables[name][0].fieldNames()).withColumn("_bucket", place).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        return count, {b: f"{folder}/_bucket={b}" for b in self._buckets_in(folder)}

    def _buckets_in(self, folder: str) -> set[int]:
        path = self._path(folder)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def publish(self, before: Version, tables: Mapping[str, tuple[int, dict[int, str]]], meta: Mapping[str, str] | None = None) -> Version:
        """Name the buckets of changed tables in a new manifest; all others stay as in `before`."""
        if self.version().version != before.version:
            raise QuarryError("another writer changed the tables", ErrorCode.STORAGE_BUSY)
        after = Version(before.version + 1, before.tables | dict(tables), before.meta | dict(meta or {}))
        row = {"version": after.version, "tables": {n: {"buckets": c, "folders": f} for n, (c, f) in after.tables.items()}, "meta": after.meta}
        self.create(f"{self.root}/manifest/{after.version:020d}.json", json.dumps(row) + "\n")
        return after

    def create(self, path: str, text: str) -> None:
        """A new file; if there is one, another writer was first."""
        at = self._path(path)
        try:
            out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise QuarryError("another writer changed the tables", ErrorCode.STORAGE_BUSY) from None
        out.write(bytearray(text.encode()))
        out.close()

    def upsert(self, name: str, put: DataFrame) -> Version:
        """Rows with new keys are added, others take the place of those with equal keys; put has one row for each key."""
        before = self.version()
        put = self.scratch(put)
        return self.publish(before, {name: self.changed(name, before, put)})

    def vacuum(self, keep: int = 2) -> int:
        """Delete bucket folders that none of the last `keep` versions names, and scratch tables; the number of folders deleted. No writer may
        be at work, nor a reader of an older version."""
        now = self.version().version
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest").where(F.col("version") > now - keep).collect()
        used = {f for r in rows for t in (r.tables or {}).values() for f in (t.folders or {}).values()}
        fs = self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for name in [*self.tables, "work"]:
            top = self._path(f"{self.root}/{name}")
            for write in fs.listStatus(top) if fs.exists(top) else []:
                folder = f"{self.root}/{name}/{write.getPath().getName()}"
                if not any(f.startswith(folder + "/") for f in used):
                    fs.delete(write.getPath(), True)
                    gone += 1
        return gone
