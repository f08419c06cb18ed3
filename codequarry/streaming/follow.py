"""Keeping an index up to date with a tree whose files come, change in place and go.

Every batch of the stream is a listing of the tree, read in the runs of sources.tree. Paths are dealt to buckets by a hash; a bucket's state
has the mark of each of its paths, its size and time of change. Each bucket also gets a row without a path, so that one whose last file went
is looked at too. What differs from the state is new, changed or gone; only new and changed files are read. State and offsets are in the
checkpoint: a restart lists anew, finds all marks as they were and hands on nothing. A batch that fails is repeated with the state before it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..index import Index
from ..session import make_importable
from ..sources.files import LANGUAGES, root_rules
from ..sources.tree import FILES, FOLDERS, Run, Wanted, lister, members, runs

#: Buckets of the state; a bucket's marks are held in the memory of a task.
BUCKETS = 256
_MARKS = "path string, language string, mark string, bucket int"


class ListingReader(DataSourceStreamReader):
    """Every offset is a time at which the tree is listed anew."""

    def __init__(self, root: str, wanted: Wanted, files: int, buckets: int):
        self.root, self.wanted, self.files, self.buckets = root, wanted, files, buckets

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Run([]), *runs(lister(self.root), self.wanted, self.files, FOLDERS)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("language", pa.string()), ("mark", pa.string()), ("bucket", pa.int32())])
        if not run.parts:  # the rows without a path
            none = pa.nulls(self.buckets, pa.string())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(self.buckets), pa.int32())], schema=schema)
            return
        fs, base = FileSystem.from_uri(self.root)
        found = list(members(lister(self.root), self.wanted, run))
        infos = fs.get_file_info([f"{base.rstrip('/')}/{p}" for p, _ in found])
        rows = [(p, language, f"{x.size}:{x.mtime_ns}") for (p, language), x in zip(found, infos, strict=True) if x.is_file]
        paths, languages, marks = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(languages, pa.string()), pa.array(marks, pa.string()), pa.nulls(len(rows), pa.int32())], schema=schema)


class TreeListing(DataSource):
    """path, language and mark of the files of a tree, and a row without a path for each bucket, in every batch. Options: path, rules (JSON),
    files, buckets."""

    @classmethod
    def name(cls) -> str:
        return "source_tree_listing"

    def schema(self) -> str:
        return _MARKS

    def streamReader(self, schema: StructType) -> ListingReader:
        o = self.options
        return ListingReader(o["path"], Wanted.of(json.loads(o["rules"]), LANGUAGES), int(o.get("files", FILES)), int(o["buckets"]))


class Changes(StatefulProcessor):
    """Rows of a bucket, all that are listed now, to path, language and change (`new`, `changed`, `gone`)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "path string", "mark string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.known.iterator()} if self.known.exists() else {}
        out, seen = [], set()
        for f in rows:
            for path, language, mark in zip(f["path"], f["language"], f["mark"], strict=True):
                if path is None or path in seen:
                    continue
                seen.add(path)
                if before.get(path) != mark:
                    self.known.updateValue((path,), (mark,))
                    out.append((path, language, "changed" if path in before else "new"))
        for path in before.keys() - seen:
            self.known.removeKey((path,))
            out.append((path, None, "gone"))
        yield pd.DataFrame(out, columns=["path", "language", "change"], dtype=object)

    def close(self) -> None:
        pass


def changes(spark: SparkSession, source: str, rules: Iterable[str] | None = None, buckets: int = BUCKETS, files: int = FILES) -> DataFrame:
    """A stream of path, language and change (`new`, `changed` or `gone`) of the files of a tree that have a known extension and that no rule
    ignores. A change that keeps a file's size and time isn't seen. buckets can't change while a checkpoint is used."""
    make_importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(TreeListing)
    lines = root_rules(source) if rules is None else list(rules)
    listed = spark.readStream.format("source_tree_listing").option("rules", json.dumps(lines)).option("buckets", str(buckets)).option("files", str(files)).load(source)
    dealt = listed.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    return dealt.groupBy("bucket").transformWithStateInPandas(Changes(), "path string, language string, change string", "Update", "None")


def contents(changed: DataFrame, source: str) -> DataFrame:
    """path, language, content of changed files (path, language); one that went since is left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(source)
        for f in frames:
            for path, language in zip(f["path"], f["language"], strict=True):
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as one:
                        yield pd.DataFrame({"path": [path], "language": [language], "content": [one.read()]})
                except FileNotFoundError:
                    continue

    return changed.select("path", "language").mapInPandas(read, "path string, language string, content binary")


def follow(index: Index, source: str, checkpoint: str, rules: Iterable[str] | None = None, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Apply every new, changed and gone file below source to index, batch by batch; by default what there is now, then the query ends.

    rules are those of the tree's ignore file unless given. A batch without a change leaves the index as it is.
    """

    def apply(batch: DataFrame, _: int) -> None:
        found = index.store.scratch(batch)  # once: running the batch again would meet the new state
        if not found.isEmpty():
            index.apply(contents(found.where("change <> 'gone'"), source), whole=False, gone=found.where("change = 'gone'").select("path"))

    stream = changes(index.spark, source, rules, buckets)
    return stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
