"""Helpers that the operators of this subpackage share: tables, shared scratch tables and UTF-8 access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder that holds the package; Python workers need it on their path.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark alone."""
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a new temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


#: Spark's setting to delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the rows that a Python worker gets at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Cut the lineage: write df to a new table in the shared folder and read it back. The shuffle files of the write go at its end.

    batch: the rows that Python workers get at once meanwhile, for rows with long texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def crc32_of_id(col: str = "doc_id") -> Column:
    """CRC-32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_hash(col: str | Column = "text") -> Column:
    """64 bits of a text: with the doc_id they tell rows apart that share an id. Two texts of one id share them with a chance of 2**-64."""
    return F.xxhash64((F.col(col) if isinstance(col, str) else col).cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text and any other columns) that aren't in gone (doc_id, text_hash); null ids are equal to each other."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (text_hash(docs["text"]) == gone["_gone_hash"])
    return docs.join(gone, same, "left_anti")


def looked_up(rows: DataFrame, totals: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """rows with the columns of totals, which has one row for each key; null is a key like others, and a row without a total gets nulls.

    Keys with more than a thousandth of all `weight`, fewer than 1,000, are broadcast; all others meet their rows in a shuffle, which
    deals the rows of broadcast keys by the column `spread`, so that no key gathers in one task.
    """
    most = totals.agg(F.sum(weight)).first()[0] or 0
    others = [c for c in totals.columns if c != key]
    hot = F.col(weight) * 1000 > most
    known = totals.where(hot).select(F.col(key).alias("_hot"), F.struct(*others).alias("_at_once"))
    rest = totals.where(~hot).select(F.col(key).alias("_key"), F.struct(*others).alias("_met"), F.lit(0).cast("long").alias("_rest"))
    near = rows.join(F.broadcast(known), rows[key].eqNullSafe(known["_hot"]), "left")
    near = near.withColumn("_dealt", F.when(F.col("_at_once").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("long"))
    far = near.join(rest, near[key].eqNullSafe(rest["_key"]) & (near["_dealt"] == rest["_rest"]), "left")
    return far.withColumn("_total", F.coalesce("_at_once", "_met")).select(*rows.columns, *[F.col(f"_total.{c}").alias(c) for c in others])


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds at most most_bytes of text, or one row."""
    for batch in batches:
        at = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > most_bytes:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema from arrays or lists by name."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema
    )
