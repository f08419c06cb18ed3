"""Java archives as DataFrames: their classes, and the newest archive of each library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import class_name, library_name, version_key


def archives(spark: SparkSession, root: str) -> DataFrame:
    """library, path, content of every .jar file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(root)
    stem = F.regexp_extract("path", r"([^/]*)\.jar$", 1)
    return files.select(library_name(stem).alias("library"), "path", "content")


def newest(archives: DataFrame) -> DataFrame:
    """The archive of each library whose numbers in the file name are the largest; ties go to the later path."""
    key = F.struct(version_key(F.substring_index("path", "/", -1)), F.col("path"))
    best = archives.groupBy("library").agg(F.max_by("path", key).alias("path"))
    return archives.join(best, ["library", "path"], "left_semi")


def classes(archives: DataFrame) -> DataFrame:
    """library, path, nth, class_name, error: the outer classes of each archive in its order, or why it can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for library, path, content in zip(f["library"], f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.endswith(".class") and "$" not in n]
                    rows += [(library, path, k, n, None) for k, n in enumerate(names)]
                except zipfile.BadZipFile as e:
                    rows.append((library, path, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["library", "path", "nth", "entry", "error"])

    out = archives.select("library", "path", "content").mapInPandas(run, "library string, path string, nth int, entry string, error string")
    return out.select("library", "path", "nth", class_name(F.col("entry")).alias("class_name"), "error")
