"""Names inside scopes, and per-file reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import metadata_field


def qualified_names(rows: DataFrame, scope: str, name: str, order: list[str], out: str = "qualified_name") -> DataFrame:
    """scope.name, or scope.name#k for the k-th of a name in its scope."""
    k = F.row_number().over(Window.partitionBy(scope, name).orderBy(*order))
    return rows.withColumn(out, F.concat(F.col(scope).cast("string"), F.lit("."), F.col(name), F.when(k > 1, F.concat(F.lit("#"), k.cast("string"))).otherwise("")))


def top_per_file(rows: DataFrame, file: str, order: list, n: int) -> DataFrame:
    """The first n rows of each file, with their `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("rank") <= n)


def markdown(rows: DataFrame, file: str, line: str, most: int) -> DataFrame:
    """file, n_lines, report: a heading and at most `most` lines of each file, in order."""
    first = top_per_file(rows.select(file, line), file, [line], most)
    lines = first.groupBy(file).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.select(
        file, F.size("lines").cast("long").alias("n_lines"),
        F.concat(F.lit("# "), F.col(file), F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("report"),
    )


def library_api(units: DataFrame, library: str, files: int = 5, most: int = 100) -> DataFrame:
    """report: one row, the classes and top-level functions of the first files (__init__ first, then by name), in at most `most` lines.

    units are rows of sources.files.units; files without such units don't count. Stubs (.pyi) of any folder are shown; only where there
    are none, the modules of the top folder. What is brought together is bounded by `files` and `most`.
    """
    name = F.substring_index("path", "/", -1)
    shown = units.where(F.col("error").isNull() & ((F.col("kind") == "class") | ~F.substring_index("id", ":", -1).contains(".")))
    stub = F.endswith(F.col("path"), F.lit(".pyi"))
    places = shown.where(stub | ~F.col("path").contains("/"))
    first = places.select("path", F.struct((~stub).alias("module"), name != "__init__.py", name, F.col("path")).alias("place")).distinct().orderBy("place").limit(files)
    first = first.withColumn("_module", F.min("place.module").over(Window.partitionBy(F.lit(1)))).where("place.module = _module").drop("_module")
    at = F.struct("place", metadata_field("metadata", "start_line").cast("int"), F.col("id")).alias("at")
    top = shown.join(F.broadcast(first), "path").select(at, name.alias("file"), "kind", "name", "signature").orderBy("at").limit(most)
    rows = F.sort_array(F.collect_list(F.struct("at", "file", "kind", "name", "signature")))
    lines = F.flatten(F.transform("rows", lambda x, k: F.concat(
        F.when((k > 0) & (F.col("rows")[F.greatest(k - 1, F.lit(0))]["at"]["place"] == x["at"]["place"]), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("\n## From "), x["file"], F.lit(":")))),
        F.array(F.concat(F.lit("- **"), F.initcap(x["kind"]), F.lit(": "), x["name"], F.lit("**")), F.concat(F.lit("  `"), x["signature"], F.lit("`"))),
    )))
    head = F.lit(f"# Public API for Python Library '{library}' (Static Analysis):")
    return top.agg(rows.alias("rows")).select(F.array_join(F.slice(F.concat(F.array(head), lines), 1, most), "\n").alias("report"))
