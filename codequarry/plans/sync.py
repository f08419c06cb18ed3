"""One synchronisation of an index as a plan of joins: what changed, what must be embedded, what is stale, and the tables after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_absolute
from ..operators.maintain import having_vectors, must_distill, must_embed


@dataclass
class Plan:
    """units: the table after the synchronisation; fresh: those of its rows that were found; pending: units to embed; stale: ids to delete;
    rejects: files with an error."""

    units: DataFrame
    fresh: DataFrame
    pending: DataFrame
    stale: DataFrame
    rejects: DataFrame


def planned(found: DataFrame, stored: DataFrame, embedded: DataFrame, scanned: DataFrame, force: bool = False, summaries: Callable[[DataFrame], DataFrame] | None = None, prune: bool = False, gone: DataFrame | None = None) -> Plan:
    """Compare units found in files (with `error`) with stored units and the ids that have a vector (id).

    Stored units of the scanned files (path) that weren't found are stale, but for files with an error, which stay as they are; files
    that weren't scanned stay too, unless prune is set and their paths are relative, or `gone` (path) has them. A found unit keeps its stored summary unless it changed or force is set; those to distil have
    `distill` set in pending and units. summaries makes (id, summary) of those (id, name, code); where it gives null, what was kept stays.
    """
    rejects = found.where("error IS NOT NULL").select("path", "error")
    new = found.where("error IS NULL").drop("error")
    old = stored.select("id", F.col("code_hash").alias("old_hash"), F.col("summary").alias("old_summary"))
    both = having_vectors(new.join(old, "id", "left"), embedded)
    distill = must_distill(F.col("code_hash"), F.col("old_hash"), F.col("old_summary"), force)
    both = both.withColumn("distill", distill).withColumn("summary", F.when(F.col("code_hash").eqNullSafe(F.col("old_hash")) & ~F.lit(force), F.col("old_summary")))
    if summaries is not None:
        fresh = summaries(both.where("distill").select("id", "name", "code")).select("id", F.col("summary").alias("fresh"))
        both = both.join(fresh, "id", "left").withColumn("summary", F.coalesce("fresh", "summary")).drop("fresh")
    embed = must_embed(F.col("code_hash"), F.col("summary"), F.col("old_hash"), F.col("old_summary"), F.col("has"))
    both = both.withColumn("embed", embed).drop("old_hash", "old_summary", "has")
    good = scanned.select("path").join(rejects, "path", "left_anti")
    stale = stored.join(good, "path", "left_semi").join(new, "id", "left_anti").select("id")
    if prune:
        stale = stale.unionByName(stored.where(~is_absolute(F.col("path"))).join(scanned.select("path"), "path", "left_anti").select("id"))
    if gone is not None:
        stale = stale.unionByName(stored.join(gone.select("path").distinct(), "path", "left_semi").select("id")).distinct()
    kept = stored.join(stale, "id", "left_anti").join(new, "id", "left_anti")
    units = kept.withColumns({"distill": F.lit(False), "embed": F.lit(False)}).unionByName(both, allowMissingColumns=True)
    return Plan(units, both, both.where("embed"), stale, rejects)


def outcome(files: DataFrame, failed: DataFrame, *by: str) -> DataFrame:
    """indexed_files, failed: how many files (path) were looked at and how many of them are in failed (path), in all or for each value of `by`."""
    both = files.join(failed.select("path", F.lit(1).alias("_bad")).distinct(), "path", "left")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("indexed_files"), F.count("_bad").alias("failed"))
