"""Keeping an index in step with its sources: keyed upsert, change detection, stale rows, relations, and moved paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prefix_rewritten
from ..session import written


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: the one with the largest seq. A partial aggregate, so a hot key isn't sorted in one task."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
    return newest.select(*keys, "_row.*").select(rows.columns)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """stored with the rows of new in place of those with equal keys."""
    fresh = last_wins(new, keys, seq).drop(seq)
    return stored.join(fresh, keys, "left_anti").unionByName(fresh)


def deduplicated(relations: DataFrame) -> DataFrame:
    return relations.select("from_id", "to_id", "type").distinct()


def stale(rows: DataFrame, current: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id current doesn't have. Ids aren't null; an empty current makes every row stale."""
    return rows.join(current, id, "left_anti")


def without_ends(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations neither end of which is in gone (id)."""
    out = relations.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return out.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(relations.columns)


def relations_rewritten(relations: DataFrame, old: str, new: str) -> DataFrame:
    """Either end with the prefix old gets new, each on its own."""
    return relations.withColumns({c: prefix_rewritten(F.col(c), old, new) for c in ("from_id", "to_id")})


def must_distill(hash: Column, stored_hash: Column, stored_summary: Column, force: bool = False) -> Column:
    """New, changed, or without a summary so far. stored columns come from a left join and are null for a new unit."""
    return F.lit(force) | stored_hash.isNull() | (hash != stored_hash) | (F.coalesce(stored_summary, F.lit("")) == "")


def must_embed(hash: Column, summary: Column, stored_hash: Column, stored_summary: Column, has_vector: Column) -> Column:
    """New, or not the same in hash and summary, or without a vector."""
    return stored_hash.isNull() | ~(hash.eqNullSafe(stored_hash) & summary.eqNullSafe(stored_summary) & has_vector)


def having_vectors(rows: DataFrame, vectors: DataFrame, id: str = "id") -> DataFrame:
    """rows with `has`: whether vectors, where an id is once at most, has one of theirs."""
    return rows.join(vectors.select(id, F.lit(True).alias("has")), id, "left").withColumn("has", F.coalesce("has", F.lit(False)))


def hash_multisets(units: DataFrame, group: str = "path", hash: str = "code_hash") -> DataFrame:
    """group, hash, n: how often each hash is in each group."""
    return units.groupBy(group, hash).agg(F.count(F.lit(1)).alias("n"))


def matched_groups(old: DataFrame, new: DataFrame, group: str = "path", hash: str = "code_hash") -> DataFrame:
    """old_group, new_group: groups with equal multisets of hashes, paired in order, each used once.

    A multiset is compared by its size and four sums over the digests of its members, so that no group is collected. What is ordered
    for the pairing is a name and these sums, once for each group, in ranges: however many groups have one multiset, they are numbered in many tasks.
    """
    digest = F.sha2(F.to_json(F.struct(hash, "n")), 256)
    sums = [F.sum(F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"_s{k}") for k in range(4)]
    same = ["_n", *[f"_s{k}" for k in range(4)]]

    def ranked(units: DataFrame, name: str) -> DataFrame:
        sets = hash_multisets(units, group, hash).groupBy(group).agg(F.sum("n").alias("_n"), *sums)
        return numbered(sets, same, group).select(*same, "nth", F.col(group).alias(name))

    return ranked(old, "old_group").join(ranked(new, "new_group"), [*same, "nth"]).select("old_group", "new_group")


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with nth, their number from 1 among those of equal keys by the column order, which tells them apart.

    Rows are dealt to tasks by ranges of keys and order, numbered within each range, and the numbers of earlier ranges added. So a key that
    all rows share is numbered in as many tasks as others; what meets in one window is one row for each range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, order)
    # Written, for a range is what a task had: it mustn't be drawn anew.
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return dealt.withColumn("_inside", inside).join(sizes, [*keys, "_range"]).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("nth"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """node, depth: nodes within `depth` steps of start (node) over edges (from_id, to_id), with the fewest steps."""
    return reachable_each(edges, start.select(F.lit(0).alias("start"), "node"), depth).drop("start")


def reachable_each(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, node, depth: the nodes within `depth` steps of each start over edges (from_id, to_id), with the fewest steps. starts (start, node)
    may give a start several nodes.

    A level is the nodes that the last one leads to and no level before had, written before the next; an empty one ends it. Several edges
    between two nodes count as one, and null ends lead nowhere. A node with very many edges is split by Spark's skew join.
    """
    steps = edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()
    front = written(starts.select("start", "node").distinct(), "level")
    levels = [front.withColumn("depth", F.lit(0))]
    seen = front
    for d in range(1, depth + 1):
        step = front.join(steps, front["node"] == steps["from_id"]).select("start", F.col("to_id").alias("node")).distinct()
        front = written(step.join(seen, ["start", "node"], "left_anti"), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        levels.append(front.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, levels)
