"""Moving an index to relative paths: which stored path is which file now, the rows under their new ids, and what has no file any more."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_absolute
from ..operators.maintain import matched_groups, without_ends
from ..session import written


@dataclass
class Moved:
    """Tables after the move, the moves (old, new) that were made, and those that clash and were not."""

    units: DataFrame
    embeddings: DataFrame
    relations: DataFrame
    moves: DataFrame
    clashes: DataFrame


def moves(stored: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """old, new: absolute stored paths and the relative paths of their files.

    A path below root keeps what follows root, if no stored unit has that path yet. Of the others, paths and found files that nobody
    has taken are paired where their multisets of hashes are equal, in order of path.
    """
    root = root.rstrip("/") + "/"
    paths = stored.select("path").distinct()
    taken = paths.where(~is_absolute(F.col("path")))
    absolute = paths.where(is_absolute(F.col("path")))
    below = F.startswith(F.col("path"), F.lit(root))
    under = absolute.where(below).select(F.col("path").alias("old"), F.substring("path", F.lit(len(root) + 1), F.length("path")).alias("new"))
    under = under.join(taken.withColumnRenamed("path", "new"), "new", "left_anti").select("old", "new")
    free = found.join(taken.unionByName(under.select(F.col("new").alias("path"))), "path", "left_anti")
    others = stored.where(is_absolute(F.col("path")) & ~below)
    pairs = matched_groups(others, free)
    return under.unionByName(pairs.toDF("old", "new"))


def _renamed(rows: DataFrame, moves: DataFrame, id: str) -> DataFrame:
    """rows with the path in front of the last colon of id replaced, where it moved."""
    path: Column = F.regexp_extract(id, r"^(.*):[^:]*$", 1)
    both = rows.withColumn("_old", path).join(moves.toDF("_old", "_new"), "_old", "left")
    end = F.substring(F.col(id), F.length("_old") + 1, F.length(id))
    return both.withColumn(id, F.when(F.col("_new").isNotNull(), F.concat("_new", end)).otherwise(F.col(id))).select(rows.columns)


def clashing(units: DataFrame, moves: DataFrame) -> DataFrame:
    """old, new: the moves that would give a unit the id of another one, which stays where it is or comes from a path that is first by name.

    All moves are judged as planned: one that clashes with a clashing move isn't made either.
    """
    at = _renamed(units.select("id", F.col("path").alias("old")), moves, "id").join(moves.toDF("old", "new"), "old", "left")
    at = at.withColumn("place", F.struct(F.col("new").isNotNull().alias("moves"), "old"))
    first = at.groupBy("id").agg(F.min("place").alias("first"))
    return at.join(first, "id").where("new IS NOT NULL AND place > first").select("old", "new").distinct()


def settled(units: DataFrame, moves: DataFrame) -> DataFrame:
    """old, new: the moves that can't be made, if paths move one after the other by name, and each only if none of its units would get an id
    that a unit has which stays where it is or has moved before.

    Only ids that several units would have are looked at. In every round the moves that come first for all their ids are made and those that
    share an id with one of them aren't, so that one which waited for a move that fails is judged again. Rounds go on until all are judged:
    as many as the longest chain of moves that wait for each other.
    """
    at = _renamed(units.select("id", F.col("path").alias("old")), moves, "id").join(moves.toDF("old", "new"), "old", "left")
    asked = at.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("new").isNull()).alias("stays")).where("n > 1")
    claims = written(at.where("new IS NOT NULL").join(asked, "id").select("id", "old", "stays"), "claims")
    failed = claims.where("stays").select("old").distinct()
    open_ = claims.join(failed, "old", "left_anti").select("id", "old")
    while not (open_ := written(open_, "open")).isEmpty():
        first = open_.groupBy("id").agg(F.min("old").alias("first"))
        mine = open_.join(first, "id").select("id", "old", (F.col("old") == F.col("first")).alias("leads"))
        made = written(mine.groupBy("old").agg(F.bool_and("leads").alias("made")).where("made").select("old"), "made")
        taken = open_.join(made, "old", "left_semi").select("id")
        lost = open_.join(made, "old", "left_anti").join(taken, "id", "left_semi").select("old").distinct()
        failed = written(failed.unionByName(lost), "failed")
        open_ = open_.join(made, "old", "left_anti").join(failed, "old", "left_anti")
    return moves.join(failed.toDF("old"), "old", "left_semi").select("old", "new")


def moved(units: DataFrame, embeddings: DataFrame, relations: DataFrame, moves: DataFrame, spared: tuple[str, ...] = ()) -> Moved:
    """Tables with moved paths and ids. Units of absolute paths that moved nowhere go, with their vectors and with relations at either
    end, but for paths that end in one of `spared`. A path whose move fails, as settled() has it, stays as it is. Ids are "path:name" with no
    colon in the name. What all three tables need, the moves and the ids that go, is written once."""
    moves = written(moves.select("old", "new"), "moves")
    gone = units.where(is_absolute(F.col("path"))).join(moves.select(F.col("old").alias("path")), "path", "left_anti")
    for end in spared:
        gone = gone.where(~F.endswith(F.col("path"), F.lit(end)))
    gone = written(gone.select("id"), "gone")
    kept = units.join(gone, "id", "left_anti")
    clashes = settled(kept, moves)
    moves = written(moves.join(clashes, ["old", "new"], "left_anti"), "moves")
    kept = _renamed(kept, moves, "id")
    kept = kept.join(moves.toDF("path", "_new"), "path", "left").withColumn("path", F.coalesce("_new", "path")).select(units.columns)
    edges = without_ends(relations, gone)
    return Moved(
        kept, _renamed(embeddings.join(gone, "id", "left_anti"), moves, "id"),
        _renamed(_renamed(edges, moves, "from_id"), moves, "to_id").distinct(), moves, clashes,
    )
