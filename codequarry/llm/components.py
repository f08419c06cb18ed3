"""Connected components of an edge table: chunks of edges in tasks become forests, which alternating large-star and small-star steps join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, record, written

#: Edges that a task looks at together; a table of no more is one chunk.
CHUNK = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of its component, ascending, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        i, j = label[one], label[other]
        if (i == j).all():
            break
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label != (up := label[label])).any():
            label = up
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _forests(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges with the same components: those of forest() for each chunk of a task's rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, b = forest(*np.concatenate(held, axis=1))
            return record(schema, a=pa.array(a), b=pa.array(b))

        for batch in batches:
            pairs = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
            if held and sum(h.shape[1] for h in held) + pairs.shape[1] > chunk:
                yield flush()
                held.clear()
            held.append(pairs)
        if held:
            yield flush()

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a long, b long) to rows (node, component): every node of an edge with the smallest node it can reach.

    Self-loops and repeated edges are allowed; nulls are dropped. A table of at most `chunk` edges, or what rounds have left of a larger one,
    is solved in one task. Else tasks replace chunks of their edges by forests, and a round of steps joins these; each step keeps at most one
    edge for each edge it reads. A node's minimum comes from a partial aggregate; the join that brings it back has a hub's edges under one
    key, which Spark's skew join splits where adaptive execution is on. The driver sees two numbers a round.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "components")
    state = _state(edges)
    while state[0]:
        if state[0] <= chunk:
            solved = written(_forests(edges.coalesce(1), chunk), "components")
            dropped(edges)
            edges = solved
            break
        trees = _forests(edges, chunk)
        both = written(trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components")
        dropped(edges)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        dropped(both)
        before, state = state, _state(edges)
        if state == before:
            break
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
