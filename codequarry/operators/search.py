"""Exact nearest-vector search over an index, with the relations of the hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance, literal
from ..session import written

#: Vectors of a block, and queries of a partition.
BLOCK, QUERIES = 1024, 8192


def nearest(units: DataFrame, embeddings: DataFrame, query: Sequence[float], k: int = 5, id: str = "id", vec: str = "vec") -> DataFrame:
    """The k units whose vectors are closest to query, with `distance`; ties go to the smaller id.

    A unit without a vector isn't found, nor is a vector without a unit, or of another width. Distances come from the scan of the
    embeddings; of the units only ids are compared with them, and the k rows alone meet the units' columns.
    """
    near = embeddings.select(F.col(id), l2_distance(F.col(vec), literal(query)).alias("distance")).where("distance IS NOT NULL")
    top = near.join(units.select(id), id, "left_semi").orderBy("distance", id).limit(k)
    return units.join(F.broadcast(top), id).orderBy("distance", id).limit(k)


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    """rows (id, vec) packed: {name}_ids, {name}_vecs (doubles, one vector after another) and {name}_width, by ascending id in a block."""
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"{name}_ids", f"{name}_vecs", f"{name}_width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block).sort_by("id")
                widths = pc.list_value_length(b.column("vec")).to_numpy()
                for w in np.unique(widths):
                    part = b.filter(pa.array(widths == w))
                    vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False).tobytes()
                    ids = part.column("id")
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([lists, pa.array([vecs], pa.binary()), pa.array([int(w)], pa.int32())], names=names)

    return rows.mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary, {names[2]} int")


def _closest(q: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and of v, with their distances, among which are the n closest to every row of q, ties included.

    One matrix product gives all squared distances up to rounding. Only those within the n-th of them and twice the most that rounding can
    do are computed in the order of the dimensions, as in l2_distance.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (q * q).sum(1), (v * v).sum(1)
        rough = a[:, None] + b[None, :] - 2 * (q @ v.T)
        slack = 8 * np.finfo(float).eps * (q.shape[1] + 4) * (a[:, None] + b.max(initial=0))
        near = rough <= np.partition(rough, n - 1, axis=1)[:, n - 1 : n] + 2 * slack
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        near[:] = True  # squares beyond the range of doubles say nothing
    row, col = np.nonzero(near)
    far = np.zeros(len(row))
    for x, y in zip(q.T, v.T, strict=True):
        step = x[row] - y[col]
        far += step * step
    return row, col, np.sqrt(far)


def nearest_each(units: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """For every row of queries (query_id, vec), what nearest() finds for its vector: query_id, the unit's columns and `distance`.

    Every block of queries meets every block of vectors. Only
    the k best of a query in a block are shuffled. A vector of another width, or with a null, has no distance and isn't found.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    found = embeddings.join(units.select(id), id, "left_semi").where(whole(vec)).select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    asked = queries.where(whole("vec")).select(F.col("query_id").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES)))
    kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, id {found.schema['id'].dataType.simpleString()}, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                asks, ids = b.column("q_ids")[i].values, b.column("v_ids")[i].values
                width = b.column("q_width")[i].as_py()
                if width != b.column("v_width")[i].as_py():
                    continue
                q, v = (np.frombuffer(b.column(c)[i].as_py()).reshape(len(x), width) for c, x in (("q_vecs", asks), ("v_vecs", ids)))
                n = min(k, len(ids))
                row, col, far = _closest(q, v, n)
                order = np.lexsort((col, far, row))  # places in a block follow the ids
                row, col, far = row[order], col[order], far[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < n
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(row[first])), ids.take(pa.array(col[first])), pa.array(far[first])], names=["query_id", "id", "distance"])

    # Not joined by width, a single key that would gather all blocks in one task. Written, for every partition of queries reads them again.
    best = _blocks(asked, "q", block).crossJoin(written(_blocks(found, "v", block), "vectors")).mapInArrow(run, kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = best.withColumn("_place", place).where(F.col("_place") <= k).select("query_id", F.col("id").alias(id), "distance")
    return best.join(units, id).select("query_id", *units.columns, "distance")


def relations_of(relations: DataFrame, id: str | int, outbound: bool = True) -> DataFrame:
    """The relations that leave a unit, or those that reach it."""
    return relations.where(F.col("from_id" if outbound else "to_id") == id)


def with_relations(hits: DataFrame, relations: DataFrame, id: str = "id", source: str = "from_id", bounded: bool = True) -> DataFrame:
    """hits with `relations`: the sorted list of their outbound edges, empty where there is none. bounded: hits is a short list."""
    ids = hits.select(F.col(id).alias(source)).distinct()
    ids = F.broadcast(ids) if bounded else ids
    others = [c for c in relations.columns if c != source]
    edges = relations.join(ids, source, "left_semi").groupBy(source).agg(F.sort_array(F.collect_set(F.struct(*others))).alias("relations"))
    out = hits.join(edges.withColumnRenamed(source, id), id, "left")
    return out.withColumn("relations", F.coalesce("relations", F.array().cast(edges.schema["relations"].dataType)))
