"""Vector codes by LAESA pivots: k-means codebooks for the parts of vectors, in exact integers, with distances pruned by the triangle inequality.

Every part position has a few fixed pivots, the entries of its first codebook that lie furthest apart. The squared distances of all parts
to their pivots are computed once and stored with the vectors. In each round the distances of pivots to codebook entries give a lower bound
for each part and entry, the largest difference to a pivot's distance. Entries are met in the order of their bounds, and one whose bound
lies beyond the best distance so far isn't evaluated. Evaluated distances are integers; the bounds are rounded down by more than their error, so results are exact.

A round is one scan of the stored vectors. A task sends the sums of its parts by position, entry and component, whose number doesn't depend on the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, looked_up, make_importable, table, written

#: Units of a component, parts of a vector, entries of a codebook, rounds, pivots of a part position.
SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4


def _integers(batch: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    """The rows of a batch (vec_id, label, vec) whose vectors are kept, with their components as integers in q (32 bits each); q is null
    where a width can't be cut into parts or squared distances could pass 63 bits."""
    vec = batch.column("vec")
    vec = vec.cast(pa.list_(pa.float64()))
    width = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
    flat = vec.flatten()
    x = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    edge = np.concatenate([[0], np.cumsum(np.maximum(width, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = (width >= 0) & (bad[edge[1:]] == bad[edge[:-1]])
    q: list[bytes | None] = []
    whole = np.floor(np.where(np.isfinite(x), x, 0) * SCALE)
    for i in np.flatnonzero(keep):
        mine = whole[edge[i] : edge[i + 1]]
        fits = width[i] > 0 and width[i] % parts == 0 and np.abs(mine).max() <= math.isqrt((1 << 63) - 1 - (1 << 32)) / (2 * math.sqrt(width[i]))
        q.append(mine.astype(np.int32).tobytes() if fits else None)
    at = pa.array(np.flatnonzero(keep))
    return pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(q, pa.binary())], names=["vec_id", "label", "q"])


def _matrix(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the last axis, in 64-bit integers."""
    return ((a - b) ** 2).sum(-1)


class Books:
    """Codebooks (part, entry, component) with fixed pivots (part, pivot, component), and the distances between them."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.away = np.sqrt(_squared(entries[:, :, None], pivots[:, None]).astype(float))

    @classmethod
    def first(cls, entries: np.ndarray, n_pivots: int) -> Books:
        """Pivots: entry 0, then always the entry furthest from those there are."""
        pivots = []
        for book in entries:
            picked = [0]
            while len(picked) < min(n_pivots, len(book)):
                picked.append(int(np.argmax(_squared(book[:, None], book[picked][None]).min(1))))
            pivots.append(book[picked])
        return cls(entries, np.array(pivots))

    def nearest(self, q: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For vectors (row, part, component) and their squared distances to the pivots (row, part, pivot): the nearest entry and its squared
        distance by row and part, ties to the lower index, and the number of distances that were evaluated."""
        code, error, evaluated = np.zeros(q.shape[:2], np.int64), np.zeros(q.shape[:2], np.int64), 0
        for part, book in enumerate(self.entries):
            x, near = q[:, part], np.sqrt(to_pivots[:, part].astype(float))
            bound = np.zeros((len(x), len(book)))
            for m in range(near.shape[1]):
                np.maximum(bound, np.abs(near[:, m : m + 1] - self.away[part, :, m]), out=bound)
            # Roots of 62-bit integers are off by less than 1e-9 of the larger one.
            bound -= 1e-9 * (1 + near.max(1, initial=0)[:, None] + self.away[part].max(initial=0))
            order = np.argsort(bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, order, 1)
            best, at = _squared(x, book[order[:, 0]]), order[:, 0].copy()
            evaluated += len(x)
            left = np.arange(len(x))
            for r in range(1, len(book)):
                left = left[bound[left, r] <= np.sqrt(best[left].astype(float)) * (1 + 1e-12)]
                if not len(left):
                    break
                entry = order[left, r]
                far = _squared(x[left], book[entry])
                evaluated += len(left)
                closer = (far < best[left]) | ((far == best[left]) & (entry < at[left]))
                best[left[closer]], at[left[closer]] = far[closer], entry[closer]
            code[:, part], error[:, part] = at, best
        return code, error, evaluated

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _quantised(rows: DataFrame, parts: int) -> DataFrame:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    run = lambda batches: (_integers(b, parts) for b in batches)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary")


def _with_pivots(rows: DataFrame, books: Books, width: int) -> DataFrame:
    """Quantised rows with d, the squared distances to the pivots; q is null too where the width isn't that of the codebooks."""
    parts, n = books.pivots.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = pc.fill_null(pc.equal(pc.binary_length(b.column("q")), 4 * width), False)
            good, other = b.filter(fits), b.filter(pc.invert(fits))
            q = _matrix(good.column("q"), np.int32, (parts, width // parts)).astype(np.int64)
            d = np.stack([_squared(q, books.pivots[:, m]) for m in range(n)], -1)
            yield pa.RecordBatch.from_arrays([*good.columns, pa.array([x.tobytes() for x in d], pa.binary())], names=[*b.schema.names, "d"])
            if other.num_rows:
                none = pa.nulls(other.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*other.columns[:2], none, none], names=[*b.schema.names, "d"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, d binary")


def _coded(books: Books, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers, codes and errors of a batch without null vectors."""
    parts, _, size = books.entries.shape
    q = _matrix(b.column("q"), np.int32, (parts, size)).astype(np.int64)
    code, error, _ = books.nearest(q, _matrix(b.column("d"), np.int64, (parts, books.pivots.shape[1])))
    return q, code, error


def _moved(stored: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the mean of the parts that are nearest to it, rounded down; unused entries stay."""
    parts, entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for b in batches:
            q, code, _ = _coded(books, b)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], q[:, p])
        at = np.indices(sums.shape).reshape(3, -1)
        used = n[at[0], at[1]] > 0
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(a[used], pa.int32()) for a in at], pa.array(sums[tuple(at)][used]), pa.array(n[at[0], at[1]][used])], names=["part", "entry", "component", "total", "n"]
        )

    found = stored.where("q IS NOT NULL").select("q", "d").mapInArrow(run, "part int, entry int, component int, total long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    means = books.entries.copy()
    for r in found.groupBy("part", "entry", "component").agg(wide("total"), wide("n")).collect():  # one row for each component of a codebook
        means[r.part, r.entry, r.component] = int(r.total) // int(r.n)
    return Books(means, books.pivots)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors (vec_id, embedding, label; other columns are ignored), and the codebooks (part, entry, component).

    Returns vec_id, label, code (an index for each part, two hex digits each), error (squared distance to the coded vector). Components are
    taken as floor(4096 * x). Rows whose vector is null or holds null or non-finite components are dropped. A codebook starts with the
    vectors of the smallest vec_ids (nulls last, then by components), fewer than `entries` if there are fewer. Repeated rows count again. A
    vector of another width than that of the first of these, or whose width can't be cut into parts, or with components so large that a
    squared distance could pass 63 bits, has a null code and error and takes no part. An empty table gives an empty result and no codebooks.
    """
    make_importable(vectors.sparkSession)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = _quantised(vectors.select("vec_id", label, F.col("embedding").cast("array<double>").alias("vec")), parts)
    by_id = [F.asc_nulls_last("vec_id"), "q"]
    start = [bytes(r.q) for r in rows.where("q IS NOT NULL").select("vec_id", "q").orderBy(*by_id).limit(entries).collect()]
    if any(len(q) != len(start[0]) for q in start):
        start = [bytes(r.q) for r in rows.where(F.octet_length("q") == len(start[0])).select("vec_id", "q").orderBy(*by_id).limit(entries).collect()]
    if not start:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    width = len(start[0]) // 4
    first = np.array([np.frombuffer(q, np.int32) for q in start], np.int64).reshape(len(start), parts, width // parts)
    books = Books.first(first.transpose(1, 0, 2).copy(), pivots)
    stored = written(_with_pivots(rows, books, width), "vectors")
    for _ in range(rounds):
        books = _moved(stored, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, code, error = _coded(books, b)
            codes = [c.tobytes() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.binary()), pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema if f.name in ("vec_id", "label"))
    good = stored.where("q IS NOT NULL").mapInArrow(run, f"{kinds}, code binary, error long").withColumn("code", F.lower(F.hex("code")))
    none = stored.where("q IS NULL").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = written(good.unionByName(none), "codes")
    dropped(stored)
    return out, books.entries


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes(table(spark, sf_dir, "embeddings"))
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = looked_up(rows, written(totals, "labels"), "label", "n", "vec_id")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """Assignment a{i} by codebook b{i}, and the next codebook."""
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v JOIN b{i} b ON b.p = v.p) GROUP BY vec_id, p),
s{i} AS (SELECT p, e, k, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT v.p, best.e AS e, unnest(v.x) AS y, unnest(range(len(v.x))) AS k FROM v JOIN a{i} a ON a.vec_id = v.vec_id AND a.p = v.p) GROUP BY ALL),
m{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x FROM s{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e),"""


#: Ids are unique there, as in the given table.
ORACLE_OP13 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{"".join(_round(i) for i in range(ROUNDS))}
f AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v JOIN b{ROUNDS} b ON b.p = v.p) GROUP BY vec_id, p),
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN kept USING (vec_id)
"""
