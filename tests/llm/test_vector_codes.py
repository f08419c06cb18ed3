import hashlib
import math
import random

import numpy as np
import pytest

from codequarry.llm import vector_codes as V
from codequarry.llm.common import dropped, looked_up

FIELDS = "vec_id long, embedding array<float>, label int, code string, n int"


def slow(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    vectors = [(i, cut(v), lab) for i, v, lab in kept]
    first = sorted(vectors, key=lambda r: r[0])[:entries]
    books = [[v[p] for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [near(v[p], book)[1] for _, v, _ in vectors]
            for e in range(len(book)):
                mine = [v[p] for (_, v, _), x in zip(vectors, of, strict=True) if x == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, lab in vectors:
        best = [near(x, book) for x, book in zip(v, books, strict=True)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


def rows_of(seed, n, width):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(k * 3 % 1009, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.choice([1, 2, None, None, None]), "clash", k) for k in range(n)]
    rows += [(5000 + k, [0.5] * width, 7, "", 0) for k in range(60)]  # one vector many times
    odd = [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [0.0] * (width - 1) + [float("-inf")]]
    return rows + [(k, v, 1, "", 0) for k, v in enumerate(odd, 9000)]


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(300, 16, 8, 16, 6), (40, 12, 3, 5, 2), (7, 8, 8, 16, 3)])
def test_same_as_comparing_with_every_entry(spark, n, width, parts, entries, rounds):
    rows = rows_of(n, n, width)
    got, books = V.vector_codes(spark.createDataFrame(rows, FIELDS).repartition(4), parts, entries, rounds)
    want, their_books = slow(rows, parts, entries, rounds)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert books.tolist() == their_books


def test_bounds_prune_and_never_change_the_nearest():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9_000, 9_000, (8, 16, 8))
    books = V.Books.first(centres, 4)
    q = centres[np.arange(8)[None], rng.integers(0, 16, (500, 8))] + rng.integers(-300, 300, (500, 8, 8))
    q[:50] = centres[:, 3][None]  # parts equal to an entry
    books = V.Books(np.concatenate([books.entries, books.entries[:, 3:4]], 1), books.pivots)  # and an equal entry
    d = np.stack([V._squared(q, books.pivots[:, m]) for m in range(4)], -1)
    code, error, evaluated = books.nearest(q, d)
    every = V._squared(q[:, :, None], books.entries[None])
    assert (code == every.argmin(2)).all() and (error == every.min(2)).all() and evaluated < every.size / 4
    far = np.array([[[1 << 27, -(1 << 27)], [0, 0], [1 << 27, 1 - (1 << 27)]]])
    book = V.Books.first(far, 2)
    x = np.array([[[1 << 27, 1 - (1 << 27)]]])
    assert book.nearest(x, np.stack([V._squared(x, book.pivots[:, m]) for m in range(2)], -1))[0].tolist() == [[2]]


def test_vectors_that_have_no_code(spark):
    rows = [(1, [0.1] * 8, 1), (2, [1.0] * 8, 1), (3, [0.0] * 7, 1), (4, [1e30] * 8, 2), (5, [0.0] * 16, None), (None, [0.2] * 8, None), (7, [], 1)]
    got, books = V.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=2)
    assert {r.vec_id for r in got.where("code IS NULL AND error IS NULL").collect()} == {3, 4, 5, 7}
    assert {r.vec_id: r.code[:2] for r in got.where("code IS NOT NULL").collect()} == {1: "00", 2: "01", None: "00"} and books.shape == (8, 2, 1)
    none, books = V.vector_codes(spark.createDataFrame([(1, None, 1)], FIELDS.split(", code")[0]))
    assert none.count() == 0 and books.size == 0


def test_query_with_totals_and_digest(spark, tmp_path):
    rows = rows_of(2, 200, 16)
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = slow(rows, 8, 16, 6)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    totals = {lab: sum(r[3] for r in want if r[1] == lab) for lab in {r[1] for r in want}}
    got = V.op13_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, c, e, totals[lab], digest)) for i, lab, c, e in want)


def test_totals_of_hot_rare_and_missing_keys(spark):
    rows = spark.createDataFrame([(k, 0 if k < 3_000 else None if k < 4_000 else k) for k in range(6_000)], "id long, key int")
    totals = rows.where("key IS NULL OR key % 2 = 0").groupBy("key").agg({"id": "count"}).toDF("key", "n")
    got = {r.id: r.n for r in looked_up(rows, totals, "key", "n", "id").collect()}
    assert got == {k: 3_000 if k < 3_000 else 1_000 if k < 4_000 else None if k % 2 else 1 for k in range(6_000)}
    assert dropped  # tables of the operator are deleted by it
