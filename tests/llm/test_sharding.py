import random
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from codequarry.llm.sharding import ORACLE_OP4, SHARDS, _fraction, interleaved


def test_rows_law_and_mixture(spark):
    rng = random.Random(3)
    rows = [(d, None if d % 50 == 0 else "é" * rng.randrange(60), "hot" if d % 3 == 0 else rng.choice(["a", "b", None]), 5) for d in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int").repartition(4)
    got = interleaved(frame, cell=40).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(SHARDS)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    for source, n in Counter(s for _, _, s, _ in rows).items():
        for shard in sizes:
            assert abs(sum(r.shard == shard and r.source == source for r in got) - n / SHARDS) <= 2
    by = {d: t for d, t, _, _ in rows}
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    oracle = con.execute(f"SELECT doc_id, size, shard, slot FROM ({ORACLE_OP4})").fetchall()
    assert sorted(oracle) == sorted((r.doc_id, r.size, r.shard, r.slot) for r in got)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", None), (1, "same", "s"), (1, "same", "s"), (1, "other", "s")]
    got = interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert interleaved(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_fraction_of_large_sources(spark):
    """rank * 2**40 passes 64 bits from rank 2**23 on."""
    rows = [(r, u, n) for n in (1, 7, 1 << 22, (1 << 22) + 1, 11_800_001, (1 << 40) + 9) for r in {0, n // 3, n // 2, (1 << 22) - 1, 1 << 22, n - 1} if r < n for u in (0, 5, (1 << 20) - 1)]
    got = spark.createDataFrame(rows, "rank long, offset long, of long").withColumn("fraction", _fraction("rank", "offset", "of")).collect()
    assert len(got) == len(rows) and all(x.fraction == (x.rank * (1 << 20) + x.offset) * (1 << 20) // x.of for x in got)


def shares(frame):
    return {(r.shard, r.many): r["count"] for r in frame.groupBy("shard", F.col("source").startswith("s").alias("many")).count().collect()}


def test_many_small_sources(spark):
    """2,400 sources of one row beside one of 2,400 rows: every shard gets its share of both."""
    rows = spark.range(4_800).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 2_400, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    got = shares(interleaved(rows))
    assert all(abs(got.get((s, many), 0) - 100) <= 4 for s in range(SHARDS) for many in (True, False))


def test_ids_all_null_and_rows_alike(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = interleaved(rows, cell=100)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} <= {833, 834}
    alike = {r.shard: r["count"] for r in got.where(f"text_crc32 = {zlib.crc32(b'same')}").groupBy("shard").count().collect()}
    assert len(alike) == SHARDS and sum(alike.values()) == 10_000 and max(alike.values()) < 550


def test_five_million_rows_of_one_source(spark):
    rows = spark.range(5_000_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 1_000_000 == 7, "rare").otherwise("hot").alias("source"))
    got = interleaved(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    assert len(got) == SHARDS and all(5_000_000 // SHARDS <= r.n <= 5_000_000 // SHARDS + 1 and r.top == r.n - 1 and r.slots == r.n for r in got)


def test_very_long_texts(spark):
    rows = [(1, "é" * 3_000_000, "a"), (2, "", "a"), (3, "b" * 1_000_000, "b")]
    got = {r.doc_id: r for r in interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 6_000_008 and got[1].text_crc32 == zlib.crc32(rows[0][1].encode()) and got[2].size == 8
