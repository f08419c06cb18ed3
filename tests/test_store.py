import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.schema import ErrorCode, QuarryError
from codequarry.store import Store

ITEM = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), {"item": (ITEM, ["id"]), "pair": (ITEM, ["id", "name"])}, 32)


def items(spark, ids, name):
    return spark.createDataFrame([(i, f"{name}{i}") for i in ids], ITEM)


def rows(df):
    return sorted((r.id, r.name) for r in df.collect())


def test_a_small_upsert_writes_few_buckets(spark, store):
    assert store.table("item").count() == 0 and store.version().version == 0
    first = store.upsert("item", items(spark, range(1_000), "a"))
    assert len(first.tables["item"][1]) == 32
    after = store.upsert("item", items(spark, [*range(5), *range(2_000, 2_005)], "b"))
    changed = {b for b, f in after.tables["item"][1].items() if first.tables["item"][1].get(b) != f}
    assert 0 < len(changed) <= 10
    assert rows(store.table("item")) == sorted([(i, f"a{i}") for i in range(5, 1_000)] + [(i, f"b{i}") for i in [*range(5), *range(2_000, 2_005)]])
    assert rows(store.table("item", first)) == sorted((i, f"a{i}") for i in range(1_000))  # a reader of the version before
    untouched = store.upsert("item", items(spark, [], "c"))
    assert untouched.tables == after.tables and untouched.version == 3


def test_drops_and_several_tables_at_once(spark, store):
    store.upsert("item", items(spark, range(20), "a"))
    before = store.version()
    gone = spark.range(0, 20, 2).select("id")
    tables = {"item": store.changed("item", before, items(spark, [2, 3], "z"), gone), "pair": store.changed("pair", before, items(spark, [1, 1], "p").distinct())}
    assert rows(store.table("item")) == sorted((i, f"a{i}") for i in range(20))  # nothing is seen yet
    store.publish(before, tables, {"k": "v"})
    assert rows(store.table("item")) == sorted([(i, f"a{i}") for i in range(1, 20, 2) if i != 3] + [(2, "z2"), (3, "z3")])
    assert rows(store.table("pair")) == [(1, "p1")] and store.version().meta == {"k": "v"}
    now = store.version()
    store.publish(now, {"item": store.changed("item", now, drop=store.table("item").select("id"))})
    assert store.table("item").count() == 0 and store.version().tables["item"] == (32, {})


def test_the_later_of_two_writers_fails(spark, store):
    before = store.version()
    store.upsert("item", items(spark, [1], "a"))
    with pytest.raises(QuarryError) as e:
        store.publish(before, {"item": store.changed("item", before, items(spark, [2], "b"))})
    assert e.value.code == ErrorCode.STORAGE_BUSY and rows(store.table("item")) == [(1, "a1")]


def test_other_bucket_numbers_and_vacuum(spark, store):
    for name in "abcd":
        store.upsert("item", items(spark, range(100), name))
    now = store.version()
    store.publish(now, {"item": store.replaced("item", store.table("item"), 3)})
    assert set(store.version().tables["item"][1]) == {0, 1, 2}
    store.upsert("item", items(spark, [5], "e"))
    assert store.version().tables["item"][0] == 3
    want = rows(store.table("item"))
    assert store.vacuum() > 3 and rows(store.table("item")) == want and store.vacuum() == 0
    assert want == sorted([(i, f"d{i}") for i in range(100) if i != 5] + [(5, "e5")])


def test_keys_of_one_hash_bucket_and_null_columns(spark, store):
    one = store.version()
    same = [r.id for r in spark.range(400).withColumn("b", store.bucket("item", one)).where("b = 7").collect()]
    new = store.upsert("item", spark.createDataFrame([(i, None) for i in same], ITEM))
    assert set(new.tables["item"][1]) == {7} and store.table("item").where(F.col("name").isNull()).count() == len(same)
