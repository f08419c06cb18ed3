import random

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions.vectors import l2_distance, l2_normalised, literal
from codequarry.operators import maintain as M
from codequarry.operators.search import nearest, nearest_each, with_relations


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("stem", "name"), [("lib1", "lib1"), ("lib2-1.0", "lib2"), ("a-b-2.3.jre", "a-b"), ("a-b", "a-b")])
def test_library_name(spark, stem, name):
    assert value(spark, T.library_name(F.col("s")), s=stem) == name


def test_comment_and_signature(spark):
    assert value(spark, T.cleaned_comment(F.col("s")), s="/** First\n * second\n *\n// third */") == "First\nsecond\nthird"
    assert value(spark, T.signature_stub(F.col("s"), F.lit(9), F.lit(21), " ..."), s="def f(x): return x+10 ") == "def f(x): ... "
    assert value(spark, T.embedding_text(F.col("s"), F.lit("function"), F.lit("n"), F.lit("sig()"), F.lit("d")), s="") == "function n sig() d"
    assert value(spark, T.output_path(F.col("s"), "/r"), s="src/a.py") == "/r/src/a.py" and value(spark, T.output_path(F.col("s"), "/r"), s="C:/a.py") == "C:/a.py"
    assert value(spark, T.version_key(F.col("s")), s="lib-1.10.02.jar") == [(1, "1"), (2, "10"), (1, "2")]
    assert value(spark, T.version_key(F.col("s")), s="v" + "9" * 25) == [(25, "9" * 25)]
    # By hand, from the rules for marks and white space.
    assert value(spark, T.cleaned_comment(F.col("s")), s="/**\n\t * tab one\n\t * two\r\n\t */") == "tab one\ntwo"
    assert value(spark, T.cleaned_comment(F.col("s")), s="// a /* kept */ b\r///\u00a0c\x0b#d") == "a /* kept */ b\nc\nd"
    assert value(spark, T.cleaned_comment(F.col("s")), s="x\n/** y") == "x\ny" and value(spark, T.cleaned_comment(F.col("s")), s="/**/") == ""
    assert value(spark, T.first_line(F.col("s")), s="one\r\ntwo") == "one" and value(spark, T.first_line(F.col("s")), s="a\u2028b") == "a"
    assert value(spark, T.blank_to_null(F.col("s")), s="\t\n\u3000") is None and value(spark, T.blank_to_null(F.col("s")), s="\tx y\r\n") == "x y"
    assert value(spark, T.class_name(F.col("s")), s="a/b/C.class") == "a.b.C"


def test_vectors(spark):
    assert value(spark, l2_distance(F.col("v"), literal([0, 0])), v=[3.0, 4.0]) == 5.0
    assert value(spark, l2_normalised(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]


def test_search_breaks_ties_by_id_and_attaches_relations(spark):
    units = spark.createDataFrame([(i, f"n{i}") for i in "dbca"], "id string, name string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("x", [0.0, 0.0])], "id string, vec array<float>")
    hits = nearest(units, vecs, [0.0, 0.0], 3)
    assert [r.id for r in hits.collect()] == ["a", "b", "c"]
    edges = spark.createDataFrame([("a", "zz", "calls"), ("a", "b", "calls"), ("q", "a", "calls")], "from_id string, to_id string, type string")
    got = {r.id: [tuple(e) for e in r.relations] for r in with_relations(hits, edges).collect()}
    assert got == {"a": [("b", "calls"), ("zz", "calls")], "b": [], "c": []}


def test_upsert_and_stale(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 2), ("b", 5, 3)], "id string, v int, seq int")
    assert sorted(map(tuple, M.upserted(stored, new, ["id"], "seq").collect())) == [("a", 1), ("b", 5), ("c", 4)]
    assert [r.id for r in M.stale(stored, new).collect()] == ["a"]
    assert M.stale(stored, new.limit(0)).count() == 2


def test_matched_groups_against_greedy_pairing(spark):
    rng = random.Random(4)
    sides = [[(f"{s}{g:02}", rng.choice("xyz")) for g in range(30) for _ in range(rng.randrange(1, 4))] for s in "on"]
    frames = [spark.createDataFrame(rows, "path string, code_hash string") for rows in sides]
    groups = [{p: sorted(h for q, h in rows if q == p) for p in sorted({p for p, _ in rows})} for rows in sides]
    free, want = dict(groups[0]), set()
    for p, hashes in groups[1].items():
        for q in free:
            if free[q] == hashes:
                want.add((q, p))
                del free[q]
                break
    assert {tuple(r) for r in M.matched_groups(*frames).collect()} == want


def test_rewrite_prefix_only(spark):
    assert value(spark, T.prefix_rewritten(F.col("s"), "C:/old", "new"), s="C:/old/a:f") == "new/a:f"
    assert value(spark, T.prefix_rewritten(F.col("s"), "C:/old", "new"), s="xC:/old/a:f") == "xC:/old/a:f"


def test_nearest_each(spark):
    rng = random.Random(8)
    vecs = {f"v{i}": [float(rng.randrange(4)) for _ in range(3 if i % 9 else 2)] for i in range(90)}  # many equal distances, two widths
    frame = spark.createDataFrame(list(vecs.items()), "id string, vec array<float>").repartition(3)
    units = spark.createDataFrame([(f"v{i}", i) for i in range(100) if i % 7], "id string, n int")
    asked = {q: vecs[q] for q in ("v0", "v1", "v9", "v14", "v20", "v40", "v60", "v80")}
    got = nearest_each(units, frame, spark.createDataFrame(list(asked.items()), "query_id string, vec array<float>"), 6, block=8).collect()
    want = []
    for q, x in asked.items():
        far = sorted((sum((a - b) ** 2 for a, b in zip(x, v, strict=True)) ** 0.5, i) for i, v in vecs.items() if len(v) == len(x) and int(i[1:]) % 7)
        want += [(q, i, int(i[1:]), d) for d, i in far[:6]]
    assert sorted(map(tuple, got)) == sorted(want)
