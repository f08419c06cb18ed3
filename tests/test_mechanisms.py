import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.functions.models import mean_pooled, pooled
from codequarry.functions.text import blank_to_null, stripped
from codequarry.operators import search as S
from codequarry.operators.maintain import matched_groups, numbered, reachable, reachable_each
from codequarry.plans.moves import moved, settled


def test_numbers_of_a_key_that_all_rows_share(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(0).alias("k"), (F.col("id") * 7919 % 5_003).alias("o"))
    got = numbered(rows.repartition(5), ["k"], "o")
    want, count = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.o)):
        want[r.k, r.o] = count[r.k] = count.get(r.k, 0) + 1
    assert {(r.k, r.o): r.nth for r in got.collect()} == want
    assert numbered(rows.limit(0), ["k"], "o").count() == 0


def test_many_groups_with_one_multiset_pair_in_order(spark):
    old = spark.range(3_000).select(F.format_string("/o%05d", "id").alias("path"), F.when(F.col("id") < 2_990, "h").otherwise(F.col("id").cast("string")).alias("code_hash"))
    new = spark.range(2_995).select(F.format_string("n%05d", "id").alias("path"), F.when(F.col("id") < 2_000, "h").otherwise(F.col("id").cast("string")).alias("code_hash"))
    got = {tuple(r) for r in matched_groups(old, new).collect()}
    assert got == {(f"/o{k:05d}", f"n{k:05d}") for k in range(2_000)} | {(f"/o{k:05d}", f"n{k:05d}") for k in range(2_990, 2_995)}


def test_reachable_from_many_starts(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(7, k) for k in range(40)] + [(3, 3), (5, None), (None, 6)]
    frame = spark.createDataFrame(edges * 2, "from_id long, to_id long").repartition(3)
    starts = [(s, s) for s in range(0, 60, 4)] + [(100, 1), (100, 2)]

    def slow(nodes, depth):
        seen = dict.fromkeys(nodes, 0)
        for d in range(depth):
            for a, b in edges:
                if a is not None and b is not None and seen.get(a) == d:
                    seen.setdefault(b, d + 1)
        return seen

    want = {(s, n, d) for s in {s for s, _ in starts} for n, d in slow([n for x, n in starts if x == s], 3).items()}
    got = reachable_each(frame, spark.createDataFrame(starts * 2, "start long, node long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in reachable(frame, spark.createDataFrame([(7,), (8,)], "node long"), 9).collect()} == set(slow([7, 8], 9).items())
    assert [tuple(r) for r in reachable(frame.limit(0), spark.createDataFrame([(7,)], "node long")).collect()] == [(7, 0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_of_clashing_moves(spark, seed):
    """Moves one after the other by path, each only if all its new ids are free."""
    rng = random.Random(seed)
    units, moves = {(f"r{k}.py:{n}", f"r{k}.py") for k in range(3) for n in "ab"}, {}
    for k in range(25):
        old = f"/p{k:02d}/f.py"
        moves[old] = f"r{rng.randrange(9)}.py"
        units |= {(f"{old}:{n}", old) for n in rng.sample("abcdefgh", rng.randrange(1, 4))}
    taken, want = {i for i, p in units if p not in moves}, set()
    for old in sorted(moves):
        new = {moves[old] + i[len(old) :] for i, p in units if p == old}
        if new & taken:
            want.add((old, moves[old]))
            taken |= {i for i, p in units if p == old}
        else:
            taken |= new
    frame, pairs = spark.createDataFrame(sorted(units), "id string, path string"), spark.createDataFrame(list(moves.items()), "old string, new string")
    assert {tuple(r) for r in settled(frame, pairs).collect()} == want and 0 < len(want) < 25
    out = moved(frame, frame.select("id"), spark.createDataFrame([], "from_id string, to_id string, type string"), pairs)
    ids = [r.id for r in out.units.collect()]
    assert len(ids) == len(set(ids)) == len(units) and {tuple(r) for r in out.moves.collect()} == set(moves.items()) - want
    plan = out.units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") < 20


def test_pooled_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 3) if k % 7 else None, rng.normal(size=4).tolist(), [True, False, None][k % 3 if k < 250 else 0]) for k in range(300)] + [(1, None, True), (1, [1.0, None, 1.0, 1.0], True), (9, [5.0] * 4, False)]
    got = {r.g: (r.vec, r.n) for r in pooled(spark.createDataFrame(rows, "g int, v array<double>, keep boolean").repartition(6), "g", "v", "keep").collect()}
    for g in (None, 0, 1, 2, 9):
        mine = [(v, float(bool(m))) for x, v, m in rows if x == g and v and None not in v]
        want = mean_pooled(np.array([[v for v, _ in mine]]), np.array([[m for _, m in mine]]))[0]
        assert np.allclose(got[g][0], want) and got[g][1] == len(mine)
    assert pooled(spark.createDataFrame([], "g int, v array<float>"), "g", "v").count() == 0


def test_screened_distances_are_those_of_every_pair():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-8, 1e150):
        q, v = rng.normal(size=(40, 9)) * scale, rng.normal(size=(200, 9)) * scale
        v[50:60], v[7] = v[3], q[0]
        every = np.zeros((40, 200))
        for x, y in zip(q.T, v.T, strict=True):
            every += (x[:, None] - y[None, :]) * (x[:, None] - y[None, :])
        every = np.sqrt(every)
        row, col, far = S._closest(q, v, 5)
        assert (far == every[row, col]).all()
        assert set(zip(*np.nonzero(every <= np.partition(every, 4, axis=1)[:, 4:5]), strict=True)) <= set(zip(row, col, strict=True))
        if scale == 1.0:
            assert len(row) < 40 * 20  # few of the 8,000 pairs


def test_ends_without_white_space(spark):
    long = "a" + " " * 300_000 + "b"
    texts = ["", " \t\n", " x  y　\x1f\x85", long, None, "​z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(stripped(F.col("t")).alias("s"), blank_to_null(F.col("t")).alias("b")).collect()
    assert [r.s for r in got] == ["", "", "x  y", long, None, "​z"] and [r.b for r in got] == [None, None, "x  y", long, None, "​z"]


def test_five_thousand_ignore_rules(spark, tmp_path):
    rng = random.Random(8)
    names = [f"n{k}" for k in range(40)] + ["a.py", "b.py", "x.gen.py"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)})
    lines = ["# none", "", "*.gen.py", "!n1", "n2/", "/n3", "n4/n5", "n6/**/a.py", "!n7/", "n[89]", "!n6/n?/a.py", "b.py", "!/n3/b.py", "n0/"]
    frame = spark.createDataFrame([(p, k) for k, p in enumerate(paths * 2)], "path string, ignored int").withColumnRenamed("ignored", "size")
    from codequarry.sources.files import ignored, ignored_by, scan

    want = {r.path: r.i for r in frame.select("path", ignored(F.col("path"), lines).alias("i")).collect()}
    got = ignored_by(frame, lines).collect()
    assert len(got) == len(paths) * 2 and {r.path: r.ignored for r in got} == want and 0 < sum(want.values()) < len(want)
    many = [f"other{k}" for k in range(5_000)]
    assert {r.path: r.ignored for r in ignored_by(frame, many + lines + many).collect()} == want
    for name in ("keep.py", "drop.py"):
        (tmp_path / name).write_text("")
    assert {r.path for r in scan(spark, str(tmp_path), [*many, "drop.py"]).collect()} == {"keep.py"}


def test_reports_of_all_libraries_in_one_job(spark):
    from codequarry.operators.libraries import interface_report, interface_reports

    rng, rows = random.Random(9), []
    for lib in ("one", "two", "three"):
        for f in range(15):
            for k in range(rng.randrange(0, 30)):
                rows.append((lib, f"d{f % 4}/f{f}.x", f"{f}:{k}", rng.choice(["class", "function", "module"]), rng.choice(["Up", "low"]) + str(k), rng.choice(["pub fn", "public x", "y", None]), rng.choice([None, "", "doc\nmore"]), f'{{"start_line": {rng.randrange(50)}}}'))
    rows.append(("none", "z.x", "z:1", "module", "low", "y", None, "{}"))
    units = spark.createDataFrame(rows, "library string, path string, id string, kind string, name string, signature string, docstring string, metadata string").repartition(4)
    for language in ("javascript", "rust", "go", "c_sharp"):
        got = {r.library: r.report for r in interface_reports(units, language, most=60).collect()}
        assert set(got) == {"one", "two", "three", "none"} and all(len(x.replace("\n\n", "\n").split("\n")) <= 60 for x in got.values())
        for lib, report in got.items():
            assert interface_report(units.where(F.col("library") == lib).drop("library"), lib, language, most=60).first().report == report
