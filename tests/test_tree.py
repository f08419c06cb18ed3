import pytest
from pyspark.sql import functions as F

from codequarry.sources import tree as T
from codequarry.sources.files import LANGUAGES, ignored, scan


def put(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n")


@pytest.fixture
def tree(tmp_path):
    put(tmp_path, *[f"big/m{i:04d}.py" for i in range(300)], "a.py", "__init__.py", "b.go", "note.txt", "sub/deep/er/x.TS", "sub/y.py", "venv/z.py", "gen/out/g.py", "gen/keep.py", "sub/.hidden.py")
    (tmp_path / ".gitignore").write_text("gen/\n/b.go\n")
    (tmp_path / "again").symlink_to(tmp_path / "sub")
    return tmp_path


def rows(df):
    return sorted((r.path, r.language, bytes(r.content)) for r in df.collect())


def test_same_rows_as_a_scan(spark, tree):
    want = rows(scan(spark, str(tree), ["gen/", "/b.go"]))
    assert len(want) == 305
    assert rows(T.source_tree(spark, str(tree))) == want == rows(T.source_tree(spark, f"file://{tree}", files=7, folders=2))
    assert len(rows(T.source_tree(spark, str(tree), []))) == 308
    assert rows(T.source_tree(spark, str(tree), ["*", "!*.py", "big/"])) == rows(scan(spark, str(tree), ["*", "!*.py", "big/"]))
    assert {r.language for r in T.source_tree(spark, str(tree), languages={"text": "txt"}, contents="false").collect()} == {"text"}
    (tree / "none").mkdir()
    assert T.source_tree(spark, f"{tree}/none").count() == 0


def test_one_large_folder_is_read_by_many_tasks(spark, tree):
    df = T.source_tree(spark, str(tree), files=20)
    parts = df.select(F.spark_partition_id().alias("p"), "path").groupBy("p").count().collect()
    assert len(parts) >= 15 and max(r["count"] for r in parts) <= 40


def test_narrowed_scans(spark, tree):
    get = lambda **how: {r.path for r in T.source_tree(spark, str(tree), contents="false", **how).collect()}
    assert get(prefix="sub/deep/", only=["typescript"]) == {"sub/deep/er/x.TS"} and get(prefix="sub/deep/", only=["go"]) == set()
    assert get(paths=["a.py", "sub/y.py", "venv/z.py", "none.py"]) == {"a.py", "sub/y.py"}
    assert len(get(suffix="0.py", prefix="big/")) == 30 and len(get()) == 305


def test_a_narrowed_scan_leaves_others_alone(spark, tree):
    df = T.source_tree(spark, str(tree), contents="false")
    assert df.where("language = 'typescript'").count() == 1 and df.count() == 305
    assert df.where("path = 'a.py'").union(df.where("path = 'sub/y.py'")).count() == 2


def counted(names):
    """A lister over names, and the folders that it listed."""
    seen = []

    def entries(folder):
        seen.append(folder)
        found = {n[: n.index("/", len(folder)) + 1] if "/" in n[len(folder) :] else n for n in names if n.startswith(folder)}
        return [(n, n.endswith("/")) for n in found]

    return entries, seen


def test_folders_that_cannot_matter_are_not_listed():
    names = [f"{a}/{b}/f{i}.py" for a in "pqr" for b in "xyz" for i in range(3)] + ["venv/lib/v.py", "top.py"]
    every = T.Wanted.of([], LANGUAGES)
    entries, seen = counted(names)
    T.runs(entries, every)
    assert len(seen) == 1 + 3 + 9 and "venv/" not in seen
    entries, seen = counted(names)
    out = T.runs(entries, every.narrowed("p/x"))
    assert seen == ["", "p/", "p/x/"] and [p.folder for r in out for p in r.parts] == ["p/x/"]
    entries, seen = counted(names)
    T.runs(entries, every.narrowed(paths=("q/y/f1.py", "top.py")))
    assert seen == ["", "q/", "q/y/"]
    entries, seen = counted(names)
    T.runs(entries, T.Wanted.of(["r/*", "q/?/"], LANGUAGES))
    assert "r/x/" not in seen and "q/" in seen and "q/x/" not in seen
    entries, seen = counted(names)
    T.runs(entries, T.Wanted.of(["r/", "!keep.py"], LANGUAGES))
    assert "r/x/" in seen  # its files could be taken back


def test_a_hundred_thousand_files_and_a_limit_of_folders():
    names = [f"big/f{i:06d}.py" for i in range(100_000)]
    entries, seen = counted_flat(names)
    out = T.runs(entries, T.Wanted.of([], LANGUAGES), 1_000, 10)
    assert len(out) == 100 and all(len(r.parts) == 1 and r.parts[0].folder == "big/" for r in out)
    got = [p for r in out[:3] for p, _ in T.members(entries, T.Wanted.of([], LANGUAGES), r)]
    assert got == names[:3_000]
    names = [f"d{i}/e{j}/f.py" for i in range(9) for j in range(9)]
    entries, seen = counted(names)
    out = T.runs(entries, T.Wanted.of([], LANGUAGES), 4, 5)
    assert len(seen) == 5 and sum(p.deep for r in out for p in r.parts) == 5 + 4 * 9
    assert sorted(p for r in out for p, _ in T.members(entries, T.Wanted.of([], LANGUAGES), r)) == sorted(names)


def counted_flat(names):
    return (lambda folder: [(n, False) for n in names] if folder else [("big/", True)]), None


def test_rules_agree_with_those_on_columns(spark):
    paths = ["a.py", "x/a.py", "x/y/a.py", "build/z.py", "x/build/z.py", "keep.py", "x/keep.py", "s/generated/q.py", "x1.py", "db", "a.db", "n/.db/x.py"]
    for rules in (["*.py", "!keep.py"], ["/build"], ["build/"], ["x/**/a.py"], ["s/generated/", "x?.py"], ["[ax]*.py"], ["**/y/**"]):
        want = {r.p: r.i for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(F.col("p"), rules).alias("i")).collect()}
        mine = T.Wanted(LANGUAGES, tuple(r for r in map(T.ignore_rule, rules) if r))
        assert {p: mine.ignored(p) for p in paths} == want
