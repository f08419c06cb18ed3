import pytest
from pyspark.sql import functions as F

from codequarry.plans.sync import planned
from codequarry.sources import files as files_module
from codequarry.sources.files import ignored, listed, python_units, scan, units

CODE = b'''# About the class.
class MyClass:
    # Not a sibling of the class body.
    def method(self, x):
        return x

    # Twice.
    def method(self):
        def helper(): pass
        return helper


@decorated
async def top_level_fn(a,
                       b=1):
    return a
'''


def test_python_units():
    got = {u["id"]: u for u in python_units("a.py", CODE)}
    assert list(got) == ["a.py:MyClass", "a.py:MyClass.method", "a.py:MyClass.method#2", "a.py:MyClass.method#2.helper", "a.py:top_level_fn"]
    assert got["a.py:MyClass"]["kind"] == "class" and got["a.py:MyClass.method"]["kind"] == "function"
    assert got["a.py:MyClass"]["docstring"] == "About the class." and got["a.py:MyClass.method#2"]["docstring"] == "Twice."
    assert got["a.py:MyClass.method"]["docstring"] is None and got["a.py:top_level_fn"]["docstring"] is None
    assert got["a.py:MyClass.method"]["signature"] == "def method(self, x):\n         ..."
    assert got["a.py:top_level_fn"]["signature"].startswith("async def top_level_fn(a,") and '"start_line": 14' in got["a.py:top_level_fn"]["metadata"]


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        (["*.gen.py"], "a/b.gen.py", True), (["/build"], "build/x.py", True), (["/build"], "a/build/x.py", False), (["build/"], "a/build/x.py", True),
        (["a/**/z.py"], "a/b/c/z.py", True), (["*.py", "!keep.py"], "keep.py", False), (["src/generated/"], "src/generated/x.py", True),
        (["# a", "", "x?.py"], "x1.py", True), (["[ab].py"], "c.py", False), ([".db"], "a.db", False),
    ],
)
def test_ignore_rules(spark, rules, path, want):
    assert spark.range(1).select(ignored(F.lit(path), rules).alias("x")).first().x is want


def test_listing_deals_folders_to_tasks(spark, tmp_path, monkeypatch):
    want = set()
    for k in range(40):
        path = tmp_path / "/".join(f"d{j}" for j in range(k % 7)) / f"_x{k}" / f"f{k}.py"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("")
        want.add(str(path.relative_to(tmp_path)))
    (tmp_path / "top.txt").write_text("")
    (tmp_path / "again").symlink_to(tmp_path)
    for most in ((256, 64), (2, 1), (1, 1)):
        monkeypatch.setattr(files_module, "OPEN", most)
        assert sorted(r.path for r in listed(spark, str(tmp_path)).collect()) == sorted(want | {"top.txt"})
    assert listed(spark, f"{tmp_path}/").count() == 41


def test_scan_and_sync(spark, tmp_path):
    for name, text in {"a.py": CODE, "bad.py": b"def (", "b.go": b"package b", "venv/c.py": b"x = 1", "note.txt": b"", "sub/d.py": b"def d(): pass\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    files = scan(spark, str(tmp_path))
    assert {r.path: r.language for r in files.collect()} == {"a.py": "python", "bad.py": "python", "b.go": "go", "sub/d.py": "python"}
    found = units(files)
    kinds = "id string, kind string, name string, path string, signature string, docstring string, code_hash string, metadata string, summary string"
    same = next(u for u in python_units("sub/d.py", b"def d(): pass\n"))
    stored = spark.createDataFrame(
        [(same["id"], "function", "d", "sub/d.py", "", None, same["code_hash"], "{}", "says d"), ("a.py:gone", "function", "gone", "a.py", "", None, "h", "{}", "s"),
         ("b.go:x", "function", "x", "b.go", "", None, "h", "{}", "s"), ("bad.py:y", "function", "y", "bad.py", "", None, "h", "{}", "s"),
         ("else.py:z", "function", "z", "else.py", "", None, "h", "{}", "s"), ("a.py:MyClass", "class", "MyClass", "a.py", "", None, "old", "{}", "s")], kinds)
    plan = planned(found, stored, spark.createDataFrame([(same["id"],), ("a.py:MyClass",)], "id string"), files)
    assert {r.id for r in plan.stale.collect()} == {"a.py:gone", "bad.py:y"}
    assert [r.path for r in plan.rejects.collect()] == ["b.go"]
    rows = {r.id: r for r in plan.units.collect()}
    assert set(rows) == {u["id"] for u in python_units("a.py", CODE)} | {same["id"], "b.go:x", "else.py:z"}
    assert not rows[same["id"]].embed and rows[same["id"]].summary == "says d" and rows["a.py:MyClass"].embed and rows["a.py:MyClass"].distill
    assert {r.id for r in plan.pending.collect()} == {u["id"] for u in python_units("a.py", CODE)}
