import json

import pytest
from pyspark.sql import functions as F

from codequarry.index import Index
from codequarry.operators.libraries import entry_points, folder, imports, interface_report, normalised, traversed

UNIT = "path string, id string, kind string, name string, signature string, docstring string, code string, metadata string"


def unit(path, name, kind="function", signature="", docstring=None, code="", line=1, node=""):
    return (path, f"{path}:{name}", kind, name, signature, docstring, code, json.dumps({"start_line": line, "node_type": node}))


def frames(spark, units, paths):
    return spark.createDataFrame(units, UNIT), spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("/./x", "x"), ("a/../../b", "b"), ("", ""), ("a//b", "a/b")])
def test_normalised(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(normalised(F.col("p")).alias("x")).first().x == want


def test_folder(spark):
    rows = spark.createDataFrame([("a/b/c.js",), ("c.js",)], "p string").select(folder(F.col("p")).alias("x")).collect()
    assert [r.x for r in rows] == ["a/b", ""]


def test_script_imports_and_traversal(spark):
    export = lambda path, to, nth=1: unit(path, f"e{nth}", "module", code=f"export * from '{to}'", node="export_statement")
    units = [
        export("index.js", "./lib/a"), export("index.js", "./lib/a", 2), export("lib/a.d.ts", "../lib/b"), export("lib/b/index.ts", "react"),
        export("lib/b/index.ts", "../gone", 2), export("lib/b/index.ts", "../../index", 3), export("lib/b/index.ts", "./deep.min", 4),
        export("lib/b/deep.js", "./deeper"), unit("lib/c.js", "f", code="from './a'"), (None,) * 8,
    ]
    u, files = frames(spark, units, ["index.js", "lib/a.d.ts", "lib/a.js", "lib/b/index.ts", "lib/c.js", "lib/b/deep.js", "lib/b/deeper.ts", "lib/b/deeper.ts"])
    got = sorted(map(tuple, imports(u, files, "javascript").collect()))
    assert got == [("index.js", "lib/a.d.ts"), ("lib/a.d.ts", "lib/b/index.ts"), ("lib/b/deep.js", "lib/b/deeper.ts"), ("lib/b/index.ts", "index.js"), ("lib/b/index.ts", "lib/b/deep.js")]
    seen = traversed(u, files, spark.createDataFrame([("index.js",), ("not there.js",)], "path string"), "javascript")
    assert {r.path: r.depth for r in seen.collect()} == {"index.js": 0, "lib/a.d.ts": 1, "lib/b/index.ts": 2, "lib/b/deep.js": 3}


def test_module_imports(spark):
    mod = lambda name, code: unit("src/lib.rs", name, "module", code=code, node="mod_item")
    u, files = frames(spark, [mod("a", "pub mod a;"), mod("b", "mod b;"), mod("c", "mod c { fn x(); }"), mod("d", "mod d;")], ["src/a.rs", "src/a/mod.rs", "src/b/mod.rs", "src/c.rs", "d.rs"])
    assert sorted(r.to_id for r in imports(u, files, "rust").collect()) == ["src/a.rs", "src/b/mod.rs"]


def test_entry_points():
    paths = {"t.d.ts", "x.d.ts", "m.js", "index.js"}
    assert entry_points({"types": "./t.d.ts", "exports": {".": {"types": "./x.d.ts"}}, "main": "m.js"}, paths) == ["t.d.ts", "x.d.ts"]
    assert entry_points({"types": "gone.d.ts", "exports": "./m.js", "main": "m.js"}, paths) == ["m.js"]
    assert entry_points({}, paths) == ["index.js"] and entry_points({}, set()) == []


def test_report(spark):
    units = [unit("main.go", "Run", signature="func Run() { ... }", docstring="Runs.\nMore."), unit("main.go", "hidden", line=2), unit("a.go", "", line=1)]
    units += [unit("a.go", f"F{i}", line=30 - i) for i in range(25)]
    u, _ = frames(spark, units, [])
    lines = interface_report(u, "m", "go").first().report.split("\n")
    assert lines[:6] == ["# Public API for Go Module 'm':", "", "## From main.go:", "- **Function: Run**", "  *(Runs.)*", "  `func Run() { ... }`"]
    assert [x for x in lines if x.startswith("- ")][1:] == [f"- **Function: F{i}**" for i in range(24, 4, -1)]
    assert interface_report(u.limit(0), "m", "go").first().report == "# Public API for Go Module 'm':"
    shown = interface_report(u, "m", "go", most=4).first().report.split("\n")
    assert shown == lines[:5]  # a heading is one entry of two lines


def test_public_rules(spark):
    units = [unit(f"{i:02}.cs", f"C{i}", "class", "public class C" if i % 2 else None) for i in range(24)] + [unit("bin/00.cs", "Out", "class", "public class Out")]
    report = interface_report(frames(spark, units, [])[0], "p", "c_sharp").first().report
    assert [x for x in report.split("\n") if x.startswith("- ")] == [f"- **Class: C{i}**" for i in range(1, 10, 2)]


def test_index_reports_a_crate(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("pub mod a;\nfn own() {}\n")
    (tmp_path / "src/a.rs").write_text("pub fn open() {}\n")
    (tmp_path / "src/far.rs").write_text("pub fn far() {}\n")

    def parser(path, content):
        for n, line in enumerate(content.decode().splitlines()):
            module = " mod " in line
            yield {"id": f"{path}:{n}", "kind": "module" if module else "function", "name": line.split()[-1 if module else -2].rstrip(";(){}"), "path": path, "signature": line, "code": line,
                   "metadata": json.dumps({"start_line": n + 1, "node_type": "mod_item" if module else "function_item"})}

    report = Index(spark, str(tmp_path / "index"), parsers={"rust": parser}).api(str(tmp_path), "c", "rust", ["src/lib.rs", "src/main.rs"])
    assert report.split("\n") == ["# Public API for Rust Crate 'c':", "", "## From a.rs:", "- **Function: open**", "  `pub fn open() {}`"]
