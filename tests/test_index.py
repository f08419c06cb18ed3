import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.__main__ import main
from codequarry.functions.models import HttpEmbedder, HttpSummariser, embedded, mean_pooled, summarised
from codequarry.index import Index
from codequarry.operators.report import library_api
from codequarry.plans.moves import moved, moves
from codequarry.schema import RELATIONS, ErrorCode, QuarryError
from codequarry.sources.archives import archives, classes, newest
from codequarry.sources.files import scan, units
from codequarry.streaming.follow import follow


def letters(texts):
    """A vector of letter counts."""
    return [[float(t.count(c)) for c in "abxyz"] for t in texts]


def wide(texts):
    return [[1.0] * 6 for _ in texts]


def summary(name, code):
    if name == "bad":
        raise OSError("no answer")
    return f"{name} xyz"


def put(root, **files):
    for name, text in files.items():
        path = root / (name.replace("__", "/") + ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def ids(rows):
    return sorted(r.id for r in rows.collect())


def code(f):
    with pytest.raises(QuarryError) as e:
        f()
    return e.value.code


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    put(root, a="def alpha(): pass\ndef zulu(): pass\n", sub__b="class Box:\n    def fox(self): pass\n")
    return root


def test_sync_search_and_delete(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), letters, "m1")
    assert code(lambda: index.search("x")) == ErrorCode.EMBEDDINGS_MISSING
    done = index.sync(str(tree))
    assert (done.status, done.indexed_files, done.failed) == ("success", 2, 0)
    assert ids(index.table("units")) == ids(index.table("unit_embeddings")) == ["a.py:alpha", "a.py:zulu", "sub/b.py:Box", "sub/b.py:Box.fox"]
    index.relate(spark.createDataFrame([("a.py:zulu", "else", "calls"), ("a.py:alpha", "a.py:zulu", "calls")] * 2, RELATIONS))
    hits = index.search("z", 2).collect()
    assert hits[0].id == "a.py:zulu" and [tuple(e) for e in hits[0].relations] == [("else", "calls")] and len(hits) == 2
    assert index.relations("a.py:zulu", outbound=False).count() == 1 and index.unit("a.py:alpha").first().relations[0].to_id == "a.py:zulu"
    index.depend(spark.createDataFrame([("lib", "/1"), ("lib", "/2")], "name string, path string"))
    assert index.dependency("lib").first().path == "/2"

    put(tree, a="def alpha(): return 1\n")
    (tree / "c.go").write_text("package c")
    (tree / ".gitignore").write_text("skipped.py\n")
    put(tree, skipped="def x(): pass\n")
    done = index.sync(str(tree))
    assert (done.status, done.indexed_files, [r.path for r in done.errors.collect()]) == ("error", 3, ["c.go"])
    assert ids(index.table("units")) == ids(index.table("unit_embeddings")) == ["a.py:alpha", "sub/b.py:Box", "sub/b.py:Box.fox"]
    assert [r.from_id for r in index.table("relations").collect()] == ["a.py:alpha"]
    index.delete("sub/b.py")
    assert ids(index.table("units")) == ["a.py:alpha"]


def test_widths_models_and_writers(spark, tree, tmp_path):
    at = str(tmp_path / "index")
    Index(spark, at, letters, "m1").sync(str(tree))
    assert code(lambda: Index(spark, at, wide, "m1").sync(str(tree))) == ErrorCode.EMBEDDING_MISMATCH
    other = Index(spark, at, letters, "m2")
    assert code(lambda: other.sync(str(tree), paths=["a.py"])) == ErrorCode.EMBEDDING_MISMATCH
    with pytest.warns(UserWarning, match="another model"):
        other.search("a")
    other.sync(str(tree))
    assert other.store.version().meta["embedding_model"] == "m2"
    (tree / "sub/b.py").unlink()
    rebuilt = Index(spark, at, wide, "m3")
    rebuilt.rebuild(str(tree))
    assert len(ids(rebuilt.table("units"))) == 4 and ids(rebuilt.table("unit_embeddings")) == ["a.py:alpha", "a.py:zulu"]
    before = rebuilt.store.version()
    rebuilt.depend(spark.createDataFrame([("l", "p")], "name string, path string"))
    assert code(lambda: rebuilt.store.publish(before, {})) == ErrorCode.STORAGE_BUSY
    now = rebuilt.store.version()
    for text in ("0", "x", "-3"):
        now = rebuilt.store.publish(now, {}, {"embedding_dim": text})
        assert code(lambda: rebuilt.search("a")) == ErrorCode.STORAGE_CORRUPT


def test_summaries(spark, tree, tmp_path):
    put(tree, d="def bad(): pass\n")
    index = Index(spark, str(tmp_path / "index"), letters, "m", summary)
    index.sync(str(tree))
    assert {r.name: r.summary for r in index.table("units").collect()} == {"alpha": "alpha xyz", "zulu": "zulu xyz", "Box": "Box xyz", "fox": "fox xyz", "bad": None}
    assert summarised(spark.createDataFrame([("i", "n", None)], "id string, name string, text string"), HttpSummariser()).first().summary == ""


def test_move_to_relative_paths(spark, tree):
    found = units(scan(spark, str(tree)))
    rows = [(r.id, r.path, r.code_hash) for r in found.collect()]
    old = [(("/old/a.py" if p == "a.py" else f"{tree}/{p}") + i[len(p):], "/old/a.py" if p == "a.py" else f"{tree}/{p}", h) for i, p, h in rows]
    kinds = "id string, path string, code_hash string"
    stored = spark.createDataFrame([*old, ("/gone.py:f", "/gone.py", "h"), ("/kept.jar:f", "/kept.jar", "h")], kinds)
    pairs = moves(stored, found, str(tree))
    assert {tuple(r) for r in pairs.collect()} == {("/old/a.py", "a.py"), (f"{tree}/sub/b.py", "sub/b.py")}
    edges = spark.createDataFrame([("/old/a.py:alpha", f"{tree}/sub/b.py:Box", "calls"), ("/gone.py:f", "/old/a.py:alpha", "calls")], RELATIONS)
    got = moved(stored, stored.select("id"), edges, pairs, (".jar",))
    want = sorted([i for i, _, _ in rows] + ["/kept.jar:f"])
    assert ids(got.units) == ids(got.embeddings) == want
    assert [tuple(r) for r in got.relations.collect()] == [("a.py:alpha", "sub/b.py:Box", "calls")]
    assert moves(stored.unionByName(spark.createDataFrame([("sub/b.py:q", "sub/b.py", "h")], kinds)), found, str(tree)).count() == 1


def test_a_move_that_clashes_fails_alone(spark):
    kinds = "id string, path string, code_hash string"
    stored = spark.createDataFrame([("/a.py:f", "/a.py", "1"), ("/b.py:f", "/b.py", "2"), ("/b.py:g", "/b.py", "3"), ("/c.py:f", "/c.py", "4"), ("d.py:f", "d.py", "5")], kinds)
    pairs = spark.createDataFrame([("/a.py", "x.py"), ("/b.py", "x.py"), ("/c.py", "d.py")], "old string, new string")
    edges = spark.createDataFrame([("/a.py:f", "/b.py:g", "calls")], RELATIONS)
    got = moved(stored, stored.select("id"), edges, pairs)
    assert ids(got.units) == ids(got.embeddings) == ["/b.py:f", "/b.py:g", "/c.py:f", "d.py:f", "x.py:f"]
    assert {tuple(r) for r in got.moves.collect()} == {("/a.py", "x.py")} and {r.old for r in got.clashes.collect()} == {"/b.py", "/c.py"}
    assert [tuple(r) for r in got.relations.collect()] == [("x.py:f", "/b.py:g", "calls")]


def test_index_moves_to_relative_paths(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), letters, "m")
    index.sync(str(tree))
    units_, vectors = index.table("units"), index.table("unit_embeddings")
    far = lambda c: F.concat(F.lit(f"{tree}/"), F.col(c))
    new = {"units": units_.withColumns({"id": far("id"), "path": far("path")}), "unit_embeddings": vectors.withColumn("id", far("id"))}
    index.store.publish(index.store.version(), {n: index.store.replaced(n, rows) for n, rows in new.items()})
    assert {r.new for r in index.move(str(tree)).collect()} == {"a.py", "sub/b.py"}
    assert ids(index.table("units")) == ids(index.table("unit_embeddings")) == ["a.py:alpha", "a.py:zulu", "sub/b.py:Box", "sub/b.py:Box.fox"]


def test_one_path_and_pruning(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), letters, "m")
    assert index.sync(str(tree), paths=["a.py", "none.py", "../a.py", "a.py"]).indexed_files == 1
    assert ids(index.table("units")) == ["a.py:alpha", "a.py:zulu"]
    index.sync(str(tree))
    (tree / "sub/b.py").unlink()
    index.sync(str(tree))
    assert len(ids(index.table("units"))) == 4
    index.sync(str(tree), prune=True)
    assert ids(index.table("units")) == ids(index.table("unit_embeddings")) == ["a.py:alpha", "a.py:zulu"]
    assert code(lambda: index.sync(str(tree), paths=["a.py"], prune=True)) is None


def test_an_index_without_width_and_model(spark, tree, tmp_path):
    at = str(tmp_path / "index")
    index = Index(spark, at, letters, "m")
    index.sync(str(tree))
    m = index.store.version()
    tables = {n: {"buckets": c, "folders": f} for n, (c, f) in m.tables.items()}
    index.store.create(f"{at}/manifest/{m.version + 1:020d}.json", json.dumps({"version": m.version + 1, "tables": tables}))
    with pytest.warns(UserWarning, match="another model"):
        assert index.search("z", 1).first().id == "a.py:zulu"
    assert code(lambda: Index(spark, at, wide, "m").sync(str(tree))) == ErrorCode.EMBEDDING_MISMATCH
    index.sync(str(tree))
    assert index.store.version().meta == {"embedding_dim": "5", "embedding_model": "m"}


def test_calls_at_once_are_bounded(spark):
    rows = spark.range(60).selectExpr("string(id) AS id", "'n' AS name", "'t' AS text").repartition(12)
    assert embedded(rows, letters, callers=2).rdd.getNumPartitions() == 2
    got = summarised(rows, summary, callers=2)
    assert got.rdd.getNumPartitions() == 2 and got.where("summary = 'n xyz'").count() == 60


def test_stubs_come_before_modules(spark, tmp_path):
    put(tmp_path, a="def f(): pass\n", sub__deep="def h(): pass\n")
    report = lambda: library_api(units(scan(spark, str(tmp_path), languages={"python": "py pyi"})), "lib").first().report
    assert "Function: f" in report() and "Function: h" not in report()
    (tmp_path / "sub/b.pyi").write_text("class C: ...\n")
    assert "Class: C" in report() and "## From b.pyi:" in report() and "Function: f" not in report()


def test_follow(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), letters, "m")
    follow(index, str(tree), str(tmp_path / "check")).awaitTermination(120)
    assert len(ids(index.table("units"))) == 4
    put(tree, new="def late(): pass\n")
    follow(index, str(tree), str(tmp_path / "check")).awaitTermination(120)
    assert "new.py:late" in ids(index.table("unit_embeddings")) and len(ids(index.table("units"))) == 5


def test_library_report(spark, tmp_path):
    put(tmp_path / "lib", b="def f(x): pass\n", c="")
    (tmp_path / "lib" / "__init__.py").write_text("class A:\n    def m(self): pass\n")
    lines = library_api(units(scan(spark, str(tmp_path / "lib"))), "lib").first().report.split("\n")
    assert [x for x in lines if x.startswith(("#", "- "))] == [
        "# Public API for Python Library 'lib' (Static Analysis):", "## From __init__.py:", "- **Class: A**", "## From b.py:", "- **Function: f**",
    ]


def test_archives(spark, tmp_path):
    for name in ("lib-1.9.jar", "lib-1.10.jar"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry in ("p/B.class", "p/A.class", "p/A$1.class", "META-INF/x"):
                z.writestr(entry, b"")
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    rows = classes(newest(archives(spark, str(tmp_path)))).collect()
    assert [(r.library, r.class_name) for r in sorted(rows, key=lambda r: (r.library, r.nth)) if not r.error] == [("lib", "p.B"), ("lib", "p.A")]
    assert all(r.path.endswith("lib-1.10.jar") for r in rows if not r.error) and [r.library for r in rows if r.error] == ["bad"]


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        data = [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in enumerate(texts)][::-1]
        self.send_response(200)
        self.end_headers()
        io.BufferedWriter(self.wfile).write(json.dumps({"data": data}).encode())

    def log_message(self, *_):
        pass


def test_embedding_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embed = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/v1", "m")
    assert embed(["a", "bbb"]) == [[1.0, 0.0], [3.0, 0.0]]
    rows = spark.createDataFrame([(k, "x" * (k + 1)) for k in range(33)], "id long, text string").coalesce(1)
    got = embedded(rows, embed).collect()
    assert len(got) == 33 and all(r.vec == [1.0, 0.0] for r in got)
    with pytest.raises(Exception, match="EMBEDDING_MISMATCH"):
        embedded(rows, embed, width=3).collect()
    server.shutdown()


def test_mean_pooling():
    hidden = np.array([[[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [[1.0, 1.0]] * 3])
    assert mean_pooled(hidden, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2.0, 4.0], [0.0, 0.0]]


def test_command_line(spark, tree, tmp_path, capsys):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    common = ["--root", str(tree), "--config", str(tmp_path / "c.json"), "--json"]

    def run(*words):
        done = main([*common, *words], spark)
        return done, capsys.readouterr().out

    assert run("config", "--embedding-url", "http://x")[0] == 1
    assert run("config", "--max-concurrency", "0")[0] == 1 and json.loads(run("config", "--max-concurrency", "2")[1]) == {"max_concurrency": 2}
    assert run("config", "--embedding-url", f"http://127.0.0.1:{server.server_port}", "--embedding-model", "m", "--key", "k")[1].count("***") == 1
    assert json.loads(run("search", "q")[1])["code"] == "EMBEDDINGS_MISSING"
    assert run("sync")[0] == 0 and run("sync", "--all") == (0, '{"status": "success", "indexed_files": "auto"}\n')
    assert len(json.loads(run("search", "q", "--limit", "3")[1])) == 3
    assert "- **Class: Box**" in run("api", str(tree / "sub"))[1]
    (tree / "c.go").write_text("package c")
    done, said = run("sync", str(tree / "c.go"))
    assert done == 1 and json.loads(said)["errors"][0]["file"] == "c.go"
    (tree / "c.go").unlink()
    (tree / "sub/b.py").unlink()
    assert run("sync", "--all", "--prune-missing")[0] == 0 and {h["name"] for h in json.loads(run("search", "q")[1])} == {"alpha", "zulu"}
    assert run("sync", str(tree / "a.py"), "--prune-missing")[0] == 1
    server.shutdown()


def test_a_manifest_file_is_never_written_over(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.relate(spark.createDataFrame([("a", "b", "calls")], "from_id string, to_id string, type string"))
    with pytest.raises(QuarryError) as e:
        index.store.create(f"{tmp_path}/manifest/{1:020d}.json", "{}")
    assert e.value.code == ErrorCode.STORAGE_BUSY and index.table("relations").count() == 1
