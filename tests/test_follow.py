import os

import pytest

from codequarry.index import Index
from codequarry.streaming import follow as S


def letters(texts):
    return [[float(t.count(c)) for c in "abxyz"] for t in texts]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in {"a.py": "def alpha(): pass\n", "sub/b.py": "def beta(): pass\n", "sub/__init__.py": "def first(): pass\n", "skip/x.py": "def x(): pass\n", ".gitignore": "skip/\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def ids(index):
    found = sorted(r.id for r in index.table("units").collect())
    assert found == sorted(r.id for r in index.table("unit_embeddings").collect())
    return found


def test_new_changed_and_gone_files_reach_the_index(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), letters, "m", buckets=4)
    run = lambda: S.follow(index, str(tree), str(tmp_path / "check"), buckets=3).awaitTermination(200)
    assert run() and ids(index) == ["a.py:alpha", "sub/__init__.py:first", "sub/b.py:beta"]
    version = index.store.version().version
    assert run() and index.store.version().version == version  # nothing is repeated
    (tree / "a.py").write_text("def other(): return 1\n")
    os.utime(tree / "a.py", ns=(1, 1))
    (tree / "sub/b.py").unlink()
    (tree / "new.py").write_text("def late(): pass\n")
    assert run() and ids(index) == ["a.py:other", "new.py:late", "sub/__init__.py:first"]
    for name in ("a.py", "new.py", "sub/__init__.py"):
        (tree / name).unlink()
    assert run() and ids(index) == []


def test_kinds_of_changes(spark, tree, tmp_path):
    seen = []
    go = lambda: (S.changes(spark, str(tree), [], 2, 1).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(sorted(tuple(r) for r in df.collect())))
                  .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200))
    go()
    assert seen[-1] == [("a.py", "python", "new"), ("skip/x.py", "python", "new"), ("sub/__init__.py", "python", "new"), ("sub/b.py", "python", "new")]
    (tree / "a.py").write_text("def alpha(): return 22\n")
    (tree / "skip/x.py").unlink()
    go()
    assert seen[-1] == [("a.py", "python", "changed"), ("skip/x.py", None, "gone")]


def test_a_failed_batch_is_repeated(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"), lambda texts: 1 / 0, "m", buckets=2)
    with pytest.raises(Exception, match="division"):
        S.follow(index, str(tree), str(tmp_path / "check"), buckets=2).awaitTermination(200)
    index = Index(spark, str(tmp_path / "index"), letters, "m", buckets=2)
    S.follow(index, str(tree), str(tmp_path / "check"), buckets=2).awaitTermination(200)
    assert len(ids(index)) == 3
