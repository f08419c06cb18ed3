import json

import pytest

from codequarry.__main__ import first_files, main
from codequarry.session import make_importable


def write(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def run(spark, tmp_path, capsys):
    make_importable(spark)

    def go(*words):
        done = main(["--root", str(tmp_path), "--config", str(tmp_path / "c.json"), "--json", "--parsers", "tests.toy_parsers", *words], spark)
        return done, capsys.readouterr().out

    return go


def test_reports_of_other_languages(run, tmp_path):
    write(tmp_path / "crate", **{"src/lib.rs": "pub fn root() {}\nmod inner;\nfn hidden() {}\n", "src/inner.rs": "pub fn deep() {}\n", "src/other.rs": "pub fn unreached() {}\n"})
    done, said = run("api", str(tmp_path / "crate"), "--lang", "rust")
    assert done == 0 and "Rust Crate 'crate'" in said and "root" in said and "deep" in said and "unreached" not in said and "hidden" not in said
    write(tmp_path / "pkg", **{"package.json": json.dumps({"main": "./lib/a.js", "exports": {".": {"types": "none.d.ts"}}}), "lib/a.js": "fn one\nexport * from './b'\n", "lib/b.js": "fn two\n", "index.js": "fn never\n"})
    done, said = run("api", str(tmp_path / "pkg"), "--lang", "javascript")
    assert done == 0 and "one" in said and "two" in said and "never" not in said
    assert run("api", str(tmp_path / "crate"), "--lang", "go")[0] == 1


def test_first_files(tmp_path):
    write(tmp_path, **{"index.js": "", "t/x.d.ts": "", "m.js": ""})
    at = lambda package: (tmp_path / "package.json").write_text(json.dumps(package)) and first_files(str(tmp_path), "javascript")
    assert first_files(str(tmp_path), "javascript") == ["index.js"] and first_files(str(tmp_path), "go") is None and first_files(str(tmp_path), "rust") is None
    assert at({"types": "./t/x.d.ts", "main": "m.js"}) == ["t/x.d.ts"] and at({"main": "m.js"}) == ["m.js"] and at({"main": "../../etc/passwd"}) is None
    assert at({"exports": {".": {"types": "./t/x.d.ts"}}, "module": "m.js"}) == ["t/x.d.ts"]


def test_settings(run, tmp_path):
    assert json.loads(run("config", "--provider", "p", "--embedding-provider", "q", "--relative-paths", "true")[1]) == {"provider": "p", "embedding_provider": "q", "relative_paths": True}
    assert json.loads(run("config", "--relative-paths", "false")[1])["relative_paths"] is False
    assert "embedding_provider" not in json.loads(run("config", "--clear-embedding")[1])
