"""Source trees as DataFrames: a recursive scan with ignore rules and known languages, and the units of Python files."""

from __future__ import annotations

import ast
import hashlib
import io
import json
import os
import re
import tokenize
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

# The languages of an index and their file extensions, and what is ignored besides a tree's own rules.
LANGUAGES = {
    "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "java": "java", "cpp": "cpp hpp cc hh", "c_sharp": "cs", "c": "c h", "go": "go",
    "rust": "rs", "php": "php", "ruby": "rb", "swift": "swift", "kotlin": "kt kts", "sql": "sql", "bash": "sh bash", "r": "r", "dart": "dart",
    "scala": "scala", "lua": "lua", "perl": "pl pm", "haskell": "hs", "objective_c": "m mm", "zig": "zig", "elixir": "ex exs", "julia": "jl",
}
IGNORED = ("node_modules/", "venv/", ".venv/", "__pycache__/", ".git/", ".idea/", ".vscode/", ".onnx", ".db", ".ai/")
#: Folders that a listing leaves open before it deals them to tasks, at first and then in each task.
OPEN = (256, 64)
#: Rules that are one expression; more are a table.
CHAIN = 100


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """One line of an ignore file as (regular expression over a relative path, whether it takes back), or None for a blank or comment."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line.removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i, body = "", 0, line.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*" if folder else "(?:/.*)?") + "$", back


def ignored(path: Column, lines: Iterable[str]) -> Column:
    """Whether rules ignore a relative path: the last one that matches decides."""
    out = F.lit(False)
    for rule in map(ignore_rule, lines):
        if rule:
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def _literal(line: str) -> tuple[str, bool, bool] | None:
    """A rule without wildcards as (its words, whether they are a whole path and not one name, whether they name a folder), else None."""
    body = line.removeprefix("!") if line.startswith("!") else line.removeprefix("\\")
    bare = body.rstrip("/")
    if not bare.strip("/") or any(c in bare for c in "*?["):
        return None
    return bare.lstrip("/"), "/" in bare, body.endswith("/")


def ignored_by(files: DataFrame, lines: Iterable[str]) -> DataFrame:
    """files (path and other columns) with `ignored`, as ignored() has it, for very many rules.

    Rules without wildcards are rows that meet the folders of a path, and the path itself, by equal words: a rule of one name their last
    step, others all steps. The few with wildcards are tried one by one, where one expression of all of them matches. The last rule decides.
    """
    spark = files.sparkSession
    rules = [(i, line) for i, line in enumerate(x.rstrip("\n").rstrip() for x in lines) if ignore_rule(line)]
    plain = [(i, *found, line.startswith("!")) for i, line in rules if (found := _literal(line))]
    wild = [(i, *ignore_rule(line)) for i, line in rules if not _literal(line)]
    path = F.col("path")
    known = spark.createDataFrame(plain, "rule int, words string, whole boolean, folder boolean, back boolean")
    at = files.select("path").distinct().select("path", F.posexplode(F.split(path, "/")).alias("k", "step"), F.size(F.split(path, "/")).alias("n"))
    at = at.select("path", "step", F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.col("k") + 1), "/").alias("upto"), (F.col("k") + 1 < F.col("n")).alias("inside"))
    keys = F.array(F.struct(F.lit(False).alias("whole"), F.col("step").alias("words")), F.struct(F.lit(True).alias("whole"), F.col("upto").alias("words")))
    both = at.select("path", "inside", F.explode(keys).alias("key"))
    hits = both.select("path", "inside", "key.*").join(known, ["whole", "words"]).where("inside OR NOT folder").select("path", "rule", "back")
    if wild:
        tried = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(p).alias("pattern"), F.lit(back).alias("back")) for i, p, back in wild])
        some = files.select("path").where(path.rlike("|".join(f"(?:{p})" for _, p, _ in wild))).distinct()
        one = some.select("path", F.array_max(F.filter(tried, lambda r: F.regexp_like(path, r["pattern"]))).alias("r"))
        hits = hits.unionByName(one.where("r IS NOT NULL").select("path", "r.rule", "r.back"))
    last = hits.groupBy("path").agg(F.max_by("back", "rule").alias("_back"))
    return files.join(last, "path", "left").withColumn("ignored", F.coalesce(~F.col("_back"), F.lit(False))).select(*files.columns, "ignored")


def _known(files: DataFrame, rules: Iterable[str], languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """files with a known extension that no rule ignores, with their language."""
    known = F.create_map(*[F.lit(x) for name, all in languages.items() for e in all.split() for x in (e, name)])
    files = files.withColumn("language", F.try_element_at(known, extension(F.col("path")))).where("language IS NOT NULL")
    lines = [*rules, *IGNORED]
    # A long chain of rules in one expression is slow to plan; both forms decide alike.
    return ignored_by(files, lines).where("NOT ignored").drop("ignored") if len(lines) > CHAIN else files.where(~ignored(F.col("path"), lines))


def named(files: DataFrame, root: str, rules: Iterable[str] = ()) -> DataFrame:
    """path (relative to root), language, content of rows of Spark's binary file source."""
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    path = F.regexp_replace(F.col("path"), f"^(?:[a-z]+:(?://[^/]*)?)?/*{base.lstrip('/')}/", "")
    return _known(files.select(path.alias("path"), "content"), rules).select("path", "language", "content")


def root_rules(root: str) -> list[str]:
    """The lines of the ignore file of a tree; none if there is no such file."""
    fs, base = FileSystem.from_uri(root)
    if fs.get_file_info(f"{base}/.gitignore").type != FileType.File:
        return []
    with fs.open_input_stream(f"{base}/.gitignore") as f:
        return f.read().decode("utf-8", "replace").splitlines()


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) of every file below root. root is an absolute path or an address that Arrow opens.

    Spark's own file sources leave out names that begin with _ or a dot, so they would miss modules such as __init__.py. Folders are dealt
    to tasks twice while they are listed, so that neither the first task nor that of a large folder lists everything below.
    """

    def below(most: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Lists the open folders and those in them, until `most` are open, which are handed on."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = FileSystem.from_uri(root)
            base = base.rstrip("/") + "/"
            for f in frames:
                yield f[~f["open"]]
                todo = deque(f.loc[f["open"], "path"])
                while todo and (most is None or len(todo) < most):
                    found = fs.get_file_info(FileSelector((base + todo.popleft()).rstrip("/") or "/"))
                    todo += [x.path[len(base) :] for x in found if x.type == FileType.Directory and not os.path.islink(x.path)]
                    files = [x.path[len(base) :] for x in found if x.type == FileType.File]
                    yield pd.DataFrame({"path": pd.Series(files, dtype=object), "open": np.zeros(len(files), bool)})
                yield pd.DataFrame({"path": pd.Series(list(todo), dtype=object), "open": np.ones(len(todo), bool)})

        return run

    rows = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(True).alias("open"))
    for most in OPEN:
        rows = rows.mapInPandas(below(most), "path string, open boolean").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInPandas(below(None), "path string, open boolean").select("path")


def scan(spark: SparkSession, root: str, rules: Iterable[str] = (), languages: Mapping[str, str] = LANGUAGES, paths: list[str] | None = None) -> DataFrame:
    """path (relative to root), language, content of every file below root that has a known extension and isn't ignored, or only of those
    of the given relative paths that are such files.

    Only these are read, in as many tasks as a shuffle has partitions. languages: names, and the extensions of each between spaces.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(root)
        for f in frames:
            for path, language in zip(f["path"], f["language"], strict=True):
                if paths is not None and fs.get_file_info(f"{base.rstrip('/')}/{path}").type != FileType.File:
                    continue
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as source:
                    yield pd.DataFrame({"path": [path], "language": [language], "content": [source.read()]})

    if paths is None:
        found = listed(spark, root)
    else:
        found = spark.createDataFrame([(p,) for p in dict.fromkeys(paths) if not p.startswith("/") and ".." not in p.split("/")], "path string")
    files = _known(found, rules, languages).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInPandas(read, "path string, language string, content binary")


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def python_units(path: str, source: bytes) -> Iterator[dict]:
    """Units of one Python file, outer ones first. A method is a function. A unit's docstring is the comments right before it.

    Raises SyntaxError for a file that doesn't parse.
    """
    tree = ast.parse(source)
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    at = lambda line, col: starts[line - 1] + col
    comments = [(t.start[0], t.string) for t in tokenize.tokenize(io.BytesIO(source).readline) if t.type == tokenize.COMMENT]

    def walk(node: ast.AST, scope: str, counts: dict[str, int], before: int | None) -> Iterator[dict]:
        """before: the line on which the sibling before node ends; None where node has no comments of its own level before it."""
        if isinstance(node, _DEF):
            counts[node.name] = counts.get(node.name, 0) + 1
            label = node.name if counts[node.name] == 1 else f"{node.name}#{counts[node.name]}"
            scope, counts = f"{scope}.{label}" if scope else label, {}
            start, end = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            first = node.body[0]
            deco = getattr(first, "decorator_list", [])
            body = at(deco[0].lineno, deco[0].col_offset - 1) if deco else at(first.lineno, first.col_offset)
            text = source[start:end].decode("utf-8", "replace")
            own = [] if before is None or node.decorator_list else [c.lstrip("#").strip() for line, c in comments if before <= line < node.lineno]
            yield {
                "id": f"{path}:{scope}", "kind": "class" if isinstance(node, ast.ClassDef) else "function", "name": node.name, "path": path,
                "signature": source[start:body].decode("utf-8", "replace") + " ...", "docstring": "\n".join(filter(None, own)) or None,
                "code": text, "code_hash": hashlib.sha256(text.encode()).hexdigest(),
                "metadata": json.dumps({"start_line": node.lineno, "end_line": node.end_lineno, "node_type": "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"}),
            }
        for name, value in ast.iter_fields(node):
            last = 1 if isinstance(node, ast.Module) else None
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    yield from walk(child, scope, counts, last if name in ("body", "orelse", "finalbody") else None)
                    last = getattr(child, "end_lineno", None)

    yield from walk(tree, "", {}, None)


_UNITS = "id string, kind string, name string, path string, signature string, docstring string, code string, code_hash string, metadata string, error string"


#: A file's path and bytes to its units as dicts of _UNITS; SyntaxError or ValueError for a file that doesn't parse.
Parser = Callable[[str, bytes], Iterable[dict]]


def units(files: DataFrame, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """Units of files (path, language, content), with `error` instead for a file of a language without a parser.

    parsers are those of further languages. A file that doesn't parse has no units and no error, so that what an index has of it
    becomes stale.
    """
    names, known = [c.split()[0] for c in _UNITS.split(", ")], {"python": python_units} | dict(parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                if language not in known:
                    rows.append({"path": path, "error": f"no parser for {language}"})
                    continue
                try:
                    rows += known[language](path, bytes(content))
                except (SyntaxError, ValueError, tokenize.TokenError):
                    continue
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "language", "content").mapInPandas(run, _UNITS)
