"""A source tree as a Spark data source: `spark.read.format("source_tree").load(root)`.

The driver opens folders level by level, never more than `folders` of them, and hands out runs: folders together, ranges of the names of one
large folder, or whole subtrees where it stopped. It keeps no file names, only the bounds of ranges; a task lists its own folders again and
reads the files of its run. What a scan is narrowed to by options reaches the listing: a folder that can't hold a path that is asked for isn't
listed, nor is one that the ignore rules leave out with all below it. Options and not pushed filters, for Spark 4.1 keeps a Python source's
reader with the DataFrame, so that filters pushed for one query would also narrow the next one of the same DataFrame.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import make_importable
from .files import IGNORED, LANGUAGES, ignore_rule, root_rules

#: Files of a run, folders that the driver opens, bytes of contents that a batch holds or one file.
FILES, FOLDERS, BATCH = 2_000, 10_000, 16 << 20
SCHEMA = "path string, language string, content binary"

#: A folder (relative, with a slash at its end, empty for the root) to its folders and files, as (relative path, is a folder).
Lister = Callable[[str], Iterable[tuple[str, bool]]]


@dataclass(frozen=True)
class Part:
    """One folder of a run: its files from `first` to `last` by name, all where they are None; with all below it if deep."""

    folder: str
    first: str | None = None
    last: str | None = None
    deep: bool = False


class Run(InputPartition):
    """What one task reads."""

    def __init__(self, parts: list[Part]):
        super().__init__(parts)
        self.parts = parts


@dataclass(frozen=True)
class Wanted:
    """Which files a scan is about: languages by extension, ignore rules in order, and what a scan is narrowed to."""

    extensions: dict[str, str]
    rules: tuple[tuple[str, bool], ...]
    paths: frozenset[str] | None = None
    prefix: str = ""
    suffix: str = ""
    languages: frozenset[str] | None = None

    @classmethod
    def of(cls, rules: Iterable[str], languages: Mapping[str, str]) -> Wanted:
        found = [r for r in map(ignore_rule, [*rules, *IGNORED]) if r]
        return cls({e: name for name, all in languages.items() for e in all.split()}, tuple(found))

    def ignored(self, path: str) -> bool:
        """As files.ignored: the last rule that matches decides."""
        return next((not back for pattern, back in reversed(self.rules) if re.search(pattern, path)), False)

    def language(self, path: str) -> str | None:
        """The language of a file that is asked for, else None."""
        end = re.search(r"[^/.][^/]*\.([A-Za-z0-9]+)$", path)
        name = self.extensions.get(end[1].lower()) if end else None
        if name is None or (self.languages is not None and name not in self.languages):
            return None
        if not (path.startswith(self.prefix) and path.endswith(self.suffix)) or (self.paths is not None and path not in self.paths):
            return None
        return None if self.ignored(path) else name

    def opens(self, folder: str) -> bool:
        """Whether a folder (with a slash at its end) can hold a file that is asked for."""
        if not (folder.startswith(self.prefix) or self.prefix.startswith(folder)):
            return False
        if self.paths is not None and not any(p.startswith(folder) for p in self.paths):
            return False
        if any(back for _, back in self.rules):
            return True  # a later rule could take back what is ignored
        # A rule that matches two names of unlike lengths below a folder matches every path below it.
        return not any(re.search(pattern, folder + "\0" * 61) and re.search(pattern, folder + "\0" * 67 + "/\0") for pattern, _ in self.rules)

    def narrowed(self, prefix: str = "", suffix: str = "", only: Iterable[str] | None = None, paths: Iterable[str] | None = None) -> Wanted:
        """Asking for files whose path begins and ends so, of the given languages, at the given relative paths."""
        keep = lambda x: None if x is None else frozenset(x)
        return replace(self, prefix=prefix, suffix=suffix, languages=keep(only), paths=keep(paths))


def lister(root: str) -> Lister:
    """Lists folders below root by Arrow; links to folders aren't followed."""
    fs, base = FileSystem.from_uri(root)
    base = base.rstrip("/") + "/"

    def entries(folder: str) -> Iterator[tuple[str, bool]]:
        for x in fs.get_file_info(FileSelector((base + folder).rstrip("/") or "/")):
            if x.type == FileType.File or (x.type == FileType.Directory and not os.path.islink(x.path)):
                yield x.path[len(base) :] + ("/" if x.type == FileType.Directory else ""), x.type == FileType.Directory

    return entries


def runs(entries: Lister, wanted: Wanted, files: int = FILES, folders: int = FOLDERS) -> list[Run]:
    """Runs of about `files` wanted files each, from at most `folders` listed folders; what is still open then goes into runs of whole subtrees."""
    out: list[Run] = []
    held: list[Part] = []
    size, todo, listed = 0, deque([""] if wanted.opens("") else []), 0
    while todo and listed < folders:
        folder, names = todo.popleft(), []
        listed += 1
        for path, deep in entries(folder):
            if deep:
                if wanted.opens(path):
                    todo.append(path)
            elif wanted.language(path):
                names.append(path)
        names.sort()
        while len(names) - files > 0:
            out.append(Run([Part(folder, names[0], names[files - 1])]))
            names = names[files:]
        if names:
            held.append(Part(folder, names[0], names[-1]))
            size += len(names)
        if size >= files:
            out.append(Run(held))
            held, size = [], 0
    if held:
        out.append(Run(held))
    deep = [Part(f, deep=True) for f in todo]
    each = max(1, -(-len(deep) // max(1, folders)))
    return out + [Run(deep[i : i + each]) for i in range(0, len(deep), each)]


def members(entries: Lister, wanted: Wanted, run: Run) -> Iterator[tuple[str, str]]:
    """path and language of the files of a run."""
    for part in run.parts:
        todo = deque([part.folder])
        while todo:
            for path, deep in sorted(entries(todo.popleft())):
                if deep:
                    if part.deep and wanted.opens(path):
                        todo.append(path)
                elif (part.first is None or part.first <= path <= part.last) and (language := wanted.language(path)):
                    yield path, language


class TreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: Wanted, files: int, folders: int, contents: bool):
        self.root, self.wanted, self.files, self.folders, self.contents = root, wanted, files, folders, contents

    def partitions(self) -> list[Run]:
        return runs(lister(self.root), self.wanted, self.files, self.folders) or [Run([])]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        """A file that is gone since the listing is left out."""
        fs, base = FileSystem.from_uri(self.root)
        schema = pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.binary())])
        held: list[tuple[str, str, bytes | None]] = []
        size = 0
        for path, language in members(lister(self.root), self.wanted, run):
            content = None
            if self.contents:
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as source:
                        content = source.read()
                except FileNotFoundError:
                    continue
            held.append((path, language, content))
            size += len(content or b"") + len(path)
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class SourceTree(DataSource):
    """path (relative to the root), language, content of the files of a tree that have a known extension and that no rule ignores.

    Options: rules, the lines of an ignore file in place of the tree's own; languages, JSON of names and extensions between spaces; prefix and
    suffix of a path; only, languages between commas; among, paths, one a line; files and folders, as in runs(); contents, `false` to read none.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        root = o["path"]
        rules = o["rules"].split("\n") if "rules" in o else root_rules(root)
        languages = json.loads(o["languages"]) if "languages" in o else LANGUAGES
        only, paths = (o[k].split(sep) if k in o else None for k, sep in (("only", ","), ("among", "\n")))
        wanted = Wanted.of(rules, languages).narrowed(o.get("prefix", ""), o.get("suffix", ""), only, paths)
        return TreeReader(root, wanted, int(o.get("files", FILES)), int(o.get("folders", FOLDERS)), o.get("contents", "true") != "false")


def source_tree(
    spark: SparkSession, root: str, rules: Iterable[str] | None = None, languages: Mapping[str, str] | None = None,
    only: Iterable[str] | None = None, paths: Iterable[str] | None = None, **options: object,
) -> DataFrame:
    """The files of a tree as SCHEMA, by its own ignore rules unless others are given; only, paths and options as in SourceTree."""
    make_importable(spark)
    spark.dataSource.register(SourceTree)
    named = {"rules": rules and "\n".join(rules), "languages": languages and json.dumps(dict(languages)), "only": only and ",".join(only), "among": paths and "\n".join(paths)}
    if rules is not None and not named["rules"]:
        named["rules"] = "#"
    given = {k: str(v) for k, v in (named | options).items() if v is not None}
    return spark.read.format("source_tree").options(**given).load(root)
