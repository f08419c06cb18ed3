"""Command line of an index: sync, rebuild, search, api, config.

--parsers names an importable module whose PARSERS maps further languages to their parsers (sources.files.Parser); Python has its own.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.models import HttpEmbedder, HttpSummariser
from .functions.text import output_path
from .index import Index, SyncResult
from .operators.libraries import STYLES, entry_points
from .operators.report import library_api
from .schema import QuarryError
from .sources.archives import classes
from .sources.files import scan, units

#: Options of `config`, and the setting that each writes.
SETTINGS = {
    "url": "api_base", "key": "api_key", "model": "model", "provider": "provider", "timeout": "timeout", "max-concurrency": "max_concurrency",
    "embedding-url": "embedding_base", "embedding-key": "embedding_key", "embedding-model": "embedding_model", "embedding-provider": "embedding_provider",
    "relative-paths": "relative_paths",
}


def updated(config: dict, changes: dict, clear: bool = False) -> dict:
    """config with the changes that aren't None; blank values unset a setting. clear unsets those of embeddings first."""
    out = {k: v for k, v in config.items() if not (clear and k.startswith("embedding_"))} | {k: v for k, v in changes.items() if v is not None}
    out = {k: v.strip() if isinstance(v, str) else v for k, v in out.items()}
    out = {k: v for k, v in out.items() if v not in ("", None)}
    for name in ("timeout", "max_concurrency"):
        if out.get(name, 1) <= 0:
            raise QuarryError(f"{name} must be positive")
    if ("embedding_base" in out) != ("embedding_model" in out):
        raise QuarryError("an embedding service needs an address and a model")
    return out


def _options(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="codequarry")
    p.add_argument("--root", default=os.getcwd(), help="the source tree")
    p.add_argument("--index", help="folder of the index; .quarry below root if not given")
    p.add_argument("--config", default=os.path.expanduser("~/.codequarry.json"))
    p.add_argument("--json", action="store_true")
    p.add_argument("--parsers", help="a module with parsers of further languages")
    sub = p.add_subparsers(dest="command", required=True)
    sync = sub.add_parser("sync")
    sync.add_argument("path", nargs="?")
    sync.add_argument("--all", action="store_true")
    sync.add_argument("--force", action="store_true")
    sync.add_argument("--prune-missing", action="store_true", help="with --all: drop the units of files that are gone")
    sub.add_parser("rebuild")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--relative-paths", action="store_true", help="paths as the index has them")
    api = sub.add_parser("api")
    api.add_argument("library", help="a folder of sources, or with --lang java the name of a dependency")
    api.add_argument("--lang", choices=["python", "java", *STYLES], default="python")
    config = sub.add_parser("config")
    for option in SETTINGS:
        kind = int if option in ("timeout", "max-concurrency") else (lambda x: x == "true") if option == "relative-paths" else str
        config.add_argument(f"--{option}", type=kind, choices=[True, False] if option == "relative-paths" else None)
    config.add_argument("--clear-embedding", action="store_true")
    return p.parse_args(argv)


def _told(result: SyncResult, as_json: bool) -> int:
    errors = [{"file": r.path, "message": r.error} for r in result.errors.orderBy("path").toLocalIterator()]
    if not result.failed:
        print(json.dumps({"status": "success", "indexed_files": "auto"}) if as_json else f"{result.indexed_files} files")
    elif as_json:
        print(json.dumps({"status": "error", "message": f"{result.failed} of {result.indexed_files} files could not be read", "errors": errors}))
    else:
        print(*[f"{e['file']}: {e['message']}" for e in errors], sep="\n", file=sys.stderr)
    return int(result.failed > 0)


def first_files(source: str, language: str) -> list[str] | None:
    """Where reading of a library starts: a script package's entry points, a crate's root; None where all files are shown."""
    fs, base = FileSystem.from_uri(source)
    there = lambda path: fs.get_file_info(f"{base.rstrip('/')}/{path}").type == FileType.File
    if language == "rust":
        return [p for p in ("src/lib.rs", "lib.rs", "src/main.rs") if there(p)][:1] or None
    if language != "javascript":
        return None
    package = {}
    if there("package.json"):
        with fs.open_input_stream(f"{base.rstrip('/')}/package.json") as f:
            package = json.loads(f.read())
    named = [*package.values(), *[v for v in package.values() if isinstance(v, dict)], "index.d.ts", "index.js"]
    nested = [x for v in named if isinstance(v, dict) for y in v.values() for x in (y.values() if isinstance(y, dict) else [y])]
    wanted = {x.removeprefix("./") for x in [*named, *nested] if isinstance(x, str)}
    return entry_points(package, {p for p in wanted if p and not p.startswith("/") and ".." not in p.split("/") and there(p)}) or None


def _api(spark: SparkSession, index: Index, library: str, lang: str) -> str:
    name = os.path.basename(library.rstrip("/"))
    if lang == "python":
        return library_api(units(scan(spark, os.path.abspath(library), languages={"python": "py pyi"})), name).first().report
    if lang != "java":
        if lang not in (index.parsers or {}):
            raise QuarryError(f"no parser for {lang}: name a module with --parsers")
        source = os.path.abspath(library)
        return index.api(source, name, lang, first_files(source, lang))
    found = index.dependency(library).first()
    if found is None:
        return f"No archive of '{library}' is known"
    files = spark.read.format("binaryFile").load(found.path).select(F.lit(library).alias("library"), "path", "content")
    names = classes(files).orderBy("nth").limit(20).collect()
    return "\n".join([f"# Public API for Java Library '{library}':", *[f"- **Class: {r.class_name}**" for r in names if r.class_name]])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = _options(argv)
    try:
        config = json.load(open(o.config)) if os.path.exists(o.config) else {}
        if o.command == "config":
            config = updated(config, {v: getattr(o, k.replace("-", "_")) for k, v in SETTINGS.items()}, o.clear_embedding)
            with open(os.open(o.config, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
                json.dump(config, f, indent=4)
            print(json.dumps({k: "***" if k.endswith("key") else v for k, v in config.items()}))
            return 0
        if o.command == "sync" and not o.path and not o.all:
            print(json.dumps({"status": "success", "indexed_files": "auto"}) if o.json else "0 files")
            return 0
        spark = spark or SparkSession.builder.appName("codequarry").getOrCreate()
        embed = HttpEmbedder(config["embedding_base"], config["embedding_model"], config.get("embedding_key")) if "embedding_base" in config else None
        asked = {"api_base", "model", "provider"} <= set(config)
        summarise = HttpSummariser(config["api_base"], config["model"], config.get("api_key"), timeout=config.get("timeout", 300)) if asked else None
        parsers = importlib.import_module(o.parsers).PARSERS if o.parsers else None
        index = Index(spark, o.index or f"{o.root}/.quarry", embed, config.get("embedding_model", ""), summarise, parsers, callers=config.get("max_concurrency", 4))
        if o.command == "sync":
            return _told(index.sync(o.root, paths=None if o.all else [os.path.relpath(os.path.abspath(o.path), o.root)], force=o.force, prune=o.prune_missing), o.json)
        if o.command == "rebuild":
            return _told(index.rebuild(o.root), o.json)
        if o.command == "api":
            print(_api(spark, index, o.library, o.lang))
            return 0
        found = index.search(o.query, o.limit)
        if not (o.relative_paths or config.get("relative_paths")):
            found = found.withColumn("path", output_path(F.col("path"), os.path.abspath(o.root)))
        hits = [r.asDict() for r in found.select("id", "name", "kind", "path", "signature", "summary").collect()]
        print(json.dumps(hits, indent=2) if o.json else "\n".join(f"[{h['kind']}] {h['name']} ({h['path']})\n  {h['summary'] or ''}" for h in hits) or "nothing found")
        return 0
    except QuarryError as e:
        print(json.dumps({"status": "error", "message": str(e)} | ({"code": e.code} if e.code else {})) if o.json else f"Error: {e}", file=sys.stdout if o.json else sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
