"""An index of a source tree: the tables of a store, synchronised and searched by Spark jobs.

A change writes the buckets that it touches and then names them in the store's manifest, so a reader sees all of it or nothing. Answers of
services are kept beside the tables: what a failed synchronisation was told isn't asked again.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calls import embedded_once, summarised_once
from .functions.models import Embedder, Summariser
from .functions.text import embedding_text
from .operators.libraries import dependency_of, interface_report, traversed
from .operators.maintain import deduplicated, last_wins
from .operators.search import nearest, relations_of, with_relations
from .plans.moves import moved, moves
from .plans.sync import outcome, planned
from .schema import DEPENDENCIES, KEYS, RELATIONS, UNIT_EMBEDDINGS, UNITS, ErrorCode, QuarryError
from .sources.files import Parser, listed, root_rules, scan, units
from .sources.tree import source_tree
from .store import BUCKETS, Store

TABLES = {"units": UNITS, "unit_embeddings": UNIT_EMBEDDINGS, "relations": RELATIONS, "dependencies": DEPENDENCIES}
#: Keys of the store's meta values.
_WIDTH, _MODEL = "embedding_dim", "embedding_model"


@dataclass
class SyncResult:
    """indexed_files counts all files that were looked at; errors (path, error) are those that failed."""

    indexed_files: int
    failed: int
    errors: DataFrame

    @property
    def status(self) -> str:
        return "error" if self.failed else "success"


def positive(text: str) -> int:
    """A stored width: decimal digits and at least 1, else STORAGE_CORRUPT."""
    if not (text.isascii() and text.isdigit() and int(text) >= 1):
        raise QuarryError(f"{text!r} isn't a width", ErrorCode.STORAGE_CORRUPT)
    return int(text)


class Index:
    """embed and model are needed to write and to search, summarise only for summaries; parsers are those of further languages. At most
    `callers` calls of a model are made at once; None leaves it to the number of tasks. buckets is for tables that aren't there yet."""

    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None, model: str = "", summarise: Summariser | None = None, parsers: Mapping[str, Parser] | None = None, callers: int | None = 4, buckets: int = BUCKETS):
        self.spark, self.root, self.embed, self.model, self.summarise, self.parsers = spark, root.rstrip("/"), embed, model, summarise, parsers
        self.callers = callers
        self.store = Store(spark, self.root, {n: (t, KEYS[n]) for n, t in TABLES.items()}, buckets)

    def table(self, name: str) -> DataFrame:
        """One of TABLES as it is now; empty if it was never written."""
        return self.store.table(name)

    def _bind(self, writing: bool, wipe: bool = False) -> tuple[int, bool]:
        """Width of the vectors, and whether those stored are of another model. Without a known width and model, as in an older index, the
        stored vectors give the width and count as another model's."""
        now = self.store.version()
        stored = "unit_embeddings" in now.tables and not wipe
        if not stored and not writing:
            raise QuarryError("the index has no embeddings", ErrorCode.EMBEDDINGS_MISSING)
        if self.embed is None:
            raise QuarryError("an embedder is needed")
        known = _WIDTH in now.meta and _MODEL in now.meta
        if stored:
            row = self.store.table("unit_embeddings", now).select(F.size("vec").alias("n")).first()
            kept = positive(now.meta[_WIDTH]) if known else row.n if row else None
            if row and row.n != kept:
                raise QuarryError("the stored width isn't that of the vectors", ErrorCode.STORAGE_CORRUPT)
        width = len(self.embed([""])[0])
        if stored and kept is not None and width != kept:
            raise QuarryError(f"the index has vectors {kept} wide, the embedder makes {width}", ErrorCode.EMBEDDING_MISMATCH)
        return width, stored and now.meta.get(_MODEL) != self.model

    def apply(self, files: DataFrame, force: bool = False, wipe: bool = False, whole: bool = True, prune: bool = False, gone: DataFrame | None = None) -> SyncResult:
        """Bring the index up to date with files (path, language, content). wipe makes all vectors of these files' units anew and drops
        all others; vectors of another model are all made anew, which needs whole. prune drops the units of relative paths that aren't
        among files, gone (path) those of its paths. What is forced or wiped is asked of the services anew, but for what a failed run of
        the same version was told."""
        before = self.store.version()
        width, dirty = self._bind(True, wipe)
        if dirty and not whole:
            raise QuarryError("the vectors are of another model: synchronise the whole tree", ErrorCode.EMBEDDING_MISMATCH)
        # Written once: what follows reads it several times, and model calls must not run again.
        keep = self.store.scratch
        found, scanned = keep(units(files, self.parsers)), keep(files.select("path"))
        vectors = self.store.table("unit_embeddings", before).where(F.lit(not wipe))
        anew = f"#{before.version}" if force or wipe else ""

        def summaries(rows: DataFrame) -> DataFrame:
            name = f"{getattr(self.summarise, 'model', '')}{anew}"
            return keep(summarised_once(rows, self.summarise, f"{self.root}/answers/summaries", name, text="code", callers=self.callers))

        stored = self.store.table("units", before)
        plan = planned(found, stored, vectors.select("id"), scanned, force, summaries if self.summarise else None, prune, gone)
        fresh = keep(plan.fresh.withColumn("tags", F.array().cast("array<string>")))
        dropped = keep(plan.stale)
        text = embedding_text(F.col("summary"), *map(F.col, ("kind", "name", "signature", "docstring")))
        pending = fresh.where(F.lit(dirty) | F.col("embed")).select("id", text.alias("text"))
        if dirty:
            others = stored.join(fresh, "id", "left_anti").join(dropped, "id", "left_anti")
            pending = pending.unionByName(others.select("id", text.alias("text")))
        made = keep(embedded_once(pending, self.embed, f"{self.root}/answers/vectors", self.model + anew, width, callers=self.callers))
        names = UNITS.fieldNames()
        old = stored.select("id", F.struct(*names).alias("_old"))
        changed = fresh.join(old, "id", "left").where(~F.struct(*names).eqNullSafe(F.col("_old"))).select(names)
        edges = self.store.table("relations", before)
        tables = {
            "units": self.store.changed("units", before, keep(changed), dropped),
            "unit_embeddings": self.store.replaced("unit_embeddings", made) if wipe else self.store.changed("unit_embeddings", before, made, dropped),
            "relations": self.store.changed("relations", before, drop=keep(edges.join(dropped.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(edges.columns))),
        }
        self.store.publish(before, tables, {_WIDTH: str(width), _MODEL: self.model})
        errors = found.where("error IS NOT NULL").select("path", "error")
        counts = outcome(scanned, errors).first()
        return SyncResult(counts.indexed_files, counts.failed, errors)

    def _files(self, source: str, rules: Iterable[str] | None, paths: list[str] | None = None) -> DataFrame:
        if paths is None:
            return source_tree(self.spark, source, rules)
        return scan(self.spark, source, root_rules(source) if rules is None else rules, paths=paths)

    def sync(self, source: str, rules: Iterable[str] | None = None, paths: list[str] | None = None, force: bool = False, prune: bool = False) -> SyncResult:
        """apply() to the tree below source, or to the given relative paths of it, which are then all that is looked at. rules are those of
        its ignore file unless given. prune, of a whole tree only, drops the units of files that are gone."""
        if prune and paths is not None:
            raise QuarryError("only a whole tree shows which files are gone")
        return self.apply(self._files(source, rules, paths), force, whole=paths is None, prune=prune)

    def rebuild(self, source: str, rules: Iterable[str] | None = None) -> SyncResult:
        """All summaries and vectors anew. Units of files that are gone stay, without vectors."""
        return self.apply(self._files(source, rules), force=True, wipe=True)

    def search(self, query: str, limit: int = 5) -> DataFrame:
        """The units nearest to query, with `distance` and `relations`, in order."""
        if self._bind(False)[1]:
            warnings.warn("the vectors are of another model", stacklevel=2)
        vector = self.embed([query])[0]
        norm = max(sum(x * x for x in vector) ** 0.5, 1e-12)
        hits = nearest(self.table("units"), self.table("unit_embeddings"), [x / norm for x in vector], limit)
        return with_relations(hits, self.table("relations")).orderBy("distance", "id")

    def unit(self, id: str) -> DataFrame:
        return with_relations(self.table("units").where(F.col("id") == id), relations_of(self.table("relations"), id))

    def relations(self, id: str, outbound: bool = True) -> DataFrame:
        return relations_of(self.table("relations"), id, outbound)

    def relate(self, rows: DataFrame) -> None:
        """Add relations; those that are there stay."""
        before = self.store.version()
        stored = self.store.table("relations", before)
        new = self.store.scratch(deduplicated(rows).join(stored, stored.columns, "left_anti"))
        self.store.publish(before, {"relations": self.store.changed("relations", before, new)})

    def depend(self, rows: DataFrame) -> None:
        """Add or replace dependencies (name, path); of equal names the largest path stays."""
        self.store.upsert("dependencies", last_wins(rows.select("name", "path", F.col("path").alias("seq")), KEYS["dependencies"], "seq").drop("seq"))

    def dependency(self, name: str) -> DataFrame:
        return dependency_of(self.table("dependencies"), name)

    def api(self, source: str, library: str, language: str, entries: list[str] | None = None) -> str:
        """The public interface of the library below source, in a language of operators.libraries that has a parser here. With entries
        (relative paths), only the files that these lead to are shown."""
        wanted = ("javascript", "typescript") if language == "javascript" else (language,)
        files = scan(self.spark, source).where(F.col("language").isin(*wanted))
        found = self.store.scratch(units(files, self.parsers)).where("error IS NULL")
        order = None
        if entries is not None:
            start = self.spark.createDataFrame([(p,) for p in entries], "path string")
            order = traversed(found, listed(self.spark, source), start, language)
        return interface_report(found, library, language, order).first().report

    def delete(self, path: str) -> None:
        """Units of a path go, with their vectors and with relations at either end."""
        before = self.store.version()
        gone = self.store.scratch(self.store.table("units", before).where(F.col("path") == path).select("id"))
        edges = self.store.table("relations", before)
        ends = [edges.join(gone.select(F.col("id").alias(c)), c, "left_semi").select(edges.columns) for c in ("from_id", "to_id")]
        drop = {"units": gone, "unit_embeddings": gone, "relations": self.store.scratch(ends[0].union(ends[1]).distinct())}
        self.store.publish(before, {n: self.store.changed(n, before, drop=d) for n, d in drop.items() if n in before.tables})

    def move(self, source: str, rules: Iterable[str] | None = None, spared: tuple[str, ...] = ()) -> DataFrame:
        """Give units with absolute paths the relative paths of their files below source; returns the moves (old, new) made. A path whose
        new ids are taken stays as it is. All three tables are written anew."""
        before = self.store.version()
        stored = self.store.table("units", before)
        found = self.store.scratch(units(self._files(source, rules), self.parsers)).where("error IS NULL")
        pairs = self.store.scratch(moves(stored, found, source))
        new = moved(stored, self.store.table("unit_embeddings", before), self.store.table("relations", before), pairs, spared)
        tables = {"units": new.units, "relations": new.relations}
        if "unit_embeddings" in before.tables:
            tables["unit_embeddings"] = new.embeddings
        made = self.store.scratch(new.moves)
        self.store.publish(before, {n: self.store.replaced(n, rows, before.tables[n][0] if n in before.tables else None) for n, rows in tables.items()})
        return made
