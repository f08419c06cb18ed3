"""Public interface of libraries from the units of their files: what is public, which files are imported, and the report.

units are rows of sources.files.units, made with a parser for the language; files are rows with the `path` of every file there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, metadata_field
from .maintain import reachable

# Where a relative import of JavaScript or TypeScript may lead, best first. The first three replace a suffix.
SUFFIXES, INDEXES = (".d.ts", ".ts", ".js"), ("/index.d.ts", "/index.ts", "/index.js")
# Heading, units shown of a file, and most files (None: all).
STYLES = {
    "javascript": ("JavaScript/TypeScript Library", 20, None), "rust": ("Rust Crate", 20, None),
    "go": ("Go Module", 20, None), "c_sharp": ("CSharp Project", 10, 10),
}


def folder(path: Column) -> Column:
    """Everything before the last slash; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalised(path: Column) -> Column:
    """A relative path without empty, `.` and `..` steps; steps above the top are dropped."""
    none = F.array().cast("array<string>")
    steps = F.aggregate(F.split(path, "/"), none, lambda done, x: (
        F.when(x.isin("", "."), done)
        .when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(x)))
    ))
    return F.array_join(steps, "/")


def is_public(language: str) -> Column:
    """Whether a unit belongs to a library's interface, by the rule of its language."""
    signature = F.coalesce("signature", F.lit(""))
    if language == "go":
        return F.col("name").rlike("^\\p{Lu}")
    if language == "c_sharp":
        return signature.contains("public")
    if language == "rust":
        return (F.col("kind") != "module") & signature.contains("pub")
    return F.col("kind") != "module"


def _wanted(units: DataFrame, language: str) -> DataFrame:
    """from_id (a path) and the array of paths that an import in it may mean, best first."""
    kind = metadata_field("metadata", "node_type")
    here, code = folder(F.col("path")), F.coalesce("code", F.lit(""))
    modules = units.where(F.col("kind") == "module")
    if language == "rust":
        # An identifier of any script, raw or not, that a semicolon follows instead of a body.
        ident = F.regexp_extract(code, "\\bmod\\s+(?:r#)?([\\p{L}_][\\p{L}\\p{M}\\p{N}_]*)\\s*;", 1)
        name = F.concat_ws("/", F.nullif(here, F.lit("")), ident)
        return modules.where((kind == "mod_item") & (ident != "")).select(F.col("path").alias("from_id"), F.array(F.concat(name, F.lit(".rs")), F.concat(name, F.lit("/mod.rs"))).alias("to"))
    # The string after `from`, in either kind of quotes, with space or comments before it.
    target = F.regexp_extract(code, r"(?s)\bfrom(?:\s|/\*.*?\*/)*(['\"])((?:(?!\1)[^\n])+)\1", 2)
    whole = normalised(F.concat(here, F.lit("/"), target))
    stem = F.regexp_replace(whole, "(?<=[^/])\\.[^./]+$", "")
    to = F.array(*[F.concat(stem, F.lit(s)) for s in SUFFIXES], *[F.concat(whole, F.lit(s)) for s in INDEXES])
    return modules.where(kind.contains("export") & target.startswith(".")).select(F.col("path").alias("from_id"), to.alias("to"))


def dependency_of(dependencies: DataFrame, name: str) -> DataFrame:
    """The rows of a dependency's name, which is compared whole."""
    return dependencies.where(F.col("name") == name)


def imports(units: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """from_id, to_id: the file that each re-export (javascript) or body-less module (rust) leads to: the best candidate that exists.

    Imports that lead to no file are left out; repeated ones give one row.
    """
    wanted = _wanted(units, language).distinct().select("from_id", F.col("to").alias("_to"), F.posexplode("to").alias("_rank", "path"))
    found = wanted.join(files.select("path").distinct(), "path")
    return found.groupBy("from_id", "_to").agg(F.min_by("path", "_rank").alias("to_id")).select("from_id", "to_id").distinct()


def traversed(units: DataFrame, files: DataFrame, entries: DataFrame, language: str, depth: int = 3) -> DataFrame:
    """path, depth: files within `depth` imports of the entries (path), with the fewest."""
    start = entries.join(files.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("node"))
    return reachable(imports(units, files, language), start, depth).withColumnRenamed("node", "path")


def entry_points(package: dict, paths: set[str]) -> list[str]:
    """At most three files of a JavaScript package where reading starts. package: its description; paths: what exists, relative to it.

    Declared types come first; where there are none, its modules; without any description, an index file.
    """
    if not package:
        return [p for p in ("index.d.ts", "index.js") if p in paths][:1]
    exported = package.get("exports")
    exported = exported.get(".") if isinstance(exported, dict) else None
    typed = [package.get("types"), package.get("typings"), exported.get("types") if isinstance(exported, dict) else None]
    clean = lambda named: list(dict.fromkeys(p for p in (n.removeprefix("./") for n in named if isinstance(n, str)) if p in paths))
    return (clean(typed) or clean([package.get("module"), package.get("main")]))[:3]


def interface_reports(units: DataFrame, language: str, order: DataFrame | None = None, most: int = 150) -> DataFrame:
    """library, report: for each library, in one job, its public units in at most `most` entries, a file's units in source order.

    units have the column `library` besides those of the module's head. order (library, path, depth) names the files to show, nearest first;
    without it all files are shown by path, with main.go first. A file's entries beyond its language's limit are left out, as are files and
    entries beyond theirs: features of the report, by which every task drops rows before a library's are brought together. Files with equal
    names share a heading only if they are neighbours. A library without anything to show has its heading alone.
    """
    title, per_file, n_files = STYLES[language]
    name = F.substring_index("path", "/", -1)
    if order is None:
        order = units.select("library", "path", (name != "main.go").cast("int").alias("depth")).distinct()
    if n_files is not None:
        nth = F.row_number().over(Window.partitionBy("library").orderBy("depth", "path"))
        order = order.withColumn("_file", nth).where(F.col("_file") <= n_files).drop("_file")
    if language == "c_sharp":
        order = order.where(~F.col("path").rlike("(obj|bin)/"))
    line = F.coalesce(metadata_field("metadata", "start_line").cast("int"), F.lit(0))
    public = units.where(F.coalesce(is_public(language), F.lit(False))).withColumn("_line", line)
    public = public.withColumn("_nth", F.row_number().over(Window.partitionBy("library", "path").orderBy("_line", "id"))).where(F.col("_nth") <= per_file)
    shown = public.join(order, ["library", "path"])
    shown = shown.withColumn("_entry", F.row_number().over(Window.partitionBy("library").orderBy("depth", "path", "_nth"))).where(F.col("_entry") <= most)
    doc = first_line(F.col("docstring"))
    block = F.concat(
        F.array(F.concat(F.lit("- **"), F.initcap("kind"), F.lit(": "), "name", F.lit("**"))),
        F.when(F.coalesce(F.col("docstring"), F.lit("")) != "", F.array(F.concat(F.lit("  *("), doc, F.lit(")*")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("  `"), F.coalesce("signature", F.lit("")), F.lit("`"))),
    )
    rows = shown.select("library", F.struct(F.col("_entry").alias("at"), name.alias("file"), block.alias("lines")).alias("row"))
    top = rows.groupBy("library").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    top = units.select("library").distinct().join(top, "library", "left").withColumn("rows", F.coalesce("rows", F.array().cast(top.schema["rows"].dataType)))
    before = lambda k: F.col("rows")[F.greatest(k - 1, F.lit(0))]["file"]
    lines = F.flatten(F.transform("rows", lambda x, k: F.concat(
        F.when((k > 0) & (before(k) == x["file"]), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("\n## From "), x["file"], F.lit(":")))),
        x["lines"],
    )))
    head = F.concat(F.lit(f"# Public API for {title} '"), "library", F.lit("':"))
    return top.select("library", F.array_join(F.slice(F.concat(F.array(head), lines), 1, most), "\n").alias("report"))


def interface_report(units: DataFrame, library: str, language: str, order: DataFrame | None = None, most: int = 150) -> DataFrame:
    """report: one row, what interface_reports() has for one library; order (path, depth)."""
    one = lambda df: df.withColumn("library", F.lit(library))
    out = interface_reports(one(units), language, None if order is None else one(order), most).select("report")
    none = units.sparkSession.createDataFrame([(f"# Public API for {STYLES[language][0]} '{library}':",)], "report string")
    return out.unionByName(none).limit(1)  # without units there is the heading alone
