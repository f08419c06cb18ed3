"""Registered queries of the index operators over the given tables, each with DuckDB SQL for the same rows.

documents stand for units (doc_id the id, source the file, lang the language), embeddings for their vectors, labels for what an index has
stored, lineitem for relations, pages for files, conversations for members of a scope.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.calls import embedded_once
from .functions.models import pooled
from .functions.vectors import l2_normalised
from .operators import libraries as L
from .operators import maintain as M
from .operators import report as R
from .operators.search import nearest, nearest_each, relations_of, with_relations
from .plans.moves import clashing, moved, moves
from .plans.sync import outcome
from .session import shared_dir
from .sources.files import ignored_by
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("type"))


_UNITS = "SELECT doc_id AS id, source AS path, lang, text, sha256(text) AS code_hash FROM documents"
_EDGES = "SELECT l_orderkey AS from_id, l_partkey AS to_id, l_returnflag AS type FROM lineitem"
#: What the index has stored of a unit: its hash (another one where quality is 0), and a summary where it isn't toxic.
_STORED = "SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN sha256(text) ELSE 'old' END AS old_hash, CASE WHEN toxic = 0 THEN CASE WHEN n_chars > 500 THEN text ELSE text || '.' END END AS old_summary FROM labels l JOIN documents d USING (doc_id)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "lang", "text", T.content_hash(F.col("text")).alias("code_hash"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), _t(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, T.content_hash(F.col("text"))).otherwise("old").alias("old_hash"),
        F.when(F.col("toxic") == 0, F.when(F.col("n_chars") > 500, F.col("text")).otherwise(F.concat("text", F.lit(".")))).alias("old_summary"),
    )


_NEAREST = """
SELECT d.doc_id AS id, d.source, sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dist, id LIMIT {k}"""


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    wanted = vectors.where("id = 0").first()  # the query vector
    units = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return nearest(units, vectors, wanted.vec, k)


@query(f"SELECT id, source, round(dist, 6) AS distance FROM ({_NEAREST.format(k=5)})")
def vector_search_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, 5).select("id", "source", F.round("distance", 6).alias("distance"))


@query(f"""WITH h AS ({_NEAREST.format(k=20)}), e AS (SELECT DISTINCT * FROM ({_EDGES}))
SELECT h.id, round(dist, 6) AS distance, coalesce((SELECT string_agg(to_id || ':' || type, ',' ORDER BY to_id, type) FROM e WHERE from_id = h.id), '') AS relations FROM h""")
def topk_with_relations(spark, sf_dir):
    hits = with_relations(_nearest(spark, sf_dir, 20), _edges(spark, sf_dir))
    line = F.transform("relations", lambda e: F.concat(e["to_id"].cast("string"), F.lit(":"), e["type"]))
    return hits.select("id", F.round("distance", 6).alias("distance"), F.array_join(line, ",").alias("relations"))


_NEAREST_EACH = """
SELECT q.vec_id AS query_id, d.doc_id AS id, d.source, sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY dist, id) <= {k}"""


def _nearest_each(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    units = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return nearest_each(units, vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec"), k)


@query(f"SELECT query_id, id, source, round(dist, 6) AS distance FROM ({_NEAREST_EACH.format(k=5)})")
def vector_search_each(spark, sf_dir):
    return _nearest_each(spark, sf_dir, 5).select("query_id", "id", "source", F.round("distance", 6).alias("distance"))


@query(f"""WITH h AS ({_NEAREST_EACH.format(k=20)}), e AS (SELECT from_id, string_agg(to_id || ':' || type, ',' ORDER BY to_id, type) AS line FROM (SELECT DISTINCT * FROM ({_EDGES})) GROUP BY from_id)
SELECT query_id, id, round(dist, 6) AS distance, coalesce(line, '') AS relations FROM h LEFT JOIN e ON from_id = id""")
def each_with_relations(spark, sf_dir):
    hits = with_relations(_nearest_each(spark, sf_dir, 20), _edges(spark, sf_dir), bounded=False)
    line = F.transform("relations", lambda e: F.concat(e["to_id"].cast("string"), F.lit(":"), e["type"]))
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), F.array_join(line, ",").alias("relations"))


@query(f"""SELECT u.id, path, lang, code_hash, coalesce((SELECT string_agg(DISTINCT to_id || ':' || type, ',' ORDER BY to_id || ':' || type) FROM ({_EDGES}) WHERE from_id = u.id), '') AS relations
FROM ({_UNITS}) u WHERE u.id = 7""")
def get_unit(spark, sf_dir):
    unit = with_relations(_units(spark, sf_dir).where("id = 7").drop("text"), relations_of(_edges(spark, sf_dir), 7))
    line = F.array_sort(F.transform("relations", lambda e: F.concat(e["to_id"].cast("string"), F.lit(":"), e["type"])))
    return unit.withColumn("relations", F.array_join(line, ","))


@query("SELECT p_name AS name, p_brand || '/' || p_partkey AS path FROM part WHERE p_name = 'red widget'")
def dependency_lookup(spark, sf_dir):
    known = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return L.dependency_of(known, "red widget")


@query("SELECT doc_id AS id, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS has_embedding FROM documents")
def has_embedding(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return M.having_vectors(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), v).withColumnRenamed("has", "has_embedding")


@query(f"SELECT * FROM ({_EDGES}) WHERE from_id = 7")
def edges_out(spark, sf_dir):
    return relations_of(_edges(spark, sf_dir), 7)


@query(f"SELECT * FROM ({_EDGES}) WHERE to_id = 155")
def edges_in(spark, sf_dir):
    return relations_of(_edges(spark, sf_dir), 155, outbound=False)


@query(f"SELECT DISTINCT * FROM ({_EDGES})")
def edge_dedup(spark, sf_dir):
    return M.deduplicated(_edges(spark, sf_dir))


@query("SELECT doc_id AS id, source AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_units(spark, sf_dir):
    kept = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return M.stale(_units(spark, sf_dir).select("id", "path"), kept)


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def stale_embeddings(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    kept = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return M.stale(v, kept).join(_units(spark, sf_dir).select("id"), "id", "left_semi")


@query(f"WITH gone AS (SELECT p_partkey AS id FROM part WHERE p_size <= 10) SELECT * FROM ({_EDGES}) WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def orphan_edges(spark, sf_dir):
    return M.without_ends(_edges(spark, sf_dir), _t(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id")))


@query("""SELECT c_custkey AS id, c_name AS summary FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def upsert_last_wins(spark, sf_dir):
    stored = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("summary"))
    new = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("summary"), "event_id")
    return M.upserted(stored, new, ["id"], "event_id")


@query("""SELECT c_custkey AS id, c_name AS summary FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def bucket_upsert(spark, sf_dir):
    """As upsert_last_wins, into a stored table of which the buckets of the new keys alone are written."""
    stored = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("summary"))
    new = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("summary"), "event_id")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {"unit": (stored.schema, ["id"])})
    store.publish(store.version(), {"unit": store.replaced("unit", stored)})
    store.upsert("unit", M.last_wins(new, ["id"], "event_id").drop("event_id"))
    return store.table("unit")


def _vowels(texts):
    """A vector for each text without a model: how often it has the letters a, e and i."""
    return [[float(t.count(c)) for c in "aei"] for t in texts]


@query("""SELECT id, round((a / greatest(sqrt(a * a + e * e + i * i), 1e-12))::FLOAT::DOUBLE, 4) AS x, round((e / greatest(sqrt(a * a + e * e + i * i), 1e-12))::FLOAT::DOUBLE, 4) AS y
FROM (SELECT doc_id AS id, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e, (length(text) - length(replace(text, 'i', '')))::DOUBLE AS i FROM documents)""")
def embed_once(spark, sf_dir):
    units = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    got = embedded_once(units, _vowels, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}", "vowels", 3, batch=256)
    at = lambda k: F.round(F.get("vec", F.lit(k)).cast("double"), 4)
    return got.select("id", at(0).alias("x"), at(1).alias("y"))


_PLACED = "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '/x' || (c_custkey % 10) || '/' END || 'f' || (c_custkey % 7) || '.py'"


@query(f"""WITH u AS (SELECT DISTINCT {_PLACED} AS old, 'f' || (c_custkey % 7) || '.py' AS new, c_mktsegment AS name FROM customer)
SELECT DISTINCT old, new FROM (SELECT *, row_number() OVER (PARTITION BY new, name ORDER BY old <> new, old) AS nth FROM u) WHERE nth > 1""")
def move_clashes(spark, sf_dir):
    """Customers are units of nine absolute folders and of the top folder, to which all files of the nine would move."""
    units = _t(spark, sf_dir, "customer").select(F.expr(_PLACED).alias("path"), "c_mktsegment").distinct()
    units = units.select(F.concat("path", F.lit(":"), "c_mktsegment").alias("id"), "path")
    absolute = units.where("startswith(path, '/')").select(F.col("path").alias("old"), F.substring_index("path", "/", -1).alias("new")).distinct()
    return clashing(units, absolute)


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'src:/' || substr(url, 8) ELSE url END AS path FROM pages")
def path_rewrite(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.prefix_rewritten(F.col("url"), "http://", "src:/").alias("path"))


@query("""SELECT CASE WHEN starts_with(f, 'o1') THEN 'new/' || substr(f, 3) ELSE f END AS from_id, CASE WHEN starts_with(t, 'o1') THEN 'new/' || substr(t, 3) ELSE t END AS to_id, type
FROM (SELECT 'o' || l_orderkey AS f, 'o' || l_partkey AS t, l_returnflag AS type FROM lineitem)""")
def edge_rewrite(spark, sf_dir):
    named = _edges(spark, sf_dir).withColumns({c: F.concat(F.lit("o"), F.col(c).cast("string")) for c in ("from_id", "to_id")})
    return M.relations_rewritten(named, "o1", "new/")


@query(f"SELECT u.id, old_hash IS NULL OR code_hash <> old_hash OR coalesce(old_summary, '') = '' AS distill FROM ({_UNITS}) u LEFT JOIN ({_STORED}) s USING (id)")
def delta_detect(spark, sf_dir):
    both = _units(spark, sf_dir).drop("text").join(_stored(spark, sf_dir), "id", "left")
    return both.select("id", M.must_distill(F.col("code_hash"), F.col("old_hash"), F.col("old_summary")).alias("distill"))


@query(f"""SELECT u.id, old_hash IS NULL OR NOT (code_hash IS NOT DISTINCT FROM old_hash AND (CASE WHEN source <> 'src0' THEN text END) IS NOT DISTINCT FROM old_summary
AND id IN (SELECT vec_id FROM embeddings)) AS embed FROM ({_UNITS.replace("source AS path", "source")}) u LEFT JOIN ({_STORED}) s USING (id)""")
def needs_embedding(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("has"))
    units = _units(spark, sf_dir).withColumn("summary", F.when(F.col("path") != "src0", F.col("text"))).drop("text")
    both = units.join(_stored(spark, sf_dir), "id", "left").join(v, "id", "left")
    return both.select("id", M.must_embed(F.col("code_hash"), F.col("summary"), F.col("old_hash"), F.col("old_summary"), F.coalesce("has", F.lit(False))).alias("embed"))


@query(f"SELECT path, code_hash, count(*) AS n FROM ({_UNITS}) GROUP BY ALL")
def hash_multiset(spark, sf_dir):
    return M.hash_multisets(_units(spark, sf_dir))


@query("""WITH o AS (SELECT g, list_sort(list(role || '=' || n)) AS m FROM (SELECT conv_id AS g, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY g),
ro AS (SELECT g, m, row_number() OVER (PARTITION BY m ORDER BY g) AS k FROM o), rn AS (SELECT 'moved/' || g AS g, m, row_number() OVER (PARTITION BY m ORDER BY 'moved/' || g) AS k FROM o)
SELECT ro.g AS old_group, rn.g AS new_group FROM ro JOIN rn ON ro.m = rn.m AND ro.k = rn.k""")
def multiset_match(spark, sf_dir):
    old = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("role").alias("code_hash"))
    return M.matched_groups(old, old.withColumn("path", F.concat(F.lit("moved/"), F.col("path").cast("string"))))


def _old_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as an index has them whose paths are absolute."""
    path = F.concat(F.lit("/old/"), F.col("source"))
    return _t(spark, sf_dir, "documents").select(F.concat(path, F.lit(":"), F.col("doc_id").cast("string")).alias("id"), path.alias("path"), T.content_hash(F.col("text")).alias("code_hash"))


@query("SELECT source || ':' || doc_id AS id, source AS path, sha256(text) AS code_hash FROM documents")
def path_moves(spark, sf_dir):
    old, found = _old_units(spark, sf_dir), _units(spark, sf_dir).select("path", "code_hash")
    edges = old.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("calls").alias("type"))
    return moved(old, old.select("id"), edges, moves(old, found, "/old")).units


@query("SELECT source || ':' || doc_id AS from_id, source || ':' || doc_id AS to_id, 'calls' AS type FROM documents")
def edge_moves(spark, sf_dir):
    old, found = _old_units(spark, sf_dir), _units(spark, sf_dir).select("path", "code_hash")
    edges = old.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("calls").alias("type"))
    return moved(old, old.select("id"), edges, moves(old, found, "/elsewhere")).relations


@query("SELECT doc_id AS id, sha256(text) AS code_hash FROM documents")
def content_hash(spark, sf_dir):
    return _units(spark, sf_dir).select("id", "code_hash")


@query("""SELECT conv_id, turn, conv_id || '.' || role || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS qualified_name
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)""")
def qualified_name(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.qualified_names(rows, "conv_id", "role", ["turn"]).select("conv_id", "turn", "qualified_name")


@query("""SELECT d.doc_id AS id, CASE WHEN coalesce(s, '') <> '' THEN s ELSE lang || ' ' || source || ' ' || coalesce(q, '') END AS embedding_text
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS s, quality::VARCHAR AS q FROM labels) l USING (doc_id)""")
def embedding_text(spark, sf_dir):
    s = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("s"), F.col("quality").cast("string").alias("q"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(s, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), T.embedding_text(F.col("s"), F.col("lang"), F.col("source"), F.col("q")).alias("embedding_text"))


@query("SELECT page_id, CASE WHEN p LIKE '/%' THEN p ELSE '/project/' || p END AS path FROM (SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) AS u, CASE WHEN page_id % 2 = 0 THEN '/' || u ELSE u END AS p FROM pages)")
def format_path(spark, sf_dir):
    u = F.regexp_extract("url", "://[^/]*/(.*)$", 1)
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), u)).otherwise(u)
    return _t(spark, sf_dir, "pages").select("page_id", T.output_path(p, "/project").alias("path"))


@query(r"SELECT doc_id AS id, nullif(regexp_replace(text, '^[\s\v\x1C-\x1F\x{85}\p{Z}]+|[\s\v\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'), '') AS kept FROM documents")
def blank_to_null(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.blank_to_null(F.col("text")).alias("kept"))


@query("SELECT doc_id AS id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def config_coalesce(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(-1)).alias("quality"))


_STRIP = r"regexp_replace({}, '^[\s\v\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\v\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


@query(rf"""SELECT doc_id AS id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '^/\*', ''), '\*/$', ''), '\r\n|[\n\v\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'),
lambda x: {_STRIP.format(f"regexp_replace({_STRIP.format('x')}, '^(///|//|/[*][*]|[*]|#)', '')")}), lambda x: x <> ''), chr(10)), '') AS docstring FROM documents""")
def comment_clean(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.cleaned_comment(F.col("text")).alias("docstring"))


@query(r"SELECT doc_id AS id, regexp_extract(text, '^[^\n\v\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]*') AS first_line FROM documents")
def first_line(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.first_line(F.col("text")).alias("first_line"))


@query("SELECT page_id, CASE WHEN a = 0 THEN html ELSE rtrim(substr(html, 1, a - 1)) || ' { ... }' || substr(html, b + 7) END AS signature FROM (SELECT page_id, html, strpos(html, '<body>') AS a, strpos(html, '</body>') AS b FROM pages)")
def signature_stub(spark, sf_dir):
    a, b = F.nullif(F.instr("html", "<body>"), F.lit(0)), F.instr("html", "</body>")
    return _t(spark, sf_dir, "pages").select("page_id", T.signature_stub(F.col("html"), a - 1, b + 6, " { ... }").alias("signature"))


@query("SELECT p_partkey, regexp_replace(p_type || '-' || p_brand || '-' || p_size, '-[0-9][^-]*$', '') AS library FROM part")
def lib_name(spark, sf_dir):
    stem = F.concat_ws("-", "p_type", "p_brand", F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", T.library_name(stem).alias("library"))


@query("""SELECT p_name AS library, array_to_string(max(list_transform(regexp_extract_all(p_brand || '.' || p_size || '.' || p_partkey, '[0-9]+'), lambda x: x::BIGINT)), '.') AS version FROM part GROUP BY p_name""")
def version_max(spark, sf_dir):
    key = T.version_key(F.concat_ws(".", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    rows = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("library")).agg(F.max(key).alias("v"))
    return rows.select("library", F.array_join(F.col("v.digits"), ".").alias("version"))


@query("SELECT page_id, regexp_replace(replace(e, '/', '.'), '\\.class$', '') AS class_name FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) || '.class' AS e, url FROM pages) WHERE e NOT LIKE '%www%'")
def class_name_decode(spark, sf_dir):
    entry = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.lit(".class"))
    return _t(spark, sf_dir, "pages").where(~entry.contains("www")).select("page_id", T.class_name(entry).alias("class_name"))


@query("SELECT page_id, lower(regexp_extract(url, '[^/.][^/]*\\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages WHERE lower(regexp_extract(url, '[^/.][^/]*\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'com')")
def ext_filter(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("extension")).where(F.col("extension").isin("html", "com"))


@query("SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'class' WHEN 'de' THEN 'method' WHEN 'fr' THEN 'module' ELSE 'function' END AS kind FROM documents")
def kind_map(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.mapped(F.col("lang"), {"en": "class", "de": "method", "fr": "module"}, "function").alias("kind"))


@query("SELECT doc_id AS id, source FROM documents WHERE regexp_matches(text, '^\\p{Lu}')")
def visibility(spark, sf_dir):
    units = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("signature"))
    return units.where(L.is_public("go")).select("id", "source")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'MACHINERY', c_name) AS place FROM customer")
def init_first_sort(spark, sf_dir):
    out = R.top_per_file(_t(spark, sf_dir, "customer"), "c_nationkey", [F.col("c_mktsegment") != "MACHINERY", F.col("c_name")], 1 << 30)
    return out.select("c_custkey", F.col("rank").cast("long").alias("place"))


@query("SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20")
def topn_per_file(spark, sf_dir):
    out = R.top_per_file(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 20)
    return out.select(F.col("doc_id").alias("id"), "source", F.col("rank").cast("long").alias("rank"))


@query(r"""SELECT source, count(*) AS n_lines, '# ' || source || chr(10) || string_agg('- ' || line, chr(10) ORDER BY line) AS report
FROM (SELECT source, line FROM (SELECT source, regexp_extract(text, '^[^\n\v\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]*') AS line FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY line) <= 150) GROUP BY source""")
def report_markdown(spark, sf_dir):
    return R.markdown(_t(spark, sf_dir, "documents").select("source", T.first_line(F.col("text")).alias("line")), "source", "line", 150)


@query(f"""WITH RECURSIVE r(node, depth) AS (SELECT 7, 0 UNION SELECT e.to_id, r.depth + 1 FROM r JOIN (SELECT DISTINCT from_id, to_id FROM ({_EDGES})) e ON e.from_id = r.node WHERE r.depth < 3)
SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM r GROUP BY node""")
def reach_depth3(spark, sf_dir):
    return M.reachable(_edges(spark, sf_dir).select("from_id", "to_id"), spark.range(7, 8).select(F.col("id").alias("node")))


@query("""WITH u AS (SELECT lang AS library, source AS path, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE 'F' END || doc_id AS name, n_chars FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY library, path ORDER BY doc_id) AS nth FROM u WHERE doc_id % 3 <> 0 QUALIFY nth <= 20),
t AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY path, nth) AS k FROM s QUALIFY k <= 150),
l AS (SELECT library, k, CASE WHEN lag(path) OVER (PARTITION BY library ORDER BY k) IS DISTINCT FROM path THEN [chr(10) || '## From ' || path || ':'] ELSE []::VARCHAR[] END || ['- **Function: ' || name || '**', '  `' || n_chars || ' characters`'] AS lines FROM t)
SELECT library, array_to_string(list_slice(['# Public API for Go Module ' || chr(39) || library || chr(39) || ':'] || flatten(list(lines ORDER BY k)), 1, 150), chr(10)) AS report FROM l GROUP BY library""")
def library_reports(spark, sf_dir):
    """Every language is a library and every source one of its files."""
    id_ = F.col("doc_id").cast("string")
    units = _t(spark, sf_dir, "documents").select(
        F.col("lang").alias("library"), F.col("source").alias("path"), id_.alias("id"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("docstring"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, "f").otherwise("F"), id_).alias("name"), F.concat(F.col("n_chars").cast("string"), F.lit(" characters")).alias("signature"),
        F.to_json(F.struct(F.col("doc_id").alias("start_line"))).alias("metadata"),
    )
    return L.interface_reports(units, "go")


#: Rules of an ignore file about web addresses, and the pattern of each; a rule that takes back begins with `!`.
_RULES = (("*.html", r"\.html(/.*)?$"), ("/*/de/", r"^[^/]*/de/.*$"), ("!p1*", r"^(.*/)?p1[^/]*(/.*)?$"), ("en/", r"^(.*/)?en/.*$"), ("!index.html", r"^(.*/)?index\.html(/.*)?$"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN {str(not r.startswith('!')).lower()}" for r, p in reversed(_RULES)) + " ELSE false END AS ignored FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)")
def ignore_table(spark, sf_dir):
    files = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return ignored_by(files, [r for r, _ in _RULES]).select("page_id", "ignored")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM ({_EDGES})),
r(start, node, depth) AS (SELECT DISTINCT from_id, from_id, 0 FROM e WHERE from_id % 20 = 0 UNION SELECT r.start, e.to_id, r.depth + 1 FROM r JOIN e ON e.from_id = r.node WHERE r.depth < 3)
SELECT start, node, min(depth)::INTEGER AS depth FROM r GROUP BY start, node""")
def reach_each(spark, sf_dir):
    edges = _edges(spark, sf_dir).select("from_id", "to_id")
    return M.reachable_each(edges, edges.where("from_id % 20 = 0").select(F.col("from_id").alias("start"), F.col("from_id").alias("node")))


_FILE = "'m' || ({0} % 7) || '/c' || ({0}) || CASE ({0}) % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END"


@query(f"SELECT {_FILE.format('a.c_custkey')} AS from_id, {_FILE.format('b.c_custkey')} AS to_id FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def import_resolution(spark, sf_dir):
    """Every customer is a script that re-exports the next one's."""
    key, path = F.col("c_custkey"), F.expr(_FILE.format("c_custkey"))
    up = F.when(key % 3 == 2, "../../").otherwise("../")
    code = F.concat(F.lit("export * from '"), up, F.lit("m"), ((key + 1) % 7).cast("string"), F.lit("/c"), (key + 1).cast("string"), F.lit("'"))
    units = _t(spark, sf_dir, "customer").select(path.alias("path"), F.lit("module").alias("kind"), code.alias("code"), F.lit('{"node_type": "export_statement"}').alias("metadata"))
    return L.imports(units, units.select("path"), "javascript")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_meta(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", T.metadata_field("props", "k").alias("k"))


@query("SELECT to_json({'id': doc_id, 'path': source, 'kind': lang, 'n': n_chars}) AS hit FROM documents")
def search_json(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("kind"), F.col("n_chars").alias("n"))).alias("hit"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE / n, 5) AS first, round(embedding[64]::DOUBLE / n, 5) AS last FROM
(SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-12) AS n FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select("vec_id", l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"))


@query("SELECT label, k::INTEGER AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY ALL")
def mean_pool(spark, sf_dir):
    rows = pooled(_t(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", F.posexplode("vec").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("""SELECT label, k::INTEGER AS dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS mean
FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k, (vec_id % 3 > 0)::INT::DOUBLE AS m FROM embeddings) GROUP BY label, k""")
def masked_mean_pool(spark, sf_dir):
    rows = pooled(_t(spark, sf_dir, "embeddings").withColumn("kept", F.col("vec_id") % 3 > 0), "label", "embedding", "kept")
    return rows.select("label", F.posexplode("vec").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT source, count(*) AS indexed_files, count(*) FILTER (toxic = 1) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def sync_summary(spark, sf_dir):
    """Documents are files that fail where they are toxic."""
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source")
    return outcome(files, _t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path")), "source")
