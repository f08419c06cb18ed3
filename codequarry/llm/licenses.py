"""License scan by ordered signature rules: hundreds of regular expressions over words, gated by keywords, with contained detections suppressed.

A text becomes a row of words with their places (` gpl:7 3:8`), so that a match of a rule tells its first and last word by itself. Only rules
whose keyword is among the words of a text are tried. Detections of all rules are sorted by start and length; one that lies inside another of
the same or a better priority is dropped, those that overlap otherwise stay. All in DataFrame functions within one row: no shuffle, and no state but the text.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import SURE, Rule, rules

#: Phrases that are always looked for, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Detections that are compared one by one; longer lists are compared with the best of each such block.
_BLOCK = 256
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def placed(pattern: str) -> str:
    """The regular expression for a pattern of license_rules in a text of words with places."""
    out = ""
    for word in pattern.replace("LIC", "licen[cs]e").split():
        bare = word.removesuffix("?")
        out += f"(?: {bare.replace('(', '(?:')}:\\d+)" + ("?" if bare != word else "")
    return out


#: One expression for the base phrases, which begin with different words and so never overlap.
_BASE = " (?:mit:\\d+|apache:\\d+|general:\\d+ public:\\d+) license:\\d+"


def _by_keyword(all_rules: list[Rule]) -> Column:
    """A map from keyword to its rules: number, label, priority, regular expression."""
    found: dict[str, list[Column]] = {"license": []}
    for i, r in enumerate(all_rules):
        row = F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(placed(r.pattern)).alias("pattern"))
        found.setdefault(r.keyword, []).append(row)
    none = F.array().cast("array<struct<rule:int,label:string,priority:int,pattern:string>>")
    return F.create_map(*[c for k, v in found.items() for c in (F.lit(k), F.array(*v) if v else none)])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once although `then` uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _resolved(found: Column) -> Column:
    """Sorted detections (first, past = minus their end, priority, rule, label) but for those inside an earlier one of the same or a better
    priority. What contains a detection comes before it, so each is compared with those before it in its block and with the best of earlier blocks."""
    longest = lambda block, p: F.array_min(F.transform(F.filter(block, lambda d: d["priority"] <= p), lambda d: d["past"]))
    best = lambda blocks: F.transform(blocks, lambda b: F.array(*[F.coalesce(longest(b, p), F.lit(0)) for p in range(len(SURE))]))

    def kept(both: Column) -> Column:
        def free(d: Column, block: Column, i: Column, at: Column) -> Column:
            near = F.exists(F.slice(block, F.lit(1), i), lambda e: (e["priority"] <= d["priority"]) & (e["past"] <= d["past"]))
            far = F.exists(F.slice(both["best"], F.lit(1), at), lambda b: F.get(b, d["priority"]) <= d["past"])
            return ~near & ~far

        return F.flatten(F.transform(both["blocks"], lambda block, at: F.filter(block, lambda d, i: free(d, block, i, at))))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(_BLOCK)), lambda at: F.slice(found, at, _BLOCK))
    return _let(blocks, lambda b: _let(F.struct(b.alias("blocks"), best(b).alias("best")), kept))


def detected(docs: DataFrame, text: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, `base` (first, label of every place of a base phrase, in order), `detections` (first, last, priority, rule, label of
    what the rules find and doesn't lie inside a better one, in order; places are words from 0), base_labels and labels (sorted arrays).

    A null text is empty; rows are judged alone, so repeated rows have equal results; all other columns stay, but for those named like a new one.
    """
    found = rules() if all_rules is None else all_rules
    new = ("n_words", "base", "detections", "base_labels", "labels")
    rows = docs.drop(*new).withColumn("_text", F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0))).drop("_text")
    rows = rows.withColumn("_keys", F.array_intersect("_words", F.array(*[F.lit(k) for k in dict.fromkeys(["license", *(r.keyword for r in found)])])))
    line = F.array_join(F.transform("_words", lambda w, i: F.concat(F.lit(" "), w, F.lit(":"), i.cast("string"))), "")
    rows = rows.withColumn("_line", F.when(F.size("_keys") > 0, line).otherwise("")).withColumn("n_words", F.size("_words").cast("long")).drop("_words")
    first = lambda m: F.regexp_extract(m, r":(\d+)", 1).cast("int")
    past = lambda m: -1 - F.substring_index(m, ":", -1).cast("int")
    named = lambda m: F.when(F.startswith(m, F.lit(" mit:")), "mit").when(F.startswith(m, F.lit(" apache:")), "apache").otherwise("gpl")
    base = F.transform(F.regexp_extract_all("_line", F.lit(_BASE), F.lit(0)), lambda m: F.struct(first(m).alias("first"), named(m).alias("label")))
    table_of = _by_keyword(found)
    tried = F.flatten(F.transform("_keys", lambda k: F.element_at(table_of, k)))
    matches = F.flatten(F.transform(tried, lambda r: F.transform(
        F.regexp_extract_all(F.col("_line"), r["pattern"], F.lit(0)),
        lambda m: F.struct(first(m).alias("first"), past(m).alias("past"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")),
    )))
    rows = rows.withColumns({"base": base, "_found": F.sort_array(matches)}).drop("_line", "_keys")
    rows = rows.withColumn("_found", _resolved(F.col("_found")))
    shown = F.transform("_found", lambda d: F.struct(d["first"].alias("first"), (-1 - d["past"]).alias("last"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("_found", lambda d: d["label"]))))
    return rows.withColumns({"detections": shown, "base_labels": base_labels, "labels": labels}).drop("_found")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = lambda i: F.try_element_at("base", F.lit(i))["first"].cast("long")
    sure = F.element_at(F.array(*[F.lit(s) for s in SURE]), 1 + F.array_min(F.transform("detections", lambda d: d["priority"])))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), at(1).alias("first_word"), at(-1).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.when(F.size("detections") > 0, sure).otherwise(0.0).alias("score"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: doc_id tells rows apart there, as in the given table.
ORACLE_OP12 = f"""
WITH r(rule, label, keyword, priority, pattern) AS (VALUES {", ".join(f"({i}, {_quoted(x.label)}, {_quoted(x.keyword)}, {x.priority}, {_quoted(placed(x.pattern))})" for i, x in enumerate(rules()))}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, ws, array_to_string(list_transform(ws, lambda x, i: ' ' || x || ':' || (i - 1)), '') AS line FROM w WHERE list_has_any(ws, (SELECT list(keyword) FROM r)) OR list_contains(ws, 'license')),
b AS (SELECT doc_id, regexp_extract(m, ':(\\d+)', 1)::BIGINT AS first, CASE WHEN m LIKE ' mit:%' THEN 'mit' WHEN m LIKE ' apache:%' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT doc_id, unnest(regexp_extract_all(line, {_quoted(_BASE)})) AS m FROM t)),
m AS (SELECT doc_id, rule, label, priority, unnest(regexp_extract_all(line, pattern)) AS m FROM t JOIN r ON list_contains(ws, keyword)),
d AS MATERIALIZED (SELECT doc_id, rule, label, priority, regexp_extract(m, ':(\\d+)', 1)::BIGINT AS first, regexp_extract(m, ':(\\d+)$', 1)::BIGINT AS last FROM m),
k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.first <= d.first AND e.last >= d.last AND e.priority <= d.priority
  AND (e.first < d.first OR e.last > d.last OR e.priority < d.priority OR e.rule < d.rule))),
x AS (SELECT doc_id, count(*) AS n, min(first) AS f, max(first) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id),
z AS (SELECT doc_id, ([{", ".join(map(str, SURE))}])[1 + min(priority)]::DOUBLE AS score FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_base, x.f AS first_word, x.l AS last_word,
  coalesce(x.labels, '') AS base_labels, coalesce(y.labels, '') AS labels, coalesce(z.score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""
