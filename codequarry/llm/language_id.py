"""Language of web pages by Bayesian fusion of evidence.

Four sources speak for each language: the visible text (byte trigrams under per-language multinomials, counted over all labelled
documents), the language that the markup declares, codes in the address (a label of the host, the first part of the path), and what the
host usually holds. How far a declaration or code is to be believed is learned: both are counted against the language of the text alone.
Host priors are smoothed in steps, world to address suffix to domain to host, with counts from grouped aggregation; so any suffix counts,
and a host without texts has its domain's or its suffix's prior.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, written
from .decontaminate import _SUM, _summed, _vector_rows

#: Hash buckets of trigrams, pseudo-counts of each, share of a trigram's log-likelihood that counts (they overlap), strength of priors.
BUCKETS, SMOOTH, TEMPER, STRENGTH = 1 << 14, 0.5, 0.1, 8.0
#: Copies of each host's prior, over which the pages of a hot host are dealt.
SALTS = 16

_TAG = re.compile(rb"</?([a-z][a-z0-9]*)")
_LANG, _CONTENT = re.compile(rb"\blang\s*=\s*(?:[\"']\s*)?([a-z]{2,8})\b"), re.compile(rb"\bcontent\s*=\s*(?:[\"']\s*)?([a-z]{2,8})\b")
_UNSEEN = (b"script", b"style", b"noscript", b"template")
# Second-level labels that make a suffix of two labels together with a country's.
_SECOND = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "go", "ne", "net", "or", "org")
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x61 and b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint32)


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the trigrams of letters (other bytes count as a space; runs of spaces don't count)."""
    x = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    keep = ~((x[1:-1] == 0x20) & ((x[:-2] == 0x20) | (x[2:] == 0x20)))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18))[keep]


def read(page: str) -> tuple[str, str]:
    """The text that a reader sees, and the language that the markup declares, in lower case and without region; empty if there is none.

    One pass from tag to tag. What opens a comment, a script or a tag and never closes it hides the rest of the page.
    """
    raw = page.encode()
    low, out, at, by_tag, by_meta = raw.lower(), [], 0, b"", b""
    while (a := raw.find(b"<", at)) >= 0:
        out.append(raw[at:a])
        if raw.startswith(b"<!--", a):
            end = raw.find(b"-->", a + 4) + 3
            at = end if end > 2 else len(raw)
            continue
        end = raw.find(b">", a) + 1
        if not end:
            at = len(raw)
            break
        at, tag = end, _TAG.match(low, a)
        name = tag[1] if tag else b""
        if name == b"html" and not by_tag and (found := _LANG.search(low, a, end)):
            by_tag = found[1]
        elif name == b"meta" and not by_meta and b"content-language" in low[a:end] and (found := _CONTENT.search(low, a, end)):
            by_meta = found[1]
        elif name in _UNSEEN and raw[a + 1 : a + 2] != b"/":
            close = low.find(b"</" + name, end)
            end = raw.find(b">", close) + 1 if close >= 0 else 0
            at = end or len(raw)
    out.append(raw[at:])
    return markup.unescape(b" ".join(out).decode()), (by_tag or by_meta).decode()


def address(url: str | None, languages: list[str]) -> tuple[str, str, str, str]:
    """Host, domain, suffix, and the language code of the path or of the host's first label: 'none' where none is known."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or "").lower().rstrip("."), parts.path
    except ValueError:
        host, path = "", ""
    labels = host.split(".")
    n = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else 1
    first = re.match(r"/([A-Za-z]{2,3})(?:[-_][A-Za-z]+)?(?:/|$)", path)
    codes = [c for c in (first[1].lower() if first else "", labels[0] if len(labels) > n + 1 else "") if c in languages]
    return host, ".".join(labels[-n - 1 :]), ".".join(labels[-n:]), codes[0] if codes else "none"


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of trigram buckets by language, from all of docs (text, lang).

    What the driver holds grows with the number of languages alone, 64 kB for each.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.lower("lang").alias("lang"))
    languages = sorted(r.lang for r in docs.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, BUCKETS))
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for piece in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(piece.column("lang").to_pylist(), text_bytes(piece), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                total[index[lang]] += np.bincount(trigrams(b"  ".join(texts)), minlength=BUCKETS)
        yield from _vector_rows(total.reshape(-1), _SUM, BUCKETS)

    rows = _summed(docs.mapInArrow(run, "key int, value binary"), "<i8").orderBy("key").collect()  # one row a language
    counts = np.array([np.frombuffer(r.value, "<i8") for r in rows], float).reshape(len(languages), -1) + SMOOTH
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


_SEEN = "page_id long, host string, domain string, suffix string, declared string, code string, text_lang int, loglik array<double>"
_SEEN_ARROW = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("code", pa.string()), ("text_lang", pa.int32()), ("loglik", pa.list_(pa.float64()))])
_OUT = "page_id long, lang string, confidence double, text_lang string, declared string, code string, host_lang string"
_OUT_ARROW = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in (x.split() for x in _OUT.split(", "))])


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence (posterior), text_lang, declared, code, host_lang for every row of pages (page_id, url, html).

    docs (text, lang) teach the text model; without a labelled document lang is null. Null or empty html and addresses are no evidence:
    such a page gets the prior of what is known of it. declared is the declared language, 'other' if no labelled document has it, 'none'
    without one. Of languages that are equally likely the first by name is taken. Pages are read whole, in one pass, whatever their length.
    Rows come out one for one, repeated ones too; an empty table gives none; other columns are ignored.
    """
    languages, model = text_model(docs)
    spark, size = pages.sparkSession, len(languages)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    if not languages:
        return rows.select("page_id", *[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in _OUT.split(", ")[1:])])
    shared = spark.sparkContext.broadcast(model.T.copy())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in slices(batches, "html"):
            rows = []
            for page_id, url, page in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                text, declared = read(page or "")
                host, domain, suffix, code = address(url, languages)
                declared = declared if declared in languages else "other" if declared else "none"
                grams = np.bincount(trigrams(text.encode()), minlength=BUCKETS)
                at = np.flatnonzero(grams)
                ll = TEMPER * (grams[at] @ model[at])
                ll = ll - ll.max() if len(at) else np.zeros(size)
                rows.append((page_id, host, domain, suffix, declared, code, int(np.argmax(ll)) if len(at) else None, ll.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(_SEEN_ARROW, zip(*rows, strict=True), strict=True)], schema=_SEEN_ARROW)

    seen = written(rows.mapInArrow(look, _SEEN), "evidence")
    known = seen.where("text_lang IS NOT NULL")
    tables = {}
    for column in ("declared", "code"):
        # Likelihood of each value by language: at most (languages + 2) * languages counts.
        values = [*languages, "other", "none"]
        n = np.full((len(values), size), 0.5) + 2.0 * np.array([[v == x for x in languages] for v in values])
        for r in known.groupBy(column, "text_lang").count().collect():
            n[values.index(r[column]), r.text_lang] += r["count"]
        like = np.log(n / n.sum(axis=0, keepdims=True))
        tables[column] = dict(zip(values, like, strict=True))
    world = np.full(size, 1.0)
    by_host = seen.groupBy("host", "domain", "suffix", "text_lang").agg(F.count(F.lit(1)).alias("n"))
    by_host = written(by_host, "hosts")
    for r in by_host.where("text_lang IS NOT NULL").groupBy("text_lang").agg(F.sum("n").alias("n")).collect():
        world[r.text_lang] += r.n
    world /= world.sum()
    column = lambda lang: F.coalesce(F.sum(F.when(F.col("text_lang") == lang, F.col("n"))), F.lit(0)).cast("double")
    vector = lambda: F.array(*[column(k) for k in range(size)])
    toward = lambda n, p: F.zip_with(n, p, lambda a, b: a + STRENGTH * b)
    share = lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y))
    up = by_host.groupBy("suffix").agg(vector().alias("n")).select("suffix", share(toward(F.col("n"), F.array(*[F.lit(float(x)) for x in world]))).alias("above"))
    for level in (["domain", "suffix"], ["host", "domain"]):
        counts = by_host.groupBy(*level).agg(vector().alias("n")).join(up, level[1])
        up = counts.select(level[0], share(toward(F.col("n"), F.col("above"))).alias("above"))
    # Each host's prior once for each salt, so that the pages of a hot host are joined in many tasks.
    prior = up.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("above").alias("prior"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "loglik"), F.lit(SALTS)).cast("int"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, declared, code, text_lang, ll, prior in zip(*(b.column(c).to_pylist() for c in ("page_id", "declared", "code", "text_lang", "loglik", "prior")), strict=True):
                prior = np.array(prior)
                total = np.array(ll) + np.log(prior) + tables["declared"][declared] + tables["code"][code]
                p = np.exp(total - total.max())
                p /= p.sum()
                best = int(np.argmax(p))
                rows.append((page_id, languages[best], float(p[best]), languages[text_lang] if text_lang is not None else None, declared, code, languages[int(np.argmax(prior))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(_OUT_ARROW, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], f.type) for f in _OUT_ARROW], schema=_OUT_ARROW)

    return salted.join(prior, ["host", "salt"]).select("page_id", "declared", "code", "text_lang", "loglik", "prior").mapInArrow(fuse, _OUT)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
