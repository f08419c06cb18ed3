"""Toivonen mining of phrases: a sample proposes phrases, one pass over all texts counts them and their negative border exactly.

The sample (every document whose hash is divisible by SHARE, so it grows with the corpus) gives the phrases that are frequent there at a
lowered limit. The full pass counts every word and every phrase whose two longest parts, without its last and without its first word, are
both proposed: these are the proposed phrases and their negative border. A border phrase that turns out frequent is a failure of the
sample: it is added to the proposals, and a further pass counts the phrases that thereby come into the border, in which it takes each of them for a failure
as well. So one expansion closes what passes by length would close one after the other: every frequent phrase has been counted, for all its
parts are at least as frequent.

Phrases are counted as 63-bit hashes, which can only add counts of different phrases and so never hide a frequent one. Proposals travel as a
bitmap of at most 2**28 bits; a bit set by chance makes a phrase be counted in vain, so a full bitmap costs time and changes nothing. The last
pass counts what the hashes found frequent by its words, which makes all counts exact (within one task, two phrases count as one if they share
63 bits, by a chance of about one in 10**7 for a task with a million different phrases).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, looked_up, make_importable, slices, table, text_bytes, written
from .words import Words, mixed, windows

#: Frequency of a candidate, its most words, phrases of a language in the result; one document of SHARE is in the sample.
LEAST, LONGEST, TOP, SHARE = 100, 5, 2_000, 16
#: Copies of the count of a single word, for a common one is a part of very many candidates.
SALTS = 32
#: Bytes of text that are hashed at once, hashes that are added up at once, phrases that a task keeps the words of, bits of a bitmap at least and at most.
_TEXT, _HASHES, _SPELLED, _BITS = 1 << 20, 2 << 20, 100_000, (1 << 20, 1 << 28)

_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BREAK = np.array([bool(_BREAKS.match(bytes([b]))) for b in range(256)])
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

Filter = Callable[[np.ndarray], np.ndarray]


def _pieces(text: bytes | None, most: int = 4 * _TEXT) -> list[bytes]:
    """A text cut behind separators so that a part has little more than `most` bytes, as far as it has separators."""
    text, out, at = text or b"", [], 0
    while len(text) - at > most and (found := _BREAKS.search(text, at + most)):
        out.append(text[at : found.end()])
        at = found.end()
    return [*out, text[at:]]


class Phrases:
    """hash[k - 1]: one hash for each place where k words follow each other in a piece, and place[k - 1]: the first of these words. The lowest
    bit of a hash is set for phrases of most words alone, which are a part of no other."""

    def __init__(self, texts: list[bytes], salt: np.ndarray, longest: int):
        self.words = w = Words(texts, _WORD, lower=True)
        doc = w.doc()
        self.hash, self.place = [mixed(w.hash ^ salt[doc]) & ~np.uint64(1)], [np.arange(len(doc))]
        breaks = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(_BREAK[np.frombuffer(w.data, np.uint8)], out=breaks[1:])
        piece = np.zeros(len(doc), np.int64)
        if len(doc):
            piece[1:] = np.cumsum((breaks[w.start[1:]] != breaks[w.end[:-1]]) | (doc[1:] != doc[:-1]))
        for k in range(2, longest + 1):
            h = windows(self.hash[0], k)
            at = np.flatnonzero(piece[: len(h)] == piece[k - 1 : k - 1 + len(h)])
            self.hash.append(h[at] & ~np.uint64(1) | np.uint64(k == longest))
            self.place.append(at)

    def bordered(self, proposed: Filter | None, before: Filter | None = None) -> list[np.ndarray]:
        """For each length, whether the phrase at a place is proposed or in the border: without its last and without its first word it is
        proposed. Every word is, and all phrases are where nothing was proposed.

        With `before`, what an earlier pass had proposed: only phrases that it didn't count, and one that is counted now stands for a proposed one in
        those that are longer, so that no frequent phrase is left for another pass.
        """
        out = [np.full(len(self.hash[0]), before is None)]
        old = self.bordered(before) if before else None
        for k, (shorter, places, at) in enumerate(zip(self.hash, self.place, self.place[1:], strict=False), 1):
            if proposed is None:
                out.append(np.ones(len(at), bool))
                continue
            known = np.zeros(len(self.hash[0]) + 1, bool)
            known[places] = proposed(shorter) if old is None else proposed(shorter) | out[-1]
            here = known[at] & known[at + 1]
            out.append(here if old is None else here & ~old[k])
        return out


def _slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Phrases, list[str]]]:
    """Phrases of the texts of batches (lang, salt, text), and the language of each text."""
    for b in slices(batches, most_bytes=_TEXT):
        parts = [_pieces(t) for t in text_bytes(b)]
        of = np.repeat(np.arange(b.num_rows), [len(p) for p in parts])
        flat, at = [x for p in parts for x in p], 0
        salts, langs = b.column("salt").to_numpy().view(np.uint64)[of], np.array(b.column("lang").to_pylist(), object)[of]
        while at < len(flat):
            end, size = at + 1, len(flat[at])
            while end < len(flat) and size + len(flat[end]) <= 4 * _TEXT:
                size += len(flat[end])
                end += 1
            yield Phrases(flat[at:end], salts[at:end], longest), langs[at:end].tolist()
            at = end


def _added(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    for at in range(0, len(h), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 18)].view(np.int64)), pa.array(n[at : at + (1 << 18)])], names=["h", "n"])


class Bitmap:
    """A set of hashes as bits on the driver and, by broadcast, in the tasks; hashes that aren't in the set may seem to be."""

    def __init__(self, hashes: DataFrame, before: Bitmap | None = None):
        self.spark = hashes.sparkSession
        size = before.size if before else min(max(_BITS[0], 1 << (16 * hashes.count()).bit_length()), _BITS[1])
        both = F.array(F.shiftrightunsigned("h", 1).bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))
        bits = hashes.select(F.explode(both).alias("i")).select(F.shiftright("i", 6).alias("at"), F.expr("shiftleft(1L, cast(i & 63 AS int))").alias("bit"))
        found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.size = size
        self.words = before.words.copy() if before else np.zeros(size >> 6, np.uint64)
        at = found.column("at").to_numpy()
        self.words[at] |= found.column("bits").to_numpy().view(np.uint64)
        self.sent = self.spark.sparkContext.broadcast(self.words)

    def filter(self) -> Callable[[], Filter]:
        """Made in a task: what tells for an array of hashes which are in the set."""
        sent, size = self.sent, self.size

        def made() -> Filter:
            words, low = sent.value, np.uint64(size - 1)

            def bit(i: np.ndarray) -> np.ndarray:
                return (words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)

            return lambda h: bit(h >> np.uint64(1) & low) & bit(h >> np.uint64(32) & low)

        return made


def _counted(docs: DataFrame, longest: int, new: Bitmap | None = None, old: Bitmap | None = None) -> DataFrame:
    """h, n: how often the phrases occur that are proposed in `new` or in its border; with `old`, those that Phrases.bordered() adds to it."""
    filters = [b.filter() for b in (new, old) if b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = [f() for f in filters], [], 0
        for phrases, _ in _slices(batches, longest):
            wanted = phrases.bordered(*(made or [None]))
            for h, w in zip(phrases.hash, wanted, strict=True):
                held.append(h[w])
                size += len(held[-1])
            if size >= _HASHES:
                yield from _added(held)
                held, size = [], 0
        if held:
            yield from _added(held)

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _without(hashes: DataFrame, known: Bitmap) -> DataFrame:
    made = known.filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = made()
        for b in batches:
            yield b.filter(pa.array(~has(b.column("h").to_numpy().view(np.uint64))))

    return hashes.mapInArrow(run, hashes.schema)


def _spelled(docs: DataFrame, frequent: Bitmap, longest: int) -> DataFrame:
    """lang, k, phrase, n: how often each phrase of k words occurs that is in `frequent`; with k = 0 and an empty phrase, all words of a language."""
    made = frequent.filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, spelled = made(), {}
        for phrases, langs in _slices(batches, longest):
            w = phrases.words
            data, doc = w.data.lower(), w.doc()
            names, of = np.unique(langs, return_inverse=True)
            rows = [(str(lang), 0, b"") for lang in names]
            counts = [np.bincount(of[doc], minlength=len(names))]
            for k, (h, at) in enumerate(zip(phrases.hash, phrases.place, strict=True), 1):
                here = has(h)
                u, first, n = np.unique(h[here], return_index=True, return_counts=True)
                at = at[here][first]
                starts, ends = (x[at[:, None] + np.arange(k)].tolist() for x in (w.start, w.end))
                if len(spelled) >= _SPELLED:
                    spelled.clear()
                for i, x in enumerate(u.tolist()):
                    row = spelled.get(x)
                    if row is None:
                        row = spelled[x] = (langs[doc[at[i]]], k, b" ".join([data[y:z] for y, z in zip(starts[i], ends[i], strict=True)]))
                    rows.append(row)
                counts.append(n)
            lang, size, phrase = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "k", "phrase", "n"]
            )

    return docs.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """lang, k, phrase, n of every phrase of 1 to `longest` words that occurs `least` times or more in a language, and, with k = 0 and an
    empty phrase, the number of all words of each language. Counts are exact."""
    make_importable(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)).alias("dealt"))
    whole, sample = rows.drop("dealt"), rows.where("dealt = 0").drop("dealt")
    lowered = max(1, least // (2 * share))
    proposed = written(_counted(sample, longest).where(F.col("n") >= lowered).select("h"), "proposed")
    known = Bitmap(proposed)
    dropped(proposed)
    count = lambda *bitmaps: written(_counted(whole, longest, *bitmaps).where(F.col("n") >= least).select("h"), "counted")
    found = count(known)
    failed = _without(found.where("h & 1 = 0"), known)
    if not failed.isEmpty():
        found = found.unionByName(count(Bitmap(failed, known), known))
    out = written(_spelled(whole, Bitmap(found.distinct()), longest).where((F.col("k") == 0) | (F.col("n") >= least)), "phrases")
    dropped(found)
    return out


def _parts(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, n, score) of frequent_phrases(): those of two words or more at their lowest-scoring cut, but for
    those inside a longer candidate that is as frequent."""
    words = F.split("phrase", " ")
    many = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"))
    cut = F.explode(F.expr("sequence(1, k - 1)"))
    sides = many.select("lang", "phrase", "a", "words", "k", cut.alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.explode(F.array(
            F.struct(F.lit(True).alias("left"), _parts(F.col("words"), 1, F.col("cut")).alias("part"), F.col("cut").alias("size")),
            F.struct(F.lit(False).alias("left"), _parts(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"), (F.col("k") - F.col("cut")).alias("size")),
        )).alias("side"),
    ).select("lang", "phrase", "a", "cut", "side.*")
    salt = F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = phrases.where("k >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(copies).alias("salt"))
    cuts = sides.withColumn("salt", salt).join(counts, ["lang", "part", "salt"]).select("lang", "phrase", "a", "cut", "left", "f", F.lit(None).cast("long").alias("cover"))
    # All shorter phrases inside a candidate, each with the candidate's frequency.
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    covers = many.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("cover")).groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("cut", "int"), ("left", "boolean"), ("f", "long"))]
    rows = cuts.unionByName(covers.select("lang", "phrase", *none, "cover"))
    value = lambda k, left: F.max(F.when((F.col("cut") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")
    each = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("cover").alias("cover"), *[value(k, left) for k in range(1, LONGEST) for left in (True, False)])
    each = each.where("a IS NOT NULL AND (cover IS NULL OR cover < a)")
    each = looked_up(each, phrases.where("k = 0").select("lang", "n"), "lang", "n", "phrase")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).cast("decimal(38,0)")
    best = []
    for k in range(1, LONGEST):
        below = (wide(f"l{k}") * wide(f"r{k}")).cast("decimal(38,0)")
        each = each.withColumns({f"top{k}": top, f"below{k}": below})
        best.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"top{k} div below{k}").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    return each.withColumn("best", F.array_min(F.array_compact(F.array(*best)))).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The `top` phrases of each language of docs (doc_id, text, lang; other columns are ignored): lang, rank (from 1), phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to 5 words that occurs `least` times or more. A null text is empty, a null lang is `und`, repeated rows count
    again, ties in the score go to the more frequent and then to the first phrase by bytes; an empty table gives no rows.
    """
    rows = scored(frequent_phrases(docs, least, share=share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.*, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, n.n, (1000 * c.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[: cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1 :], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.a >= b.a AND q.phrase <> b.phrase AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
