"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Fit, on a bounded sample of labelled rows: words are counted by documents of each label; a word's score is its log-odds with an
informative Dirichlet prior (the background frequencies, PRIOR pseudo-documents strong), kept if its z-score is clear. Score: a text is a
sequence of word scores with a negative mean; one pass finds all its maximal-scoring segments. Segment scores of unrelated text follow an
extreme-value law: with lambda from sum(p * exp(lambda * s)) = 1 and K from the median of clean texts' maxima, a segment of score S in a text of
n words has the expected number of chance finds E = K * n * exp(-lambda * S). Segments of small E are toxic passages. -log E of the best
one, the evidence of all significant ones and their number give the probability, by a logistic curve fitted on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, slices, table, text_bytes, written
from .words import LETTERS, Words

#: Labelled rows to learn from, words to keep, pseudo-counts of the prior in proportion to the background and for any word, least z-score, decision threshold, largest E of a passage.
SAMPLE, LEXICON, PRIOR, FLOOR, Z, THRESHOLD, SIGNIFICANT = 20_000, 50_000, 200.0, 0.5, 3.0, 0.7, 0.05
#: Score of a word that is not in the lexicon.
_DEFAULT = -0.08


class Lexicon:
    """Word scores by hash: a sorted array of hashes and their scores."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.score = hashes[order], scores[order].astype(np.float32)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), _DEFAULT, np.float32)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, self.score[at], np.float32(_DEFAULT))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, by one pass over its positive runs (Ruzzo and Tompa)."""
    up = scores > 0
    edges = np.flatnonzero(np.diff(up.astype(np.int8), prepend=0, append=0))
    total = np.append(0.0, np.cumsum(scores, dtype=np.float64))
    done: list[tuple[int, int, float, float]] = []  # start, end, total before, total after; totals before rise to the right
    links: list[int] = []  # for each, the nearest one to its left with a smaller total before
    for a, b in edges.reshape(-1, 2).tolist():
        start, low, high = a, total[a], total[b]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= low:
                j = links[j]
            if j < 0 or done[j][3] >= high:
                done.append((start, b, low, high))
                links.append(j)
                break
            start, low = done[j][0], done[j][2]  # one segment reaches over all since j
            del done[j:], links[j:]
    return [(a, b, float(h - lo)) for a, b, lo, h in done]


class Calibration:
    """The extreme-value law of chance segments and the curve from evidence to probability."""

    def __init__(self, lam: float, k: float, weights: np.ndarray):
        self.lam, self.k, self.weights = lam, k, weights

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        """-log E of the best segment, the sum over significant ones, and how many there are."""
        if not found:
            return 0.0, 0.0, 0.0
        e = self.lam * np.array([s for _, _, s in found]) - np.log(self.k * n)
        good = e[e >= -np.log(SIGNIFICANT)]
        return max(0.0, float(e.max())), float(good.sum()), float(len(good))

    def probability(self, x: tuple[float, float, float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(np.array([x])) @ self.weights, -30, 30))[0]))


def features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.minimum(x[:, 0], 20) / 10, np.log1p(x[:, 1]), np.minimum(x[:, 2], 5)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def _texts_scored(lexicon: Lexicon, piece: pa.RecordBatch) -> Iterator[tuple[list, int, np.ndarray, Words, int]]:
    w = Words(text_bytes(piece), LETTERS, lower=True)
    scores = lexicon.of(w.hash)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield segments(scores[a:b]), b - a, scores[a:b], w, a


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, Calibration]:
    """Learn from at most `sample` rows of labels (doc_id, toxic), the first by a hash of the id, and their texts in docs.

    Rows of labels without doc_id or toxic, and documents without doc_id, teach nothing; an id with several labels is toxic if one of them
    says so; each text of an id that occurs several times counts. Null and empty texts count as clean evidence of no words. Without labels,
    or without texts to them, no word has a score, and every text gets the same low probability. Extra columns of both are ignored.
    """
    spark = docs.sparkSession
    pick = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(crc32_of_id(), F.lit(3)) != 1)
    pick = pick.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    pick = pick.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's bound is a parameter, so its ids and labels can be broadcast.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    texts = written(texts.join(F.broadcast(pick), "doc_id").select("toxic", "text"), "labelled")
    schema = pa.schema([("word", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most_bytes=4 << 20):
            w = Words(text_bytes(piece), LETTERS, lower=True)
            label = piece.column("toxic").to_numpy()
            order = np.lexsort((doc := w.doc(), w.hash))
            h, doc = w.hash[order], doc[order]
            new = np.append(len(h) > 0, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]  # a word counts once a document
            h, t = h[new], label[doc[new]]
            at = np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1]))[: len(h)]
            toxic = np.add.reduceat(t, at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            size = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(toxic), pa.array(size - toxic)], schema=schema)

    words = texts.mapInArrow(count, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    words = written(words, "word-labels")
    sums = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    nt, nc = float(sums[0]), float(sums[1])
    alpha = F.lit(PRIOR) * (F.col("t") + F.col("c")) / max(nt + nc, 1.0) + FLOOR
    odds = lambda n, total: F.log((F.col(n) + alpha) / (F.lit(total + PRIOR) - F.col(n) - alpha))
    words = words.where("t + c >= 3").select("word", ((F.col("t") + F.col("c")) / max(nt + nc, 1.0)).alias("p"), (odds("t", nt) - odds("c", nc)).alias("score"),
        F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha)).alias("sd"))
    kept = words.where(F.abs(F.col("score")) > Z * F.col("sd")).orderBy(F.desc(F.abs(F.col("score")) / F.col("sd")), "word").limit(LEXICON).collect()  # bounded
    lexicon = Lexicon(np.array([r.word for r in kept], np.int64).view(np.uint64), np.clip(np.array([r.score for r in kept], np.float64), -3, 6))
    out = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))])
    grid = np.linspace(0.02, 3.0, 300)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            rows = []
            for label, (found, n, scores, _, _) in zip(piece.column("toxic").to_pylist(), _texts_scored(lexicon, piece), strict=True):
                value, times = np.unique(scores, return_counts=True)
                rows.append((label, n, sorted((s for _, _, s in found), reverse=True), (times @ np.exp(np.outer(value, grid))).tolist() if n and not label else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(out, zip(*rows, strict=True), strict=True)], schema=out)

    seen = written(texts.mapInArrow(look, "toxic int, n long, found array<double>, sums array<double>"), "calibration")
    clean = seen.where("toxic = 0 AND n > 0")
    moments = clean.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()  # one row for each grid point
    mean = np.array([r.s / r.n for r in moments]) if moments else np.zeros(0)
    above = np.flatnonzero(mean > 1)
    lam = float(grid[above[0]]) if len(above) else 1.0
    # Gumbel: the median of maxima keeps unlabelled toxic text out.
    stat = clean.where("n >= 20").select((lam * F.coalesce(F.get("found", F.lit(0)), F.lit(0.0)) - F.log("n")).alias("x")).agg(F.percentile_approx("x", 0.5, 1000)).first()[0]
    k = float(np.exp(np.log(np.log(2)) + stat)) if stat is not None else 1.0  # the median is (log(K n) - log log 2) / lambda
    first = Calibration(lam, max(k, 1e-6), np.zeros(5))
    sample_rows = seen.select("toxic", "n", "found").collect()  # the rows of at most `sample` ids, a number for each segment
    if not sample_rows:
        return lexicon, Calibration(lam, first.k, np.array([-3.0, 1.0, 0.0, 0.0, 0.0]))
    x = np.array([first.evidence([(0, 0, s) for s in r.found], r.n) for r in sample_rows])
    return lexicon, Calibration(lam, first.k, logistic(features(x), np.array([r.toxic for r in sample_rows], float)))


def scored(docs: DataFrame, lexicon: Lexicon, calibration: Calibration, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, passages (start and end in bytes of the text, score) for every row of docs (doc_id, text).

    Other columns are ignored. Null and empty texts have no evidence and get the base probability. Rows come out one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, calibration))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", passage)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, calibration = shared.value
        floor = np.log(calibration.k) - np.log(SIGNIFICANT)
        for piece in slices(batches):
            rows, at = [], 0
            for d, raw, (found, n, _, w, first) in zip(piece.column("doc_id").to_pylist(), text_bytes(piece), _texts_scored(lexicon, piece), strict=True):
                p = calibration.probability(calibration.evidence(found, n))
                big = [(a, b, s) for a, b, s in found if calibration.lam * s >= floor + np.log(n)]
                spans = [{"start": int(w.start[first + a]) - at, "end": int(w.end[first + b - 1]) - at, "score": s} for a, b, s in big]
                rows.append((d, p, int(p >= threshold), spans))
                at += len(raw or b"") + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(out, zip(*rows, strict=True), strict=True)], schema=out)

    kinds = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def without_toxic(docs: DataFrame, lexicon: Lexicon, calibration: Calibration, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text and any other columns) without the rows whose probability reaches the threshold.

    Null and empty texts stay, rows are judged one by one whatever their ids, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, calibration = shared.value
        for piece in slices(batches):
            p = [calibration.probability(calibration.evidence(found, n)) for found, n, *_ in _texts_scored(lexicon, piece)]
            yield piece.filter(pa.array([x < threshold for x in p]))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, *fitted(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
