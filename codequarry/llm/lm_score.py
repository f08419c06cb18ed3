"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation, normalised by batched matrix products.

Tokens are lower-cased words and one end for each text. A distributed count of all training tokens gives the unigram base and the model's
vocabulary: the SHORT commonest tokens, and one class for all others, inside which a token has its smoothed share of the class. The class
and the tokens are predicted from the vectors of the two tokens before: a log-bilinear model, trained in numpy on every training text, in
each task from the same start, and averaged over tasks by their tokens. Two such rounds are made over all texts, the second in smaller
steps. The scores of all contexts of two known tokens are a bounded table of products, so each token's log-probability is
normalised exactly over everything a text can hold, a token never seen included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, slices, table, text_bytes, written
from .decontaminate import _SUM, _summed, _vector_rows
from .words import PLAIN, Words

#: Tokens that the model tells apart; tokens whose counts are broadcast; width of a vector.
SHORT, KNOWN, WIDTH = 1_023, 262_144, 24
#: Noise draws shared by a batch; batch size; learning rate of each round.
NOISE, BATCH, RATES = 64, 4_096, (0.12, 0.04)
#: The end of a text, as a token.
END = 0x5BD1E9955BD1E995


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the index of each text's first token (and of the end)."""
    w = Words(texts, PLAIN, lower=True)
    n = np.diff(w.first)
    first = np.append(0, np.cumsum(n + 1))
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = w.hash, np.uint64(END)
    return out, first


def counts(docs: DataFrame) -> DataFrame:
    """token (hash as a long), c: the tokens of all texts of docs."""
    schema = pa.schema([("token", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most_bytes=8 << 20):
            parts = [token_hashes(text_bytes(p))[0] for p in slices(iter([piece]))]
            token, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], schema=schema)

    return docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """token, c: known tokens, sorted by hash, and their counts; id: the model's id of each (SHORT for the class of others)."""

    token: np.ndarray
    c: np.ndarray
    id: np.ndarray
    total: int
    distinct: int
    short: int

    @classmethod
    def of(cls, counted: DataFrame, short: int, known: int) -> Vocabulary:
        total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        # The least count that keeps at most `known` tokens, from a histogram of a few thousand rows at most.
        level = F.floor(F.log2("c") * 32)
        bars, room, least = counted.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect(), known, None
        for r in bars:
            if r.n > room:
                break
            room, least = room - r.n, r.b
        rows = counted.where(level >= (least if least is not None else 1 << 30)).toArrow()
        token, c = rows.column("token").to_numpy().view(np.uint64), rows.column("c").to_numpy()
        top = np.lexsort((token, -c))[:short]
        ids = np.full(len(token), short, np.int32)
        ids[top] = np.arange(len(top))
        order = np.argsort(token)
        return cls(token[order], c[order], ids[order], int(total), int(distinct), short)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not among the known) and ids of tokens."""
        if not len(self.token):
            return np.full(len(h), -1, np.int64), np.full(len(h), self.short, np.int32)
        at = np.searchsorted(self.token, h)
        at[at == len(self.token)] = 0
        hit = self.token[at] == h
        return np.where(hit, self.c[at], -1), np.where(hit, self.id[at], self.short)

    def commonest(self) -> Vocabulary:
        keep = self.id < self.short
        return Vocabulary(self.token[keep], self.c[keep], self.id[keep], self.total, self.distinct, self.short)

    def shares(self) -> np.ndarray:
        """Unigram probability of each model id."""
        out = np.zeros(self.short + 1)
        np.add.at(out, self.id, self.c)
        out[-1] = self.total - out[:-1].sum()
        return (out + 0.5) / (out + 0.5).sum()


class LogBilinear:
    """Parameters in one flat array: two context maps (short + 2 rows), token vectors (short + 1 rows), biases."""

    def __init__(self, short: int, width: int, flat: np.ndarray | None = None, shares: np.ndarray | None = None):
        self.short, self.width = short, width
        rows = 2 * (short + 2) + short + 1
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.append(rng.normal(0, 0.1, rows * width), np.log(shares)).astype(np.float32)
        self.flat = flat
        maps = flat[: rows * width].reshape(rows, width)
        self.near, self.far, self.vectors = maps[: short + 2], maps[short + 2 : 2 * (short + 2)], maps[2 * (short + 2) :]
        self.bias = flat[rows * width :]

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], shares: np.ndarray, rate: float) -> int:
        """One pass of noise-contrastive estimation over (token, one before, two before); returns the tokens seen."""
        rng, log_noise, seen = np.random.default_rng(11), np.log(NOISE * shares).astype(np.float32), 0
        stairs = np.cumsum(shares)
        memory = {k: np.full(getattr(self, k).shape, 1e-2, np.float32) for k in ("near", "far", "vectors", "bias")}
        for token, one, two in batches:
            draw = np.minimum(np.searchsorted(stairs, rng.random(NOISE)), self.short)
            h, q = self.near[one] + self.far[two], self.vectors[draw]
            good = np.einsum("ij,ij->i", h, self.vectors[token]) + self.bias[token] - log_noise[token]
            bad = h @ q.T + (self.bias[draw] - log_noise[draw])
            up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
            down = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
            dh = up[:, None] * self.vectors[token] + down @ q
            n = np.float32(len(token))
            steps = {k: np.zeros_like(m) for k, m in memory.items()}
            _add(steps["near"], one, dh)
            _add(steps["far"], two, dh)
            _add(steps["vectors"], token, up[:, None] * h)
            np.add.at(steps["vectors"], draw, down.T @ h)
            steps["bias"] += np.bincount(token, up, self.short + 1).astype(np.float32)
            np.add.at(steps["bias"], draw, down.sum(axis=0))
            for k, g in steps.items():
                g /= n
                memory[k] *= 0.999
                memory[k] += g * g * 100
                target = getattr(self, k)
                target += rate * g * 10 / np.sqrt(memory[k])
            seen += len(token)
        return seen

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each token after one token, for both places."""
        return self.near @ self.vectors.T + self.bias, self.far @ self.vectors.T

    def normalisers(self) -> np.ndarray:
        """log of the sum over tokens of exp(score), for every pair (one before, two before)."""
        near, far = self.tables()
        top = near.max(axis=1)
        left = np.exp(near - top[:, None])  # sum(exp(a + b)) = exp(a) . exp(b): one matrix product for all pairs
        peak = far.max(axis=1)
        return (np.log(left @ np.exp(far - peak[:, None]).T + 1e-30) + top[:, None] + peak[None, :]).astype(np.float32)


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    by = rows[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    into[by[first]] += np.add.reduceat(values[order], first, axis=0)


def _contexts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two tokens before, `start` beyond the beginning of a text."""
    one, two = np.append(start, ids[:-1]), np.append([start, start], ids[:-2])[: len(ids)]
    one[first[:-1]] = two[first[:-1]] = start
    second = first[:-1] + 1
    two[second[second < first[1:]]] = start
    return one, two


def trained(docs: DataFrame, vocabulary: Vocabulary, width: int = WIDTH) -> LogBilinear:
    """The model of all texts of docs (doc_id, text)."""
    shares, short = vocabulary.shares(), vocabulary.short
    model = LogBilinear(short, width, shares=shares)
    sc = docs.sparkSession.sparkContext
    for rate in RATES:
        shared = sc.broadcast((vocabulary.commonest(), shares, model.flat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            vocabulary, shares, flat = shared.value
            own = LogBilinear(short, width, flat.copy())

            def tokens() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                order = np.random.default_rng(3)
                for piece in slices(batches):
                    h, first = token_hashes(text_bytes(piece))
                    ids = vocabulary.find(h)[1]
                    one, two = _contexts(ids, first, short + 1)
                    mix = order.permutation(len(ids))
                    for a in range(0, len(ids), BATCH):
                        at = mix[a : a + BATCH]
                        yield ids[at], one[at], two[at]

            seen = own.train(tokens(), shares, rate)
            if seen:
                out = np.append(own.flat.astype(np.float64) * seen, seen)
                yield from _vector_rows(out, _SUM, 16_384)

        rows = _summed(docs.select("text").mapInArrow(run, "key int, value binary"), "<f8").orderBy("key").collect()  # the model's size
        if rows:
            total = np.concatenate([np.frombuffer(r.value, "<f8") for r in rows])
            model = LogBilinear(short, width, (total[:-1] / total[-1]).astype(np.float32))
    return model


_PART = pa.schema([("key", pa.int64()), ("token", pa.int64()), ("head", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
                   ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame, counted: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text, held_out).

    Tokens beyond the broadcast vocabulary are looked up in the whole table of counts by a join. Null and empty texts have one token,
    the end. Repeated rows give repeated rows; rows are told apart by doc_id and 64 bits of their texts.
    """
    short, total, distinct = vocabulary.short, vocabulary.total, vocabulary.distinct
    rest = vocabulary.id == short
    inner = vocabulary.c[~rest]
    rare = np.log10(max(total - int(inner.sum()), 0) + 0.5 * (max(distinct - len(inner), 0) + 1))
    base = np.log10(total + 0.5 * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model.tables(), model.normalisers()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (near, far), norm = shared.value
        for piece in slices(batches):
            key = piece.column("key").to_numpy()
            h, first = token_hashes(text_bytes(piece))
            c, ids = vocabulary.find(h)
            one, two = _contexts(ids, first, short + 1)
            log_p = (near[one, ids].astype(np.float64) + far[two, ids] - norm[one, two]) / np.log(10)
            seen = c >= 0
            own = np.where(seen, np.log10(np.maximum(c, 0) + 0.5), 0.0)  # the rest of log10(c + 1/2) comes from the join
            log_p += np.where(ids == short, own - rare, 0.0)
            doc = np.repeat(np.arange(len(key)), np.diff(first))
            sums = lambda x: pa.array(np.add.reduceat(x, first[:-1]) if len(key) else x)
            heads = [pa.array(key), pa.array(key), pa.array(np.ones(len(key), np.int32)), piece.column("doc_id"), piece.column("held_out"),
                     pa.array(np.diff(first)), sums((c > 0).astype(np.int64)), sums(own - base), sums(log_p)]
            yield pa.RecordBatch.from_arrays(heads, schema=_PART)
            order = np.lexsort((h[~seen], d := doc[~seen]))
            d, t = d[order], h[~seen][order]
            at = np.flatnonzero(np.append(len(t) > 0, (t[1:] != t[:-1]) | (d[1:] != d[:-1])))[: len(t)]
            null = lambda kind: pa.nulls(len(at), kind)
            yield pa.RecordBatch.from_arrays([pa.array(key[d[at]]), pa.array(t[at].view(np.int64)), pa.array(np.zeros(len(at), np.int32)), piece.column("doc_id").take(pa.array(d[at])), null(pa.bool_()),
                                              pa.array(np.diff(np.append(at, len(t)))), null(pa.int64()), null(pa.float64()), null(pa.float64())], schema=_PART)

    rows = docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long"), "held_out", "text")
    kinds = "key long, token long, head int, doc_id long, held_out boolean, n long, known long, base double, score double"
    parts = rows.mapInArrow(run, kinds).join(counted.withColumnRenamed("token", "t"), F.expr("token = t AND head = 0"), "left")
    tail = F.when(F.col("head") == 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    found = parts.groupBy("key", "doc_id").agg(
        F.sum("head").alias("copies"), F.max("held_out").alias("held_out"),
        F.max(F.when(F.col("head") == 1, F.col("n"))).alias("n_tokens"), F.max("known").alias("known"),
        F.coalesce(F.sum(F.when((F.col("head") == 0) & (F.col("c") > 0), F.col("n"))), F.lit(0)).alias("more"),
        F.max("base").alias("base"), F.max("score").alias("score"), add(tail).alias("tail"),
        add(F.when(F.col("head") == 0, F.col("n") * rare)).alias("class"),
    )
    one = F.col("copies")  # repeated rows share a key: their tails have added up
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), one.cast("int"))))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more") / one).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail") / one).alias("base_score"), (F.col("score") + F.col("tail") / one).alias("score"),
    )


def language_scores(docs: DataFrame, short: int = SHORT, known: int = KNOWN, width: int = WIDTH) -> DataFrame:
    """Scores of every row of docs (doc_id, text; other columns are ignored), learned from the rows whose id isn't held out.

    held_out: the id's CRC-32 is 1 modulo 5 (a null id is never held out). Without training rows every token has the same base.
    """
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held)
    train = docs.where("NOT held_out")
    counted = written(counts(train), "counts")
    vocabulary = Vocabulary.of(counted, short, known)
    return scored(docs, counted, vocabulary, trained(train, vocabulary, width))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
