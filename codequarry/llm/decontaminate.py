"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

Passages are runs of SPAN words of the documents. Over all of them the job counts document frequencies of the benchmark's words and
makes, in one more pass, the sketch G * Omega of the Gram matrix G = A'A of the TF-IDF rows A; a randomised (Nystrom) decomposition of
the sketch gives the leading right singular vectors. The benchmark's own segments enter the sketch with the same total weight as the
corpus, so that the latent space keeps what tells them apart. Then every window of every document is projected, and windows whose
cosine with a segment reaches the bar become candidates. A candidate is confirmed on the words themselves: the longest common
subsequence of the item and the surroundings of the window must cover most of the item, or a good part of it and the item's answer.

Words outside the benchmark have no weight in any comparison, so vectors have one dimension for each word of the benchmark, at most DIMS:
beyond that, words share dimensions by hash. The space is fitted once, over all items. Only the search takes the benchmark in blocks of at
most BLOCK items and about BLOCK_BYTES bytes, which bounds what is broadcast at once and changes nothing else; the corpus is never joined or
shuffled, only sums of bounded size are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, text_hash, written
from .words import ALNUM, Words

#: Words of a chunk; chunks of a window; words of a benchmark segment; most items and most text bytes of a search block; most dimensions.
CHUNK, CHUNKS, SEGMENT, BLOCK, BLOCK_BYTES, DIMS = 16, 3, 32, 1_000, 2 << 20, 1 << 17
SPAN = CHUNK * CHUNKS
#: Rank and oversampling of the decomposition; a word in more than this share of passages has no weight unless a segment needs it.
RANK, EXTRA, COMMON, NEEDED = 128, 16, 0.02, 8
#: Least cosine of a candidate; least share of the item in common; the same if the answer is found; least share of the answer.
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.5, 0.8, 0.6, 0.75


class Dimensions:
    """The dimension of each word, from the sorted distinct word hashes of the benchmark."""

    def __init__(self, vocab: np.ndarray, most: int = DIMS):
        self.size = min(len(vocab), most)
        self.vocab = vocab if len(vocab) <= most else None
        if self.vocab is None:
            return
        bits = max(10, int(len(vocab) * 4).bit_length())
        self.shift, self.table, self.spill = np.uint64(64 - bits), np.full((1 << bits, 4), -1, np.int32), []
        for i, h in enumerate(vocab.tolist()):
            row = self.table[h >> (64 - bits)]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
            else:
                self.spill.append(i)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The dimension of each word, or -1 for a word of no weight."""
        if self.vocab is None:
            return (h % np.uint64(self.size)).astype(np.int32)
        out = np.full(len(h), -1, np.int32)
        if not len(self.vocab):
            return out
        slots = (h >> self.shift).astype(np.int64)
        for c in range(4):
            i = self.table[slots, c]
            hit = (i >= 0) & (self.vocab[i] == h)
            out[hit] = i[hit]
        for i in self.spill:
            out[h == self.vocab[i]] = i
        return out


@dataclass
class Block:
    """Some benchmark items, as word hashes."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]

    def segments(self, dimensions: Dimensions) -> Iterator[tuple[int, np.ndarray]]:
        """Item and dimensions of every run of SEGMENT words, half a run apart."""
        for k, w in enumerate(self.words):
            starts = range(0, max(1, len(w) - SEGMENT + 1), SEGMENT // 2)
            for a in sorted({*starts, max(0, len(w) - SEGMENT)}):
                yield k, dimensions.of(w[a : a + SEGMENT])


def _answer(text: bytes, given: bytes | None) -> bytes:
    """The given answer, or else the last sentence, or the last quarter of the words of a single sentence."""
    if given:
        return given
    parts = [p for p in text.replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".").split(b".") if p.strip()]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return b" ".join(words[-max(1, len(words) // 4) :])


def ordered(items: DataFrame, answer: str | None = None) -> DataFrame:
    """item_id, text, answer of items (item_id, text), sorted and written once; `at` ascends in that order, and its upper bits are the part of the sort."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer"))
    return written(rows.where("text IS NOT NULL").orderBy("item_id", "text").withColumn("at", F.monotonically_increasing_id()), "items")


def _in_order(rows: DataFrame, size: int, most_bytes: int) -> Iterator[Row]:
    """The rows of ordered(): a job for as many parts as fit into a block, and not for each part."""
    part = F.shiftright("at", 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("part").collect()  # a row for each part of the sort
    groups: list[list] = []
    for p in parts:
        if groups and groups[-1][2] + p.n <= size and groups[-1][3] + p.bytes <= most_bytes:
            groups[-1][1:] = [p.part, groups[-1][2] + p.n, groups[-1][3] + p.bytes]
        else:
            groups.append([p.part, p.part, p.n, p.bytes])
    for first, last, n, total in groups:
        some = rows.where((F.col("at") >= first << 33) & (F.col("at") < (last + 1) << 33))
        yield from sorted(some.collect(), key=lambda r: r.at) if n <= size and total <= most_bytes else some.orderBy("at").toLocalIterator()


def blocks(items: DataFrame, size: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Read items of ordered() block by block; items without words are passed over."""
    held: list = []
    total = 0

    def block() -> Block:
        w = Words([t for _, t, _ in held], ALNUM, lower=True)
        a = Words([x for _, _, x in held], ALNUM, lower=True)
        cut = lambda w, k: w.hash[w.first[k] : w.first[k + 1]]
        keep = [k for k in range(len(held)) if len(cut(w, k))]
        return Block([held[k][0] for k in keep], [cut(w, k) for k in keep], [cut(a, k) for k in keep])

    for r in _in_order(items, size, most_bytes):
        text = r.text.encode()
        held.append((r.item_id, text, _answer(text, r.answer and r.answer.encode())))
        total += len(text)
        if len(held) == size or total >= most_bytes:
            yield block()
            held, total = [], 0
    if held:
        yield block()


def _vector_rows(v: np.ndarray, schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(v), rows):
        yield pa.RecordBatch.from_arrays([pa.array([at // rows], pa.int32()), pa.array([v[at : at + rows].tobytes()], pa.binary())], schema=schema)


def _summed(rows: DataFrame, kind: str) -> DataFrame:
    """Add up arrays by key, in two steps so that no task reads what all tasks wrote for a key."""
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in t.column("value").to_pylist())
        return pa.table({"key": t.column("key")[:1].cast(pa.int32()), "value": pa.array([total.tobytes()], pa.binary())})

    some = rows.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(16)).cast("int"))
    some = some.groupBy("key", "part").applyInArrow(add, "key int, value binary")
    return some.groupBy("key").applyInArrow(add, "key int, value binary")


_SUM = pa.schema([("key", pa.int32()), ("value", pa.binary())])


def _passages(dimensions: Dimensions, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Benchmark words of a piece: the passage of each and its dimension; and the number of passages."""
    w = Words(text_bytes(piece), ALNUM, lower=True)
    per = -(-np.diff(w.first) // SPAN)
    base = np.cumsum(per) - per
    at = dimensions.of(w.hash)
    keep = at >= 0
    passage = np.repeat(base, np.diff(w.first))[keep] + w.place()[keep] // SPAN
    return passage, at[keep], int(per.sum())


def inverse_frequencies(docs: DataFrame, dimensions: Dimensions, segments: Callable[[], Iterator[np.ndarray]]) -> np.ndarray:
    """The weight of each dimension over all passages of docs, zero for common words that no segment needs."""
    size = dimensions.size
    shared = docs.sparkSession.sparkContext.broadcast(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for piece in slices(batches):
            passage, word, n = _passages(shared.value, piece)
            total[-1] += n
            total[:-1] += np.bincount(np.unique(passage * size + word) % size, minlength=size)
        yield from _vector_rows(total, _SUM, 4096)

    rows = _summed(docs.select("text").mapInArrow(run, "key int, value binary"), "<i8").orderBy("key").collect()  # one number a dimension
    total = np.concatenate([np.frombuffer(r.value, "<i8") for r in rows]) if rows else np.zeros(size + 1, np.int64)
    df, n = total[:-1], int(total[-1])
    keep = df <= max(COMMON * n, 5)
    for words in segments():
        keep[words[np.argsort(df[words], kind="stable")][:NEEDED]] = True
    return np.where(keep, np.log((n + 1) / (df + 1)) + 0.1, 0.0)


def latent_space(docs: DataFrame, dimensions: Dimensions, weight: np.ndarray, segments: Callable[[], Iterator[np.ndarray]], rank: int = RANK) -> np.ndarray:
    """Word vectors: the leading right singular vectors of the passages' and segments' TF-IDF rows."""
    size = dimensions.size
    width = min(rank + EXTRA, size)
    omega = np.random.default_rng(20_240_607).standard_normal((size, width)).astype(np.float32)
    weight = weight.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((dimensions, weight, omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimensions, weight, omega = shared.value
        weighted, sketch, used = omega * weight[:, None], np.zeros((size, width), np.float32), 0
        for piece in slices(batches):
            passage, word, _ = _passages(dimensions, piece)
            keep = weight[word] > 0
            used += _sketch(passage[keep], word[keep], weight, weighted, sketch)
        yield from _vector_rows(np.vstack([sketch, np.full((1, width), used, np.float32)]), _SUM, 128)

    rows = _summed(docs.select("text").mapInArrow(run, "key int, value binary"), "<f4").orderBy("key").collect()  # a row a dimension
    total = np.vstack([np.frombuffer(r.value, "<f4").reshape(-1, width) for r in rows]).astype(np.float64) if rows else np.zeros((size + 1, width))
    sketch, used = total[:-1], total[-1, 0]
    own, n, weighted = np.zeros((size, width), np.float32), 0, omega * weight[:, None]
    for words in segments():
        words = words[weight[words] > 0]
        n += _sketch(np.zeros(len(words), np.int64), words, weight, weighted, own)
    sketch = sketch + max(used, 1.0) / max(n, 1) * own
    shift = 1e-6 * np.linalg.norm(sketch) + 1e-12
    sketch = sketch + shift * omega
    core = omega.T.astype(np.float64) @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank]


def _sketch(row: np.ndarray, word: np.ndarray, weight: np.ndarray, weighted: np.ndarray, sketch: np.ndarray) -> int:
    """Add a'(a omega) of the unit-length rows a to sketch; row ascends. Returns the number of rows."""
    at = np.flatnonzero(np.append(len(row) > 0, row[1:] != row[:-1]))[: len(row)]
    if not len(at):
        return 0
    sizes = np.diff(np.append(at, len(row)))
    norm = np.add.reduceat(weight[word] ** 2, at)
    y = np.add.reduceat(weighted[word], at, axis=0) / norm[:, None]
    order = np.argsort(word, kind="stable")
    by = word[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    rows = np.repeat(np.arange(len(at)), sizes)[order]
    for a in range(0, len(first), 512):  # bounded memory
        lo, hi = first[a], first[a + 512] if a + 512 < len(first) else len(by)
        part = np.add.reduceat(y[rows[lo:hi]], first[a : a + 512] - lo, axis=0)
        sketch[by[first[a : a + 512]]] += part * weight[by[first[a : a + 512]]][:, None]
    return len(at)


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks: positions in one sequence of `size` words by word."""
    row = full = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words.tolist()):
        out[w] |= 1 << i
    return dict(out)


_FOUND = "doc_id long, item_id long, cosine double, common double, answer double, start int, end int, text_hash long"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("text_hash", pa.int64())])


def contaminated(docs: DataFrame, items: DataFrame, answer: str | None = None, rank: int = RANK, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Pairs of a document of docs (doc_id, text) and an item of items (item_id, text; answer: the name of an answer column or null).

    Returns doc_id, item_id, cosine (of the best window), common (share of the item in the longest common subsequence), answer (share of
    the answer found), start and end (words of the document that were compared), and text_hash (of the document's text). Without a given
    answer, an item's last sentence is its answer, or the last quarter of a single sentence. Null and empty texts match nothing, nor do
    items without words; an empty table on either side gives an empty result; repeated rows give repeated pairs; rows without doc_id are
    searched like all others; other columns are ignored. block, the items searched at once, doesn't change the pairs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    items, vocab = ordered(items, answer), np.zeros(0, np.uint64)
    for b in blocks(items, block):
        vocab = np.unique(np.concatenate([vocab, *b.words]))
    if not len(vocab):
        return spark.createDataFrame([], _FOUND)
    dimensions = Dimensions(vocab)

    def segments() -> Iterator[np.ndarray]:
        for b in blocks(items, block):
            yield from (words for _, words in b.segments(dimensions))

    weight = inverse_frequencies(docs, dimensions, segments)
    vectors = (latent_space(docs, dimensions, weight, segments, rank) * weight[:, None]).astype(np.float32)
    space, out = spark.sparkContext.broadcast((dimensions, vectors)), None
    for b in blocks(items, block):
        if b.ids:
            found = _search(docs, space, spark.sparkContext.broadcast(b), cosine)
            out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, space, shared, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (dimensions, vectors) = shared.value, space.value
        segments = list(block.segments(dimensions))
        owner = np.array([k for k, _ in segments])
        latent = np.array([vectors[w].sum(axis=0) for _, w in segments], np.float32)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        masks = [_masks(w) for w in block.words]
        answers = [_masks(w) for w in block.answers]
        weighty = np.abs(vectors).sum(axis=1) > 0
        for piece in slices(batches, most_bytes=1 << 19):
            w = Words(text_bytes(piece), ALNUM, lower=True)
            ids, hashes = piece.column("doc_id").to_pylist(), piece.column("text_hash").to_pylist()
            at = dimensions.of(w.hash)
            spot = np.flatnonzero((at >= 0) & weighty[at])
            n = np.diff(w.first)
            per = -(-n // CHUNK)
            base = np.cumsum(per) - per
            chunk = np.repeat(base, n)[spot] + w.place()[spot] // CHUNK
            first = np.flatnonzero(np.append(len(chunk) > 0, chunk[1:] != chunk[:-1]))[: len(chunk)]
            if not len(first):
                continue
            # Windows are runs of CHUNKS chunks of one document; only those with words of any weight are looked at.
            of = np.append(np.repeat(np.arange(len(per)), per), np.full(CHUNKS, -1))
            row = np.zeros(len(of), np.int64)
            row[chunk[first]] = np.arange(1, len(first) + 1)
            sums = np.vstack([np.zeros((1, vectors.shape[1]), np.float32), np.add.reduceat(vectors[at[spot]], first, axis=0)])
            start = np.arange(len(of) - CHUNKS)
            same = [np.where(of[start + j] == of[start], start + j, len(of) - 1) for j in range(CHUNKS)]
            start = start[sum(row[s] for s in same) > 0]
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for a in range(0, len(start), 4096):
                part = start[a : a + 4096]
                v = sum(sums[row[same[j][part]]] for j in range(CHUNKS))
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                close = v @ latent.T
                for i, s in zip(*(x.tolist() for x in np.nonzero(close >= cosine)), strict=True):
                    d, k = int(of[part[i]]), int(owner[s])
                    p, c = int(part[i] - base[d]) * CHUNK, float(close[i, s])
                    _keep(best.setdefault((d, k), []), p, c, len(block.words[k]))
            rows = []
            for (d, k), regions in sorted(best.items()):
                size, whole, seen = len(block.words[k]), w.hash[w.first[d] : w.first[d + 1]], []
                for c, lo, hi in regions:
                    lo, hi = max(0, lo), min(len(whole), hi)
                    words = whole[lo:hi].tolist()
                    share = common_subsequence(masks[k], size, words) / size
                    if share >= PARAPHRASE:
                        m = len(block.answers[k])
                        told = common_subsequence(answers[k], m, words) / m if m else None
                        if share >= VERBATIM or (told is not None and told >= ANSWER):
                            seen.append((share, c, told, lo, hi))
                if seen:
                    share, c, told, lo, hi = max(seen, key=lambda x: x[:2])
                    rows.append((ids[d], block.ids[k], c, share, told, lo, hi, hashes[d]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(_FOUND_ARROW, zip(*rows, strict=True), strict=True)], schema=_FOUND_ARROW)

    return docs.mapInArrow(run, _FOUND)


def _keep(regions: list, place: int, cosine: float, size: int) -> None:
    """Add the surroundings of a window to the regions to compare; windows come in order, and overlapping ones are one region."""
    lo, hi = place - size, place + SPAN + size
    if regions and lo <= regions[-1][2] - SPAN - size and hi - regions[-1][1] <= 4 * (SPAN + size):
        c, a, b = regions[-1]
        regions[-1] = (max(c, cosine), a, max(b, hi))
    else:
        regions.append((cosine, lo, hi))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("common", 4).alias("common"), F.round("answer", 4).alias("answer"))
