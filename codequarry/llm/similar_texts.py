"""Near-duplicates by similarity: SimHash links first, then whatever their error budget can't reach, all checked on the whole texts.

Texts whose sets of word shingles have a Jaccard similarity of 0.8 differ in some ten of 64 SimHash bits, up to about 20; a trie prunes
nothing at such a budget. So the trie join of `simhash` links the closest texts at its own budget, and the rest comes from an exact set join:
two sets with a similarity of 0.8 or more share an element among the first n - ceil(0.8 n) + 1 of each, in any order that is the same for
all sets. The order used puts rare shingles first, so that a common passage isn't a candidate by itself; how frequent a shingle is comes
from a sample, which decides on the cost alone and never on the result. Every link is checked on the whole texts.

Texts with the same set are one node. After the SimHash links, a round checks each node against the centre of each of its shingles: of the
nodes that have the shingle, the one with the fewest rarer shingles, which in a group of near copies is the likest to all others. A last
round checks the pairs that are still in different components. So a large group of near copies isn't compared pair by pair.

Before texts meet, a pair's sketches must allow the similarity: bits of the sets' parities, of which two sets differ in no more than in
elements. They leave a small part of the pairs of a family of less similar texts. Texts are read from the documents again, only those
of the pairs that are left, so that the tables of this stage hold none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, record, slices, text_bytes, text_hash, written
from .components import connected_components
from .simhash import DISTANCE, links

SEED, SHINGLE = 42, 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Documents that the frequency of shingles is estimated from, and the most shingles whose frequency is kept.
SAMPLE, FREQUENT = 20_000, 50_000
#: Rows with texts that a Python worker gets at once.
BATCH = 1000
#: The most bits of a sketch; below that it has two to four for each shingle.
WIDEST = 1 << 15


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a UTF-8 text, lower-cased in A-Z, with repeats; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1).view(np.int64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(_hashes(text, shingle))


def _fingerprint(found: np.ndarray) -> int:
    """The SimHash of shingle hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 14):  # bounded memory for long texts
        counts += np.unpackbits(found[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def _sketch(found: np.ndarray) -> bytes:
    """A power of two of bits, each the parity of the number of shingles that fall on it."""
    bits = min(WIDEST, max(64, 1 << (2 * len(found)).bit_length()))
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(one: bytes, other: bytes) -> int:
    """Bits in which two sketches differ: no more than the shingles that are in one set only. The longer one is folded to the other's length."""
    short, long = sorted((one, other), key=len)
    x, bits = int.from_bytes(long, "little"), 8 * len(long)
    while bits > 8 * len(short):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(short, "little")).bit_count()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", text_hash())


def _frequent(docs: DataFrame, shingle: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, ascending, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(t, shingle) for t in text_bytes(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["token"])

    some = _texts(docs).select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // max(1, sample)))) == 0)
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = written(counts.where("n > 2").orderBy(F.desc("n"), "token").limit(most), "frequent")
    rows = kept.orderBy("token").toPandas()
    dropped(kept)
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _keyed(docs: DataFrame, shingle: int, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, text_hash, key (a hash of the set), fp (the SimHash), size, prefix and sketch of every row."""
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())]
    schema = pa.schema(kinds)

    def prefix(found: np.ndarray) -> np.ndarray:
        n = len(found)
        if not n:
            return found
        often = np.zeros(n, np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            often = np.where(tokens[at] == found, counts[at], 0)
        return found[np.argsort(often, kind="stable")[: n - -(-NUM * n // DEN) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            every = [_hashes(t, shingle) for t in text_bytes(b)]
            found, fp = [np.unique(h) for h in every], [_fingerprint(h) for h in every]
            key = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
            first = [prefix(f) for f in found]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield record(
                schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), key=pa.array(key), fp=pa.array(fp, pa.int64()),
                size=pa.array([len(f) for f in found], pa.int64()), prefix=lists, sketch=pa.array(map(_sketch, found), pa.binary()),
            )

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, key long, fp long, size long, prefix array<long>, sketch binary")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sketches (key, size, sketch) don't rule out that their sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(*(b.column(c).to_pylist() for c in ("size", "size_b", "sketch", "sketch_b")), strict=True)
            keep = [i for i, (m, n, one, other) in enumerate(both) if (NUM + DEN) * _apart(one, other) <= (DEN - NUM) * (m + n)]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64())).cast(schema)

    one = pairs.join(nodes.select(F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")), "b")
    two = one.join(nodes.select(F.col("key").alias("a"), "size", "sketch"), "a")
    return two.select("a", "b", "size", "size_b", "sketch", "sketch_b").mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts (key, text) are similar enough, as a table. Texts of no pair are filtered out where they are read."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.int64)
        for b in batches:
            keep = []
            keys = b.column("a").to_pylist()
            for i, key, text, other in zip(range(len(keys)), keys, b.column("text").cast(pa.large_binary()), text_bytes(b, "other"), strict=True):
                if key != last:
                    last, left = key, shingles(text.as_py(), shingle)
                right = shingles(other, shingle)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if DEN * both >= NUM * (len(left) + len(right) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64())).cast(schema)

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = written(texts.join(keys, "key", "left_semi"), "asked")
    one = pairs.join(asked.select(F.col("key").alias("b"), F.col("text").alias("other")), "b")
    two = one.join(asked.select(F.col("key").alias("a"), "text"), "a")
    out = written(two.select("a", "b", "text", "other").mapInArrow(run, "a long, b long"), "similar", BATCH)
    dropped(asked)
    return out


def _components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (key) with `of`, the component of each key over edges."""
    known = connected_components(edges).withColumnRenamed("node", "key")
    return rows.join(known, "key", "left").withColumn("of", F.coalesce("component", "key")).drop("component")


def similar_texts(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, text_hash, component_id, first for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over pairs of texts whose sets of shingles have a Jaccard similarity of NUM / DEN or
    more, the document's own included; first marks the one document of a component that has this doc_id and, if that has several texts
    there, the smallest text_hash. Rows alike in doc_id and text are one document. Texts without words, null ones too, are alike. A row
    without doc_id links nothing, has no component and is first. An empty table gives an empty result. distance: the bits by which
    SimHash links may differ; it decides on the cost alone.
    """
    rows = written(_keyed(docs, shingle, *_frequent(docs, shingle, sample, frequent)), "shingled", BATCH)
    counts = rows.where("doc_id IS NOT NULL").groupBy("key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("first"))
    nodes = written(nodes.select("key", F.struct("first.doc_id", "first.text_hash").alias("lead"), "first.n"), "nodes")
    # One row for each key; what few keys have whose leading row occurs several times is all that is shuffled for that.
    leads = rows.join(nodes.select("key", "lead.*", "n"), ["doc_id", "key", "text_hash"]).select("key", "fp", "size", "prefix", "sketch", "n")
    mine = written(leads.where("n = 1").unionByName(leads.where("n > 1").dropDuplicates(["key"])).drop("n"), "sets")
    ids = written(rows.select("doc_id", "text_hash", "key"), "keys")
    dropped(rows)
    texts = _texts(docs).join(nodes.select("key", "lead.*"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "key").agg(F.min("text").alias("text")).select("key", "text")

    def checked(pairs: DataFrame) -> DataFrame:
        left = written(_likely(pairs, mine), "likely", BATCH)
        found = _similar(left, texts, shingle)
        dropped(left)
        return found

    codes = written(mine.groupBy("fp").agg(F.min("key").alias("node")), "codes")
    equal = mine.select("key", "fp").join(codes, "fp").where("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    near = checked(equal.unionByName(links(codes, distance)).distinct())

    # Size and place in one number, which is all that the only large shuffle carries besides token and key.
    spread = mine.select("key", "size", F.posexplode("prefix").alias("pos", "token")).select("token", "key", (F.shiftleft("size", 32) + F.col("pos")).alias("at"))
    # A shingle's centre: the node with the fewest rarer shingles, for its size.
    rarer = F.expr("(at & 4294967295) / shiftright(at, 32)")
    group = Window.partitionBy("token")
    index = spread.withColumns({"low": F.min(F.struct(rarer.alias("rarer"), "key", "at")).over(group), "m": F.min("key").over(group), "n": F.max("key").over(group)}).where("m < n")
    place = {"size": F.shiftright("at", 32), "pos": F.expr("at & 4294967295"), "size_b": F.shiftright("low.at", 32), "pos_b": F.expr("low.at & 4294967295")}
    index = written(index.select("token", "key", F.col("low.key").alias("low"), *[c.alias(n) for n, c in place.items()]), "prefixes")
    # No more elements can be shared than are left behind a shared one, and the first shared one must leave enough.
    enough = f"{NUM + DEN} * least(size - pos, size_b - pos_b) >= {NUM} * (size + size_b)"

    star = index.where(f"key <> low AND {enough}").select(F.greatest("key", "low").alias("a"), F.least("key", "low").alias("b")).distinct()
    named = _components(star.select(F.col("a").alias("key"), "b"), near).select(F.col("key").alias("a"), F.col("of").alias("of_a"), F.col("b").alias("key"))
    near = near.unionByName(checked(_components(named, near).where("of_a <> of").select("a", F.col("key").alias("b"))))
    part = written(_components(index.select("token", "key", "size", "pos"), near), "prefixes")
    dropped(index)
    open_ = part.groupBy("token").agg(F.min("of").alias("m"), F.max("of").alias("n")).where("m < n").select("token")
    left = part.join(open_, "token", "left_semi")
    right = left.select("token", F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"), F.col("of").alias("of_b"))
    pairs = written(left.join(right, "token").where(f"key < b AND of <> of_b AND {enough}").select(F.col("key").alias("a"), "b").distinct(), "pairs")
    dropped(part)
    more = checked(pairs)
    dropped(mine)

    named = _components(nodes.drop("n"), near.unionByName(more))
    lowest = named.groupBy("of").agg(F.min("lead").alias("lowest"))
    ids = ids.join(named.join(lowest, "of").select("key", "lowest"), "key", "left")
    known = F.col("doc_id").isNotNull()
    out = ids.select(
        "doc_id", "text_hash", F.when(known, F.col("lowest.doc_id")).alias("component_id"),
        (~known | (F.struct("doc_id", "text_hash") == F.col("lowest"))).alias("first"),
    )
    return written(out, "components")
