"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join over a binary trie.

The join walks pairs of trie nodes together from the root. A step takes both nodes one bit down; where the bits differ, the pair
spends one unit of its error budget, and a pair that has overspent goes with everything below it. Nodes are ranges of the sorted
fingerprints of a task, and all pairs of a level advance in a few numpy operations.

The trie is dealt over tasks by blocks: 64 bits make `distance + 1` blocks, and two fingerprints within `distance` agree in at least
one block. So for each block the fingerprints are turned to put that block on top, and a task owns the subtries below some values of
it. A subtrie with very many fingerprints is dealt once more, by pairs of its nodes a few bits down. A task returns a
forest over the fingerprints it linked, which has the same components as all the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, slices, table, text_bytes, written
from .components import connected_components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: A subtrie with more fingerprints than this is dealt by pairs of nodes SPLIT bits down.
HOT, SPLIT = 100_000, 6
#: Pairs of nodes that advance together.
_FRONTIER = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text (null: none), lower-cased in A-Z, over its word shingles with repeats."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 14):  # bounded memory for long texts
        spans = zip(starts[i : i + (1 << 14)].tolist(), ends[i : i + (1 << 14)].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(b)], np.uint64).view(np.int64)
            yield record(schema, doc_id=b.column("doc_id").cast(pa.int64()), fp=pa.array(fp))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _roots(label: np.ndarray) -> np.ndarray:
    while (label != (up := label[label])).any():
        label = up
    return label


def trie_pairs(code: np.ndarray, bits: int, frontier: tuple, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes within `budget` differing bits, by walking pairs of trie nodes.

    code: ascending inside every range that the frontier names; the walk looks at its lowest `bits` bits. frontier: arrays (a, b, c,
    d, spent): the nodes [a, b) and [c, d), the same range for a node with itself, and the budget spent so far.
    """
    ones = [np.append(0, np.cumsum(code >> bit & 1)) for bit in range(bits)]
    todo = [(bits, frontier)]
    while todo:
        level, front = todo.pop()
        if len(front[0]) > _FRONTIER:
            half = len(front[0]) // 2
            todo += [(level, tuple(x[half:] for x in front)), (level, tuple(x[:half] for x in front))]
            continue
        a, b, c, d, spent = front
        if level:
            single = (b - a == 1) & (d - c == 1)
        else:
            single = np.ones(len(a), bool)
        if single.any():
            i, j, same = a[single], c[single], a[single] == c[single]
            if level:
                i, j, s = i[~same], j[~same], spent[single][~same]
                rest = (code[i] ^ code[j]) & ((1 << level) - 1)
                near = s + np.bitwise_count(rest) <= budget
                yield i[near], j[near]
            else:
                yield i[~same], j[~same]
            a, b, c, d, spent = (x[~single] for x in front)
        if not len(a):
            continue
        level -= 1
        n = ones[level]
        ab, cd = b - (n[b] - n[a]), d - (n[d] - n[c])  # zeros first
        own, parts = a == c, []
        for x, y, z, w, cost, who in ((a, ab, c, cd, 0, None), (ab, b, cd, d, 0, None), (a, ab, cd, d, 1, None), (ab, b, c, cd, 1, ~own)):
            keep = (y > x) & (w > z) & (spent + cost <= budget)
            if who is not None:
                keep &= who  # a node with itself meets its two children once
            if cost == 0:
                keep &= ~(own & (y - x == 1))
            parts.append((x[keep], y[keep], z[keep], w[keep], spent[keep] + cost))
        todo.append((level, tuple(np.concatenate(p) for p in zip(*parts, strict=True))))


def forest(group: np.ndarray, code: np.ndarray, side: np.ndarray, spent: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with the same components as the links inside each group: at most one pair for each row. Rows are sorted by (group, side, code).

    side: 0 and 1 for a pair of nodes (only links across count), -1 for one node with itself. spent: budget spent by the pair.
    """
    turn = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
    ends = np.append(turn[1:], len(group))
    alone = side[turn] < 0
    left = np.flatnonzero((side[turn] == 0) & np.append((side[turn][1:] == 1) & (group[turn][1:] == group[turn][:-1]), False))
    a, b = np.append(turn[alone], turn[left]), np.append(ends[alone], ends[left])
    c, d = np.append(turn[alone], turn[left + 1] if len(left) else []).astype(np.int64), np.append(ends[alone], ends[left + 1] if len(left) else []).astype(np.int64)
    keep = ~((a == c) & (b - a == 1))
    front = tuple(x[keep] for x in (a, b, c, d)) + (spent[a[keep]].astype(np.int64),)
    label, out = np.arange(len(code)), []
    for i, j in trie_pairs(code, bits, front, budget):
        while True:
            i, j = label[i], label[j]
            keep = i != j
            if not keep.any():
                break
            i, j = np.maximum(i[keep], j[keep]), np.minimum(i[keep], j[keep])
            best = np.full(len(label), len(label))
            np.minimum.at(best, i, j)
            who = np.unique(i)
            out.append((who, best[who]))
            label[who] = best[who]
            label = _roots(label)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(codes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of distinct fingerprints within `distance` bits. codes: fp, node."""
    blocks = distance + 1
    width = 64 // blocks  # the last block also takes what is left
    low = 64 - width
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    turned = [
        F.struct(
            F.lit(k).alias("block"),
            F.expr(f"shiftrightunsigned(turned, {low})").alias("top"),
            F.expr(f"turned & {(1 << low) - 1}L").alias("code"),
        )
        for k in range(blocks)
    ]
    rows = None
    for k, made in enumerate(turned):
        turn = F.expr(f"shiftleft(fp, {k * width}) | shiftrightunsigned(fp, {64 - k * width})") if k else F.col("fp")
        part = codes.withColumn("turned", turn).select(made.alias("x"), "node").select("x.*", "node")
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("block", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block", "top", F.lit(True).alias("hot"))
    # At most blocks * 2**width keys: bounded whatever the data.
    rows = rows.join(F.broadcast(sizes), ["block", "top"], "left")
    prefix = F.shiftrightunsigned("code", low - SPLIT)
    near = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT) if m.bit_count() <= distance])
    rows = rows.withColumn("own", prefix).withColumn("flip", F.explode(F.when(F.col("hot"), near).otherwise(F.array(F.lit(-1).cast("long")))))
    other = F.col("own").bitwiseXOR(F.col("flip"))
    rows = rows.select(
        F.struct(
            "block", "top", F.when(F.col("flip") < 0, -1).otherwise(F.least("own", other)).alias("p"), F.when(F.col("flip") < 0, -1).otherwise(F.greatest("own", other)).alias("q")
        ).alias("key"),
        F.when(F.col("flip") <= 0, -1).when(F.col("own") < other, 0).otherwise(1).alias("side"),
        F.when(F.col("flip") < 0, 0).otherwise(F.bit_count("flip")).alias("spent"),
        "code",
        "node",
    ).select(F.xxhash64("key").alias("cell"), "key.*", "side", "spent", "code", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            *keys, side, spent, code, node = cols
            turns = np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0))
            group, out = np.cumsum(turns), [np.zeros((2, 0), np.int64)]
            for flag in (False, True):  # what was split has budget spent, and the split bits are behind it
                pick = (keys[2] >= 0) == flag
                if pick.any():
                    bits = low - SPLIT if flag else low
                    i, j = forest(group[pick], code[pick] & ((1 << bits) - 1), side[pick], spent[pick], bits, distance)
                    out.append(np.stack([node[pick][i], node[pick][j]]))
            out = np.concatenate(out, axis=1)
            return record(schema, a=pa.array(out[0]), b=pa.array(out[1]))

        for b in batches:
            cols = [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("block", "top", "p", "q", "side", "spent", "code", "node")]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            last = np.all([k == k[-1] for k in cols[:4]], axis=0) if len(cols[0]) else np.zeros(0, bool)
            cut = len(last) - (np.argmin(last[::-1]) if not last.all() else len(last))  # the last cell may go on
            held = [c[cut:] for c in cols]
            if cut:
                yield flush([c[:cut] for c in cols])
        if held and len(held[0]):
            yield flush(held)

    dealt = rows.repartition("cell").sortWithinPartitions("block", "top", "p", "q", "side", "code")
    return dealt.select("block", "top", "p", "q", "side", "spent", "code", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most `distance` differing bits, the document's own included.
    Null and empty texts have fingerprint zero, linked like any other. Repeated rows give repeated rows. A row without doc_id has a
    fingerprint, links nothing and has no component. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    codes = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "codes")
    found = connected_components(links(codes, distance, hot))
    named = codes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = fps.join(named, "fp", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
