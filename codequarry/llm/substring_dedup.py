"""Repeated passages: fixed-block anchors, probed by every rolling window and extended to maximal exact repeats.

Index: every document's text is cut into blocks of BLOCK words at positions 0, BLOCK, 2 * BLOCK ... Probe: every run of BLOCK words
of every document. A run of `window` >= 2 * BLOCK - 1 words always holds a whole block of each document it occurs in, so a repeated
window shows up as an anchor: a probe that meets a block of another document. Extension: the windows around the anchors, and those
alone, are compared over their full width, by 96 bits of hash; neighbouring repeats join into one maximal span.

Three steps pass data on, each dealt evenly by hash: (1) probes and blocks by their hash; (2) anchors back to their documents, which
gives the windows to compare; (3) repeats back to their rows. What goes from a task to a bucket is one row of plain binary columns, made
and read in bulk, so that the work for a word is the same whatever the number of buckets.

A passage that very many documents share doesn't gather in one bucket. Only the smallest and the largest doc_id of a hash count, so a task
settles what it can by itself, remembers the ends of frequent hashes, and sends on one document for each end and what is still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, slices, table, text_bytes, written
from .words import Words, windows

WINDOW, BLOCK = 13, 7
#: Text bytes for each bucket of hashes and for each group of documents; both counts follow the input.
BUCKET_BYTES, GROUP_BYTES = 6 << 20, 4 << 20
#: Entries of a hash in one piece of text from which on a task remembers its ends.
_FREQUENT = 16
_NEVER = np.iinfo(np.int64).max

#: Entries for a key. By run of one document, in steps from run to run: doc and ref, their low 16 bits apart, and the number n of entries.
#: By entry: h, and place as steps inside a run, in three parts. Small steps leave zeros together, which a shuffle compresses.
_PACKED = pa.schema([("key", pa.int32()), *[(c, pa.binary()) for c in ("h", "doc", "doc_high", "ref", "ref_high", "n", "place", "place_mid", "place_high")]])
_PACKED_DDL = ", ".join(["key int", *[f"{c} binary" for c in _PACKED.names[1:]]])


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for the entries between neighbouring cuts."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values.view(np.uint8).reshape(-1))])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _steps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences, modulo 2**64, of neighbours; at the indexes `at` the value itself."""
    v = values.astype(np.uint64)
    out = np.append(v[:1], v[1:] - v[:-1])
    out[at] = v[at]
    return out


def _unsteps(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.uint64)
    return (total - np.repeat(total[at] - steps[at], np.diff(np.append(at, len(steps))))).view(np.int64)


def _packed(key: np.ndarray, h: np.ndarray, doc: np.ndarray, ref: np.ndarray | None, place: np.ndarray) -> pa.RecordBatch:
    """A row for each key; key must be in runs. h: an array of bytes an entry."""
    rows, runs = _starts(key), _starts(key, doc, *([] if ref is None else [ref]))
    runs = np.flatnonzero((np.arange(len(key)) - np.repeat(runs, np.diff(np.append(runs, len(key))))) % 255 == 0)
    cuts = np.append(rows, len(key))
    of_runs = np.searchsorted(runs, cuts)
    halves = []
    for x in (doc, ref):
        x = np.zeros((len(runs), 4), "<u2") if x is None else _steps(x[runs], of_runs[:-1]).reshape(-1, 1).view("<u2")
        halves += [_binary(x[:, :1], of_runs), _binary(x[:, 1:], of_runs)]
    n = np.diff(np.append(runs, len(key))).astype(np.uint8)
    step = _steps(place, runs)
    parts = [_binary((step >> np.uint64(k)).astype(kind), cuts) for k, kind in ((0, np.uint8), (8, np.uint8), (16, "<u2"))]
    return pa.RecordBatch.from_arrays([pa.array(key[rows], pa.int32()), _binary(h, cuts), *halves, _binary(n, of_runs), *parts], schema=_PACKED)


def _raw(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All bytes of a binary column, one value after another, as numbers."""
    parts = []
    for c in column.chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        if data is not None and ends[-1] > ends[0]:
            parts.append(memoryview(data)[ends[0] : ends[-1]])
    return np.frombuffer(b"".join(parts), kind)


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, ref, place of each entry."""
    n = _raw(rows.column("n"), np.uint8).astype(np.int64)
    sizes = np.array(pc.binary_length(rows.column("n")), np.int64)
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = []
    for c in ("doc", "ref"):
        x = np.concatenate([_raw(rows.column(c), "<u2").reshape(-1, 1), _raw(rows.column(f"{c}_high"), "<u2").reshape(-1, 3)], axis=1)
        out.append(np.repeat(_unsteps(np.ascontiguousarray(x).view(np.uint64)[:, 0], at), n))
    step = sum(_raw(rows.column(c), kind).astype(np.uint64) << np.uint64(k) for c, kind, k in (("place", np.uint8, 0), ("place_mid", np.uint8, 8), ("place_high", "<u2", 16)))
    return *out, _unsteps(step, np.cumsum(n) - n) & 0xFFFFFFFF  # a step may go back


def _to_groups(group: np.ndarray, doc: np.ndarray, ref: np.ndarray | None, place: np.ndarray) -> pa.RecordBatch:
    """Places, without hashes, dealt to the groups of their documents."""
    order = np.lexsort((place, doc, group) if ref is None else (place, ref, doc, group))
    return _packed(group[order], np.zeros((len(order), 0), np.uint8), doc[order], None if ref is None else ref[order], place[order])


def _settled(h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Anchors: probes with a block of a smaller document, and blocks with a probe of a larger one. Every block is a probe too.

    Returns which entries are anchors; indexes of one entry for each end of a hash that has several entries (the smallest document with
    a block, the largest document); and of these hashes: hash, both ends, number of entries.
    """
    order = np.argsort(h)
    at = _starts(h[order])
    sizes = np.diff(np.append(at, len(h)))
    several = np.repeat(sizes > 1, sizes)
    entry, sizes = order[several], sizes[sizes > 1]
    done = np.zeros(len(h), bool)
    if not len(entry):
        none = np.zeros(0, np.int64)
        return done, none, (np.zeros(0, h.dtype), none, none, none)
    at = np.cumsum(sizes) - sizes
    d, b, of = doc[entry], block[entry], np.repeat(np.arange(len(sizes)), sizes)
    low, high = np.minimum.reduceat(np.where(b, d, _NEVER), at), np.maximum.reduceat(d, at)
    done[entry] = (low[of] < d) | b & (high[of] > d)
    ends = [np.flatnonzero(x) for x in (b & (d == low[of]), d == high[of])]
    ends = np.concatenate([entry[x[_starts(of[x])]] for x in ends])
    return done, ends, (h[entry[at]], low, high, sizes)


class _Frequent:
    """Both ends of the hashes that were frequent in what a task has read so far."""

    def __init__(self):
        self.h, self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(self, h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries are anchors, and which must be sent on."""
        n, known = len(h), self.low < _NEVER
        both = np.concatenate([h, self.h[known], self.h])
        done, ends, (hashes, low, high, sizes) = _settled(
            both, np.concatenate([doc, self.low[known], self.high]), np.concatenate([block, np.ones(known.sum(), bool), np.zeros(len(self.h), bool)])
        )
        send = ~done[:n]
        send[ends[ends < n]] = True
        keep = (sizes >= _FREQUENT) | np.isin(hashes, self.h)
        rest = ~np.isin(self.h, hashes)
        self.h, self.low, self.high = (np.concatenate(x) for x in ((self.h[rest], hashes[keep]), (self.low[rest], low[keep]), (self.high[rest], high[keep])))
        return done[:n], send


def _probes(piece: pa.RecordBatch, frequent: _Frequent, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """All probes of a piece (doc_id, text) that other tasks must see, by bucket, and the anchors found here, without hashes."""
    w = Words(text_bytes(piece))
    n = np.diff(w.first)
    of, place = w.doc(), w.place()
    at = np.flatnonzero((place + BLOCK <= n[of]) & (n[of] >= window))
    if not len(at):
        return
    h, doc, place = windows(w.hash, BLOCK)[at], piece.column("doc_id").to_numpy()[of[at]], place[at]
    done, send = frequent.settle(h, doc, place % BLOCK == 0)
    yield from _dealt(h[send], doc[send], place[send], buckets)
    if done.any():  # these pass the buckets by, dealt at random
        key = np.full(done.sum(), int(h[0] % np.uint64(buckets)), np.int32)
        yield _packed(key, np.zeros((len(key), 0), np.uint8), doc[done], None, place[done])


def _dealt(h: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries by bucket, with 32 bits of their hashes besides."""
    if len(h):
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        yield _packed(bucket[order], h[order].astype("<u4"), doc[order], None, place[order])


def _anchors(rows: pa.Table, groups: int) -> pa.Table:
    """All anchors of a bucket, by group."""
    open_ = pc.greater(pc.binary_length(rows.column("h")), 0)
    doc, _, place = _entries(rows.filter(pc.invert(open_)))
    rows = rows.filter(open_)
    d, _, p = _entries(rows)
    done, _, _ = _settled(_raw(rows.column("h"), "<u4"), d, p % BLOCK == 0)
    doc, place = np.append(doc, d[done]), np.append(place, p[done])
    return pa.Table.from_batches([_to_groups((doc % groups).astype(np.int32), doc, None, place)])


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same hash. h: twelve bytes an entry."""
    first, second = np.ascontiguousarray(h[:, :8]).view("<u8")[:, 0], np.ascontiguousarray(h[:, 8:]).view("<u4")[:, 0]
    order = np.lexsort((second, first))
    at = _starts(first[order], second[order])
    out = np.zeros(len(h), bool)
    if len(at):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.append(at, len(h)))) < doc[order]
    return out


def _repeats(rows: pa.Table) -> pa.Table:
    """Windows whose hash a smaller document has too, by group."""
    doc, ref, place = _entries(rows)
    keep = _later(_raw(rows.column("h"), np.uint8).reshape(-1, 12), doc)
    return pa.Table.from_batches([_to_groups((ref[keep] >> 32).astype(np.int32), doc[keep], ref[keep], place[keep])])


class _Places:
    """Places by number (doc or ref), from packed rows."""

    def __init__(self, rows: pa.Table, by: str):
        doc, ref, place = _entries(rows)
        of = doc if by == "doc" else ref
        order = np.lexsort((place, of))
        self.place, of = place[order], of[order]
        at = _starts(of)
        self.of = dict(zip(of[at].tolist(), zip(at.tolist(), np.append(at, len(of))[1:].tolist(), strict=True), strict=True))

    def __call__(self, number: int) -> np.ndarray:
        a, b = self.of.get(number, (0, 0))
        return self.place[a:b]


_HEAD = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.binary())])
_KIND_ARROW = pa.schema([*_HEAD, *_PACKED])
_KIND = "kind int, doc_id long, row long, n_words long, sha string, text binary, " + _PACKED_DDL
#: Kinds of rows: a document without an anchor (done), the text of another one, windows to compare, windows known to be repeats.
_CLEAN, _TEXT, _LOOK, _REPEAT = 0, 1, 2, 3


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _compare(key: int, docs: pa.Table, anchors: pa.Table, window: int, buckets: int) -> pa.Table:
    """Rows of all kinds for the documents of a group. A row's number is the group's and its own inside the group."""
    found, rows, out = _Places(anchors, "doc"), [], []

    def entries(kind: int, batch: pa.RecordBatch) -> None:
        head = [pa.array(np.full(batch.num_rows, kind, np.int32)), *[pa.nulls(batch.num_rows, f.type) for f in list(_HEAD)[1:]]]
        out.append(pa.RecordBatch.from_arrays([*head, *batch.columns], schema=_KIND_ARROW))

    number = (key << 32) - 1
    for piece in slices(iter(docs.combine_chunks().to_batches()), most_bytes=1 << 19):
        some: list[tuple[int, int, bytes, np.ndarray]] = []
        for d, t in zip(piece.column("doc_id").to_pylist(), text_bytes(piece), strict=True):
            number += 1
            at = found(d)
            if len(at):
                some.append((d, number, t or b"", at))
            else:
                rows.append((_CLEAN, d, number, len(w := (t or b"").split()), _sha(w), None))
        if not some:
            continue
        w = Words([t for _, _, t, _ in some])
        n, of, place = np.diff(w.first), w.doc(), w.place()
        seen = np.zeros(len(w.hash) + 1, np.int64)
        for first, size, (*_, at) in zip(w.first[:-1].tolist(), n.tolist(), some, strict=True):
            seen[first + at[at + BLOCK <= size] + 1] = 1  # anchors of another text with the same doc_id may lie beyond the end
        seen = np.cumsum(seen)
        at = np.flatnonzero(place + window <= n[of])
        at = at[seen[at + window - BLOCK + 1] > seen[at]]
        first = windows(w.hash, window)[at]
        h = np.concatenate([x.reshape(-1, 1).view(np.uint8) for x in (first, windows(w.second(), window)[at].astype("<u4"))], axis=1)
        doc, ref, place = np.array([d for d, *_ in some], "<i8")[of[at]], np.array([r for _, r, *_ in some], "<i8")[of[at]], place[at]
        later = _later(h, doc)
        entries(_REPEAT, _to_groups(np.full(later.sum(), key, np.int32), doc[later], ref[later], place[later]))
        h, doc, ref, place = h[~later], doc[~later], ref[~later], place[~later]
        bucket = (first[~later] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        entries(_LOOK, _packed(bucket[order], h[order], doc[order], ref[order], place[order]))
        compared = np.zeros(len(some), bool)
        compared[of[at]] = True
        for (d, r, t, _), size, yes in zip(some, n.tolist(), compared.tolist(), strict=True):
            rows.append((_TEXT, d, r, size, None, t) if yes else (_CLEAN, d, r, size, _sha(t.split()), None))
    if rows:
        heads = [pa.array(c, f.type) for f, c in zip(_HEAD, zip(*rows, strict=True), strict=True)]
        out.append(pa.RecordBatch.from_arrays([*heads, *[pa.nulls(len(rows), f.type) for f in _PACKED]], schema=_KIND_ARROW))
    return pa.Table.from_batches(out, schema=_KIND_ARROW)


_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string, text binary"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_DONE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN)), ("kept", pa.string()), ("text", pa.binary())])


def _cut(docs: pa.Table, repeats: pa.Table, window: int, keep_text: bool) -> pa.Table:
    """Join repeated windows to maximal spans and take their words out."""
    found, out = _Places(repeats, "ref"), []
    for d, row, n, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "row", "n_words", "text")), strict=True):
        words, at = text.split(), found(row)
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
        gone = np.cumsum(steps[:-1]) > 0
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
        spans = [{"start": a, "end": b} for a, b in edges]
        out.append((d, n, int(gone.sum()), _sha(kept), spans, b" ".join(kept).decode() if keep_text and spans else None, text if keep_text and spans else None))
    return pa.Table.from_arrays([pa.array(c, f.type) for f, c in zip(_DONE_ARROW, zip(*out, strict=True), strict=True)] if out else [pa.array([], f.type) for f in _DONE_ARROW], schema=_DONE_ARROW)


def _prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def repeated_passages(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """What to remove from every row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (removed word ranges, half open,
    maximal) and, if keep_text, kept (the kept words joined by one space) and text (the UTF-8 bytes of the whole text), both null where
    nothing goes. A word goes if a window of `window` consecutive words over it also starts in a document with a smaller doc_id. Null and
    empty texts have no words. Texts shorter than a window stay whole. Rows with one doc_id aren't repeats of each other; each is cut by
    its own words. Rows without doc_id stay whole and remove nothing. Every row of docs gives one row; an empty table gives none.
    """
    if window < 2 * BLOCK - 1:
        raise ValueError(f"a window needs at least {2 * BLOCK - 1} words")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = _prime(max(8, size // BUCKET_BYTES)), _prime(max(8, size // GROUP_BYTES))
    known = docs.where("doc_id IS NOT NULL")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for piece in slices(batches):
            yield from _probes(piece, frequent, window, buckets)

    anchors = known.mapInArrow(probes, _PACKED_DDL).groupBy("key").applyInArrow(lambda t: _anchors(t, groups), _PACKED_DDL)
    anchors = written(anchors, "anchors")
    keyed = known.withColumn("key", F.pmod("doc_id", F.lit(groups)).cast("int"))
    looked = keyed.groupBy("key").cogroup(anchors.groupBy("key")).applyInArrow(lambda k, a, b: _compare(k[0].as_py(), a, b, window, buckets), _KIND)
    looked = written(looked, "compared")
    dropped(anchors)
    repeats = looked.where(F.col("kind") == _LOOK).select(*_PACKED.names).groupBy("key").applyInArrow(_repeats, _PACKED_DDL)
    repeats = repeats.unionByName(looked.where(F.col("kind") == _REPEAT).select(*_PACKED.names))
    left = looked.where(F.col("kind") == _TEXT).select("doc_id", "row", "n_words", "text", F.shiftright("row", 32).cast("int").alias("key"))
    done = left.groupBy("key").cogroup(repeats.groupBy("key")).applyInArrow(lambda a, b: _cut(a, b, window, keep_text), _DONE)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in text_bytes(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words])], names=["doc_id", "n_words", "sha"])

    clean = looked.where(F.col("kind") == _CLEAN).select("doc_id", "n_words", "sha")
    clean = clean.unionByName(docs.where("doc_id IS NULL").mapInArrow(whole, "doc_id long, n_words long, sha string"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    clean = clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("spans"), F.lit(None).cast("string").alias("kept"), F.lit(None).cast("binary").alias("text"))
    return done.unionByName(clean)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))
