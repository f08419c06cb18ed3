"""SentencePiece BPE by backtracking: exact merge-type encoding without a merge queue over the text, and decoding.

A sequence of pieces is the model's encoding exactly if each piece encodes to itself and each adjacent pair re-merges to itself. So an
encoder can take the longest piece at each position (a trie of the pieces gives it), keep it if it is compatible with the piece before
it, else try the next shorter prefix, and step back where none is left; positions from which nothing works are marked, so that each is
given up once. Compatibility of two pieces comes from merging their joined text again, and is remembered.

Texts are cut where no piece of the vocabulary reaches across: before a word mark that follows another character, and between two
characters of which no chain of neighbours in pieces leads from one to the other, such as a letter and a comma. Encodings of such units
are remembered, up to a bound. Spaces stand for word marks, so that texts of Latin letters keep one byte for each character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

MARK = "▁"
#: Remembered units and pairs of one worker, twice: those used since the last clearing, and those from before.
REMEMBERED = 300_000
#: Longer units are not remembered.
SHORT = 64


class Remembered(dict):
    """Values by key, worked out when first asked for. When full, all become the older half, which goes when the next one is full."""

    def __init__(self, work_out: Callable):
        self.work_out, self.older = work_out, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work_out(key)
            if len(key) >= SHORT:
                return value
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Matches the units of a text one after the other: word marks and the characters after them that pieces can join."""
    if any(" " in p.lstrip(" ") for p in pieces):
        return re.compile("(?s).+")
    joined: dict[str, set[str]] = {}
    for a, b in {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}:
        if a != " ":
            both = joined.get(a, {a}) | joined.get(b, {b})
            joined |= dict.fromkeys(both, both)
    kinds = sorted({min(s): s for s in joined.values()}.values(), key=lambda s: (-len(s), min(s)))
    runs = [f"[{''.join(map(re.escape, sorted(s)))}]+" for s in kinds]
    return re.compile(f" *(?:{'|'.join([*runs, '[^ ]'])})| +")


class PieceModel:
    """The vocabulary of a SentencePiece BPE model file: identity normalisation, a leading mark, byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation, a leading mark and byte fallback are supported")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p.piece.replace(MARK, " "): (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p: score for p, (_, score) in normal.items()}
        byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {str(i): b"" for i in range(len(model.pieces))} | {str(i): p.encode() for p, (i, _) in normal.items()} | {str(i): bytes([b]) for b, i in byte_id.items()}
        self.id = {p: str(i) for p, (i, _) in normal.items()}
        self.byte_id = {b: str(i) for b, i in byte_id.items()}
        self.units = unit_pattern(normal)
        self.known = Remembered(self.unit_ids)
        self.pairs = Remembered(lambda pair: self.merged(pair[0] + pair[1]) == list(pair))
        self.shorter = Remembered(self.prefix)
        self.trie = ahocorasick.Automaton()
        self.most = 1
        for p in normal:
            if len(p) == 1 or self.merged(p) == [p]:  # a piece that merging can't make is never used
                self.trie.add_word(p, p)
                self.most = max(self.most, len(p))

    def merged(self, text: str) -> list[str]:
        """Merge adjacent parts of a short text, the best-scored first and the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def prefix(self, piece: str) -> str:
        """The longest shorter piece that `piece` starts with, or nothing."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.trie), "")

    def longest(self, text: str) -> str:
        """The longest piece that a text starts with, or its first character."""
        found = text[: self.trie.longest_prefix(text)]
        return found if found in self.trie else self.shorter[found] or text[0]

    def unit(self, text: str) -> list[str]:
        """The pieces of one unit; a character outside the vocabulary is a part of its own."""
        if text in self.trie:
            return [text]
        pairs, shorter, longest, most = self.pairs, self.shorter, self.longest, self.most
        out: list[str] = []
        failed: set[int] = set()
        pos, size, last = 0, len(text), ""
        part = longest(text[:most])
        while True:
            end = pos + len(part)
            if end not in failed and (not last or pairs[last, part]):
                out.append(part)
                if end == size:
                    return out
                pos, last = end, part
                part = longest(text[pos : pos + most])
                continue
            part = shorter[part]
            if not part:
                failed.add(pos)
                part = out.pop()
                pos -= len(part)
                last = out[-1] if out else ""

    def unit_ids(self, text: str) -> str:
        """Ids of one unit as decimal text joined by commas; a character outside the vocabulary has those of its bytes."""
        known = self.id
        return ",".join([known[p] if p in known else ",".join([self.byte_id[b] for b in p.replace(" ", MARK).encode()]) for p in self.unit(text)])

    def encode(self, text: str) -> str:
        """Ids of a text as decimal text joined by commas."""
        if not text:
            return ""
        return ",".join(map(self.known.__getitem__, self.units.findall(" " + text.replace(MARK, " "))))

    def decode(self, ids: str) -> str:
        """Text of ids joined by commas: marks become spaces, the leading one goes, bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.split(",")))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def public_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text of docs (doc_id, text; other columns are ignored) and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and what keep names of ids (array<int>) and decoded. Null and empty texts have no ids
    and decode to the empty text. Rows come out one for one, repeated rows and null ids included.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    more = {"ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string")}
    fields += [(k, more[k][0]) for k in keep]
    schema = pa.schema(fields)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                ids = m.encode((t or b"").decode("utf-8", "replace"))
                back = m.decode(ids)
                full = {"ids": np.fromstring(ids, np.int32, sep=",") if "ids" in keep and ids else [], "decoded": back}
                rows.append((d, ids.count(",") + bool(ids), sha(ids), sha(back), *(full[k] for k in keep)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {more[k][1]}" for k in keep)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_path(), keep=())
