"""Calls of embedding and summary models from tasks: each task sends its own batches; a failed task sends them again."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ErrorCode, QuarryError
from .vectors import l2_normalised

#: Texts to vectors of one width, in order. Instances are pickled to the tasks.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: A unit's name and text to a summary; empty where no model is set.
Summariser = Callable[[str, str], str]

PROMPT = "Say in one or two sentences what the code of `{name}` does and what it is for, without its signature or comments.\n\n{text}\n"


def _post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding service that answers POST {base}/embeddings with data: [{index, embedding}]."""

    base: str
    model: str
    key: str | None = None
    timeout: float = 30

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        data = _post(f"{self.base.rstrip('/')}/embeddings", {"model": self.model, "input": list(texts)}, self.key, self.timeout)["data"]
        vectors = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        return [v[0] if v and isinstance(v[0], list) else v for v in vectors]


@dataclass(frozen=True)
class HttpSummariser:
    """A chat service that answers POST {base}/chat/completions; without base and model every summary is empty."""

    base: str | None = None
    model: str | None = None
    key: str | None = None
    temperature: float = 0.0
    timeout: float = 300

    def __call__(self, name: str, text: str) -> str:
        if not (self.base and self.model):
            return ""
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": PROMPT.format(name=name, text=text)}]}
        return _post(f"{self.base.rstrip('/')}/chat/completions", body, self.key, self.timeout)["choices"][0]["message"]["content"].strip()


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the tokens that mask keeps: hidden is (text, token, width), mask (text, token). All masked: zeros."""
    return (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


def pooled(rows: DataFrame, group: str, vec: str = "vec", mask: str | None = None) -> DataFrame:
    """group, vec, n: for each group (null is one like others) the mean of its vectors that mask keeps, as mean_pooled() has it, and how many
    rows it has. mask is a number or a truth value, null as none; without it all count. Null vectors, and those with a null component, don't.

    Sums are made within each task, a row for each group, and added up from there: a group of most rows is summed in all tasks. Vectors of
    a group have one width.
    """
    kind = rows.schema[group].dataType.simpleString()
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) if mask else F.lit(1.0)
    whole = F.col(vec).isNotNull() & ~F.exists(F.col(vec), lambda x: x.isNull())
    good = rows.where(whole).select(F.col(group).alias("group"), F.col(vec).cast("array<double>").alias("vec"), weight.alias("weight"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("group").dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            width = pc.list_value_length(b.column("vec")).to_numpy()
            w, start = b.column("weight").to_numpy(), np.concatenate([[0], np.cumsum(width)])
            flat = b.column("vec").flatten().to_numpy()
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(set(width[part].tolist())) > 1:
                    raise QuarryError("vectors of a group differ in width", ErrorCode.EMBEDDING_MISMATCH)
                x = flat[start[part][:, None] + np.arange(width[part[0]])]
                total = pa.array([(x * w[part][:, None]).sum(0)], pa.list_(pa.float64()))
                key = codes.dictionary.take(pa.array(code[part[:1]]))
                yield pa.RecordBatch.from_arrays([key, total, pa.array([w[part].sum()]), pa.array([len(part)], pa.int64())], names=["group", "total", "weight", "n"])

    partial = good.mapInArrow(sums, f"group {kind}, total array<double>, weight double, n long")
    cells = partial.select("group", "weight", "n", F.posexplode("total").alias("dim", "x"))
    each = cells.groupBy("group", "dim").agg(F.sum("x").alias("x"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    mean = F.col("x") / F.greatest("weight", F.lit(1e-9))
    out = each.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("dim", mean.alias("mean")))).alias("cells"), F.max("n").alias("n"))
    return out.select(F.col("group").alias(group), F.transform("cells", lambda c: c["mean"]).alias("vec"), "n")


def _dealt(rows: DataFrame, callers: int | None) -> DataFrame:
    """rows in `callers` tasks, one caller in each; as they are without that number. Speculative tasks call besides these."""
    return rows if callers is None else rows.repartition(callers)


def embedded(
    rows: DataFrame, embed: Embedder, batch: int = 32, width: int | None = None, id: str = "id", text: str = "text", callers: int | None = None
) -> DataFrame:
    """id, vec (unit length, float): the vector of each text, null texts as empty ones; at most `callers` calls at once, if that is given.

    A batch with another number of vectors than texts fails; so does a vector of another width than `width`, if that is given, with
    EMBEDDING_MISMATCH in the message.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                vectors = embed(part[text].fillna("").tolist())
                if len(vectors) != len(part):
                    raise QuarryError(f"{len(part)} texts gave {len(vectors)} vectors")
                if width is not None and any(len(v) != width for v in vectors):
                    raise QuarryError(f"{ErrorCode.EMBEDDING_MISMATCH}: a vector isn't {width} wide", ErrorCode.EMBEDDING_MISMATCH)
                yield pd.DataFrame({"id": part[id].to_numpy(), "vec": [list(map(float, v)) for v in vectors]})

    out = _dealt(rows.select(id, text), callers).mapInPandas(run, f"id {rows.schema[id].dataType.simpleString()}, vec array<double>")
    return out.select("id", l2_normalised(F.col("vec")).cast("array<float>").alias("vec"))


def summarised(
    rows: DataFrame, summarise: Summariser, id: str = "id", name: str = "name", text: str = "text", callers: int | None = None
) -> DataFrame:
    """id, summary: null where the call fails, so that the caller can keep what it has; at most `callers` calls at once, if that is given."""

    def one(n: str, t: str) -> str | None:
        try:
            return summarise(n or "", t or "")
        except Exception:  # a failed call of any kind must not stop the other units
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f[id].to_numpy(), "summary": pd.Series([one(n, t) for n, t in zip(f[name], f[text], strict=True)], dtype=object)})

    return _dealt(rows.select(id, name, text), callers).mapInPandas(run, f"id {rows.schema[id].dataType.simpleString()}, summary string")
