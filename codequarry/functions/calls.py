"""Calls of services that equal requests make once, and whose answers outlive a job that fails.

Requests are told apart by a hash of what they say. Those that a table of answers has for the model aren't asked again; the others go out in waves,
each a job that adds its answers to the table. A task whose service fails, after retries with growing waits, hands over what it has and asks no
more, so that the next run asks for the rest alone. A lost executor repeats its own calls of one wave at most.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ErrorCode, QuarryError
from ..session import make_importable
from .models import Embedder, Summariser
from .vectors import l2_normalised

#: Batches that a task sends in one wave, times that a batch is sent, seconds before the second time; the wait doubles from then on.
WAVE, TRIES, WAIT = 64, 3, 0.5

#: Requests as rows of a frame to their answers in order.
Call = Callable[[pd.DataFrame], Sequence[object]]


def _answers(spark: SparkSession, folder: str, kind: str, model: str) -> DataFrame:
    """_hash, answer: what the table has for a model. Of two answers to one request, which a repeated task can give, the smaller one counts."""
    try:
        rows = spark.read.schema(f"model string, _hash string, answer {kind}, error string").parquet(f"{folder}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"model string, _hash string, answer {kind}, error string")
    return rows.where((F.col("model") == model) & F.col("answer").isNotNull()).groupBy("_hash").agg(F.min("answer").alias("answer"))


def _sent(call: Call, part: pd.DataFrame, tries: int, wait: float) -> tuple[Sequence[object] | None, str | None]:
    """The answers to a batch, or the last error."""
    error = ""
    for k in range(tries):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            answers = call(part)
        except QuarryError as e:  # no retry mends this
            return None, f"{e.code or ''} {e}".strip()
        except Exception as e:  # a service can fail in any way
            error = f"{type(e).__name__}: {e}"
            continue
        if len(answers) == len(part):
            return answers, None
        error = f"{len(part)} requests gave {len(answers)} answers"
    return None, error


def asked_once(
    rows: DataFrame, request: dict[str, Column], call: Call, kind: str, folder: str, model: str, batch: int, callers: int | None = None,
    strict: bool = True, tries: int = TRIES, wait: float = WAIT, wave: int = WAVE,
) -> DataFrame:
    """rows with `answer`, of the SQL type kind: what call gives for the columns of `request`; equal requests are sent once.

    Answers are kept in folder for the model. At most `callers` tasks call at once. With strict, a request without an answer is an error, after
    all that was answered is kept; else its answer is null and the next run asks again.
    """
    spark = rows.sparkSession
    make_importable(spark)
    named = F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in request.items()]), {"ignoreNullFields": "false"}), 256)
    all_ = rows.withColumn("_hash", named)
    asked = rows.select(named.alias("_hash"), *[c.alias(n) for n, c in request.items()]).dropDuplicates(["_hash"])
    tasks = callers or spark.sparkContext.defaultParallelism
    todo = f"{folder.rstrip('/')}-todo/{uuid.uuid4().hex}"
    asked.join(_answers(spark, folder, kind, model), "_hash", "left_anti").write.parquet(todo)
    left = spark.read.schema(asked.schema).parquet(todo)
    waves = -(-left.count() // (tasks * wave * batch))
    if waves > 1:  # a wave is `tasks` files, each written by a task of its own
        file = F.pmod(F.xxhash64("_hash"), F.lit(waves * tasks)).cast("int")
        left.repartitionById(waves * tasks, file).withColumn("wave", F.floor(file / tasks).cast("int")).write.partitionBy("wave").parquet(f"{todo}-waves")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        error = None
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                answers = None
                if not (strict and error):
                    answers, failed = _sent(call, part.drop(columns="_hash"), tries, wait)
                    error = failed or error
                out = pd.DataFrame({"model": model, "_hash": part["_hash"].to_numpy(), "answer": pd.Series([None] * len(part) if answers is None else list(answers), dtype=object)})
                yield out.assign(error=error if answers is None else None)

    for k in range(waves):
        one = left if waves == 1 else spark.read.schema(asked.schema).parquet(f"{todo}-waves/wave={k}") if _there(spark, f"{todo}-waves/wave={k}") else None
        if one is None:
            continue
        made = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        one.repartition(tasks).mapInPandas(run, f"model string, _hash string, answer {kind}, error string").write.parquet(made)
        bad = spark.read.schema("error string").parquet(made).where("error IS NOT NULL").first() if strict else None
        if bad:
            code = next((c for c in ErrorCode if c in bad.error), None)
            raise QuarryError(bad.error, code)
    return all_.join(_answers(spark, folder, kind, model), "_hash", "left").drop("_hash")


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def embedded_once(
    rows: DataFrame, embed: Embedder, folder: str, model: str, width: int | None = None, id: str = "id", text: str = "text", batch: int = 32, callers: int | None = None, **how: float
) -> DataFrame:
    """id, vec as models.embedded() gives them, by asked_once(): a vector of another width than `width` is an error with EMBEDDING_MISMATCH."""

    def call(part: pd.DataFrame) -> list[list[float]]:
        vectors = embed(part["text"].tolist())
        if width is not None and any(len(v) != width for v in vectors):
            raise QuarryError(f"a vector isn't {width} wide", ErrorCode.EMBEDDING_MISMATCH)
        return [np.asarray(v, float).tolist() for v in vectors]

    asked = asked_once(rows.select(id, text), {"text": F.coalesce(F.col(text), F.lit(""))}, call, "array<double>", folder, model, batch, callers, **how)
    return asked.select(F.col(id).alias("id"), l2_normalised(F.col("answer")).cast("array<float>").alias("vec"))


def summarised_once(
    rows: DataFrame, summarise: Summariser, folder: str, model: str, id: str = "id", name: str = "name", text: str = "text", callers: int | None = None, **how: float
) -> DataFrame:
    """id, summary as models.summarised() gives them, by asked_once(): units of one name and text are summarised once; null where the call fails."""

    def call(part: pd.DataFrame) -> list[str]:
        return [summarise(n, t) for n, t in zip(part["name"], part["text"], strict=True)]

    request = {"name": F.coalesce(F.col(name), F.lit("")), "text": F.coalesce(F.col(text), F.lit(""))}
    asked = asked_once(rows.select(id, name, text), request, call, "string", folder, model, 1, callers, strict=False, **how)
    return asked.select(F.col(id).alias("id"), F.col("answer").alias("summary"))
