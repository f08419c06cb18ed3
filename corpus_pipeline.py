"""Corpus preparation from `documents` to token ids, stage by stage; each stage is written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents, whatever their
number and names besides doc_id and text; the last one returns the encoding. Decisions are of rows: of two rows with one doc_id, or with
none, each is judged by its own text. Rows alike in doc_id and text are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import make_importable, table, text_hash, without, written
from codequarry.llm.decontaminate import contaminated
from codequarry.llm.piece_bpe import encoded, public_path
from codequarry.llm.similar_texts import similar_texts
from codequarry.llm.substring_dedup import repeated_passages
from codequarry.llm.toxicity import fitted, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no evidence and stay. So do all documents if no label teaches anything. Texts are scored whole.
    """
    make_importable(spark)
    return without_toxic(docs, *fitted(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays; rows without doc_id stay too.

    Near-duplicates have a Jaccard similarity of 0.8 or more in five-word shingles: SimHash links the closest, and an exact set join those
    that its error budget can't reach. Texts without words, null ones too, are one group. Rows alike in doc_id and text are one document.
    """
    make_importable(spark)
    return without(docs, similar_texts(docs).where("NOT first"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out of the text, and n_chars, if there is such a column, follows.

    Texts without any such passage, null and empty ones and those of rows without doc_id stay as they are.
    """
    make_importable(spark)
    cut = repeated_passages(docs).where("n_removed > 0").select(F.col("doc_id").alias("_cut_id"), text_hash("text").alias("_cut_hash"), F.col("kept").alias("_cut_text"))
    cut = written(cut.dropDuplicates(["_cut_id", "_cut_hash"]), "cut")  # what was shuffled for it goes before all texts are
    out = docs.join(cut, (docs["doc_id"] == cut["_cut_id"]) & (text_hash(docs["text"]) == cut["_cut_hash"]), "left")
    now = {"text": F.coalesce(cut["_cut_text"], docs["text"]), "n_chars": F.coalesce(F.length(cut["_cut_text"]).cast("long"), docs["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[now[c].alias(c) if now.get(c) is not None else docs[c] for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those without doc_id too.

    Null and empty texts hold none; without items all documents stay. Texts are searched whole.
    """
    make_importable(spark)
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, in any order; null and empty texts have none."""
    make_importable(spark)
    return encoded(docs, public_path(), keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
