"""A corpus pipeline of five stages; each works on all rows that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import exact_dedup, jaccard, mixing, packing, scratch, toxicity
from waymark.llm.queries import read, tokenizer_path

#: DuckDB cannot express the classifier of the first stage; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None
_SCOPE = "pipeline-"


def _enter(spark: SparkSession, stage: str) -> str:
    """Delete what earlier stages left: each result has been written before the next stage begins.

    A stage's frame runs when the caller writes it, so the session goes on reading in small batches after a stage, too:
    an executor keeps the memory of the largest batches that it ever held, beside those of every later stage.
    """
    scratch.keep_small_reads(spark)
    for name, _ in STAGES:
        scratch.release(spark, _SCOPE + name)
    return _SCOPE + stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the classifier is fitted on labelled documents outside the held-out fold."""
    scope = _enter(spark, "toxicity")
    labels = toxicity.train_labels(read(spark, sf_dir, "labels"), "toxic", "doc_id", 5, 0)
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels, scope=scope)
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    scope = _enter(spark, "exact dedup")
    return exact_dedup.kept_documents(docs, exact_dedup.exact_dedup(docs, scope=scope), scope=scope)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more connect, the document with the smallest id."""
    scope = _enter(spark, "near dedup")
    return jaccard.kept_documents(docs, jaccard.near_duplicates(docs, with_text_id=True, scope=scope), scope=scope)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as their source's budget takes them."""
    scope = _enter(spark, "mixing")
    return mixing.mixed_documents(docs, mixing.mix_sources(docs, scope=scope), scope=scope)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    scope = _enter(spark, "packing")
    return packing.pack(docs, tokenizer_path(), with_ids=False, scope=scope)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", "stages")
    return STAGES[-1][1](spark, docs, sf_dir)
