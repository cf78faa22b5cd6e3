"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import KEY_BITS, random_key


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept from fitting; a null id is."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(True))


def shares(counts: dict, per_label: int) -> dict:
    """The share of each label's rows that leaves about ``per_label`` of them."""
    return {label: min(1.0, per_label / max(1, n)) for label, n in counts.items()}


def drawn(rows: DataFrame, share: dict, key: Column, weight: Column) -> DataFrame:
    """The rows (with ``label``) whose ``key`` lies in their label's share, with ``weight`` times 1 over it."""
    chosen = F.lit(False)
    for label, part in share.items():
        is_label = F.col("label") == F.lit(label)
        weight = F.when(is_label, weight / F.lit(part)).otherwise(weight)
        chosen = chosen | (is_label & (key < int(part * (1 << KEY_BITS))))
    return rows.filter(chosen).withColumn("weight", weight)


def counted(rows: DataFrame) -> dict:
    return {r.label: r["count"] for r in rows.groupBy("label").count().collect()}


def bounded(rows: DataFrame, per_label: int, seed: int) -> DataFrame:
    """``rows`` (id, text, label, weight), drawn again by their texts where a few ids bring far more rows than were asked for."""
    counts = counted(rows.select("label"))
    if all(n <= 2 * per_label for n in counts.values()):
        return rows
    return drawn(rows, shares(counts, per_label), random_key(F.xxhash64("text"), seed + 1), F.col("weight"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int, seed: int = 0) -> DataFrame:
    """(id, text, label, weight) of about ``per_label`` rows of each label, drawn by a hash of the id.

    ``weight`` is 1 over the label's sampling share, so weighted rows have the ratio of the labels
    that all rows have, whatever their number.

    ``labels`` has (id, label); an id with several labels has the largest. ``docs`` has (id, text); an id
    on several rows labels them all, and if that makes too many they are drawn again by their texts. Texts over
    ``max_chars`` are left out of the sample, so what it holds is bounded.
    """
    labels = labels.filter("label is not null and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = drawn(labels, shares(counted(labels), per_label), random_key(F.col("id"), seed), F.lit(1.0))
    # about per_label rows of each label, by construction
    rows = docs.join(F.broadcast(picked), "id")
    return bounded(rows, per_label, seed).filter(F.char_length("text") <= max_chars).select("id", "text", "label", "weight")


def labelled_rows(rows: DataFrame, per_label: int, max_chars: int, seed: int = 0) -> DataFrame:
    """The same of ``rows`` (id, text, label) that carry their own label: a row keeps its label, whatever its id."""
    known = rows.filter("label is not null and id is not null")
    picked = drawn(known, shares(counted(known.select("label")), per_label), random_key(F.col("id"), seed), F.lit(1.0))
    return bounded(picked, per_label, seed).filter(F.char_length("text") <= max_chars).select("text", "label", "weight")
