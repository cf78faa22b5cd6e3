"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts how often each slot of a counting filter is hit and keeps the slots hit at least
twice, as bitmaps. Pass two probes every row: a row whose slots are not all marked cannot have a
copy and passes straight through; only the others shuffle and are grouped by their full SHA-256.
A false positive costs a shuffled row, never a wrong group.

The filter has ``bits_per_row`` bits a row up to ``max_filter_bits``, so what is broadcast never
exceeds ``max_filter_bits / 8`` bytes, whatever the input. Past that size more rows are
shuffled as candidates and the results stay the same.

Cases: null text counts as empty, and all empty texts are one group; a null id sorts below every
other id; rows that agree in text and id are one group of which exactly one row stays; texts of any
length are hashed whole and never shuffled; an empty table gives an empty result; other columns of the
input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import join_hot, table, without_hot

HASHES = 2
#: What goes is broadcast up to this number of rows, about 20 MB.
BROADCAST_LOST = 300_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` is that on pure ASCII, and much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_sha256(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _slots(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(j)), F.lit(bits)) + 1 for j in range(HASHES)]


def filter_bits(rows: int, bits_per_row: int, max_filter_bits: int) -> int:
    """A power of two that holds ``bits_per_row`` for each row, between one bitmap and the bound."""
    return min(max_filter_bits, max(1 << 15, 1 << (max(1, rows) * bits_per_row - 1).bit_length()))


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the slots that at least two rows of ``hashes`` (sha) hit."""
    hits = hashes.select(F.explode(F.array(*_slots(F.col("sha"), bits))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 30,
    scope: str = "",
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    thin = table(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(text_sha256(F.col(text_col))).alias("sha"),
        ),
        "dedup-hashes",
        scope,
    )
    rows = thin.count()
    bits = filter_bits(rows, bits_per_row, max_filter_bits)
    marked = F.broadcast(repeated_slots(thin.select("sha"), bits))
    probed = thin
    for j, slot in enumerate(_slots(F.col("sha"), bits)):
        probed = probed.withColumn(f"slot{j}", slot).join(
            marked.select(F.col("bucket").alias(f"bucket{j}"), F.col("bitmap").alias(f"bitmap{j}")),
            F.bitmap_bucket_number(f"slot{j}") == F.col(f"bucket{j}"),
            "left",
        )
    suspect = F.lit(True)
    for j in range(HASHES):
        suspect = suspect & bit_is_set(f"bitmap{j}", f"slot{j}")
    probed = table(probed.select("id", "row", "sha", suspect.alias("suspect")), "dedup-probed", scope)

    candidates = probed.filter("suspect")
    groups = table(
        candidates.groupBy("sha")
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size >= 2"),
        "dedup-groups",
        scope,
    )
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = without_hot(candidates, groups, ["sha"], "group_size")
    grouped = join_hot(candidates, groups, ["sha"], "group_size")
    return (
        probed.filter("not suspect")
        .unionByName(single)
        .select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
        .unionByName(
            grouped.select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), sha)
        )
        .withColumnRenamed("id", id_col)
    )


def bit_is_set(bitmap: str, slot: str) -> Column:
    """Whether the bitmap (null: none) has the slot's bit; bit p is bit p mod 8 of byte p div 8."""
    byte = f"cast(conv(hex(substring({bitmap}, cast(bitmap_bit_position({slot}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce(getbit({byte}, cast(bitmap_bit_position({slot}) % 8 as int)) = 1, false)")


def kept_documents(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that agree in id and text are told apart by nothing, so one of them is taken. What goes is
    found by (id, hash): broadcast up to ``BROADCAST_LOST`` rows, else joined by shuffle.
    """
    pairs = decisions.groupBy(F.col(id_col).alias("__lost_id"), F.unhex("text_sha256").alias("__lost_sha")).agg(
        F.bool_or("kept").alias("__lost_kept"), F.count(F.lit(1)).alias("__lost_n")
    )
    odd = table(pairs.filter("not __lost_kept or __lost_n > 1"), "dedup-lost", scope)
    few = odd.count() <= BROADCAST_LOST
    marked = docs.withColumn("__own_sha", F.unhex(text_sha256(F.col(text_col))))

    def side(rows: DataFrame) -> tuple[DataFrame, Column]:
        return F.broadcast(rows) if few else rows.hint("shuffle_hash"), marked[id_col].eqNullSafe(rows["__lost_id"]) & (marked["__own_sha"] == rows["__lost_sha"])

    out = marked.join(*side(odd), "left_anti")
    twins = odd.filter("__lost_kept")
    if not twins.isEmpty():
        one = marked.join(*side(twins), "left_semi").dropDuplicates([id_col, "__own_sha"])
        out = out.unionByName(one)
    return out.drop("__own_sha")
