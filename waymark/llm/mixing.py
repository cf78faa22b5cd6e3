"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Rows are sorted by source and key into ranges of about as many rows
each, so that a range is a run of one source's order; each is summed by itself, and a small table of range
totals, summed along each source, gives every range its offset. A document is taken once for each whole
epoch of its source's budget and, in the last epoch, as far as its words lie before the budget's end. So each
source meets its budget to the word, and nothing wider than ids, sizes and hashes is sorted.

Targets: the sources, ordered by code point with null last, weigh ``weights`` in turn and share
``share`` of all words; none may exceed ``max_epochs`` times its own words, and what is cut off is
shared again by weight among the others. That fixed point is found in closed form: sort sources
by cap over weight; a source is capped while the level that would fill it does not exceed what
is left. That takes one row a source, and ranges are a row each, in one sort; texts are never gathered.

Cases: null text has size 0; null is a source of its own; a null id hashes like the text
``null``; rows that share an id are separate documents, ordered by size, text hash and place, so that any
number of them is spread over ranges; a text of any length is counted whole; an empty table gives an empty
result; sources of no words have target 0; other columns are not read, and :func:`mixed_documents` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

WORD = r"[^\x20\x09-\x0D]+"
#: Hash-random keys are non-negative and below 2 ** KEY_BITS.
KEY_BITS = 60
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: int) -> Column:
    """The first 60 bits of the MD5 of seed and id: the same in every engine and every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def text_id(text: Column) -> Column:
    return F.xxhash64(text)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source, so windows over all of them are small."""
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("w", w)
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    )
    order = everything.orderBy(F.col("cap") / F.col("w"), "place")
    below = ranked.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "open_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    capped = below.withColumn("capped", F.coalesce("before", F.lit(0.0)) + F.col("cap") / F.col("w") * F.col("open_w") <= F.col("budget"))
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~F.col("capped"), F.col("w"))
    ).over(everything)
    return capped.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 0,
    scope: str = "",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted), text_id (a hash of the text)."""
    thin = table(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), seed).alias("key"),
            text_id(F.col(text_col)).alias("text_id"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
        scope,
    )
    ranges = max(8, thin.count() // RANGE_ROWS + 1)
    order = ["key", "id", "size", "text_id", "row"]
    thin = table(thin.repartitionByRange(ranges, F.asc_nulls_last("source"), *order).withColumn("range", F.spark_partition_id()), "mix-ranges", scope)
    totals = thin.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("range_size").over(along), F.lit(0).cast("long")))
    of_source = targets(totals.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    places = table(
        offsets.alias("o").join(of_source.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.range", "offset", "source_size", "target"),
        "mix-offsets",
        scope,
    )
    within = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = thin.withColumn("upto", F.sum("size").over(within))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("offset") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - start))
    return (
        placed.alias("d")
        .join(places.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
        .withColumn("epochs", epochs)
        .select(
            F.col("id").alias(id_col),
            F.col("d.source").alias(source_col),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
            "text_id",
        )
    )


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int"))
    return F.concat_ws("", words)


#: Groups of equal rows are broadcast up to this number.
BROADCAST_TWINS = 100_000


def mixed_documents(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scope: str = "") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and cut to its first words where the budget ends in it.

    ``taken`` comes from :func:`mix_sources`. A row is known by id, source and text; of rows that agree in
    all three, one stands for what they are taken together.
    """
    names = {"__mix_id": id_col, "__mix_source": source_col, "__mix_text": "text_id"}
    shares = taken.groupBy(*[F.col(c).alias(name) for name, c in names.items()]).agg(
        F.sum("taken").alias("__mix_share"), F.max("size").alias("__mix_own"), F.count(F.lit(1)).alias("__mix_rows")
    )
    shares = table(shares.filter("__mix_share > 0"), "mix-shares", scope)
    rows = docs.withColumn("__mix_of", text_id(F.col(text_col)))

    def of(side: DataFrame) -> Column:
        return rows[id_col].eqNullSafe(side["__mix_id"]) & rows[source_col].eqNullSafe(side["__mix_source"]) & (rows["__mix_of"] == side["__mix_text"])

    lone = shares.filter("__mix_rows = 1")
    found = rows.join(lone, of(lone))
    twins = shares.filter("__mix_rows > 1")
    n = twins.count()
    if n:
        # equal rows meet before any shuffle, so that their number does not matter
        one = rows.join(F.broadcast(twins), of(twins)) if n <= BROADCAST_TWINS else rows
        one = one.dropDuplicates([id_col, source_col, "__mix_of"])
        found = found.unionByName(one.select(*found.columns) if n <= BROADCAST_TWINS else one.join(twins, of(twins)).select(*found.columns))
    out = found.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__mix_share") / F.col("__mix_own")))))
    cut = F.col("__mix_share") - (F.col("__mix_copy") - 1) * F.col("__mix_own")
    return out.withColumn(text_col, F.when(cut < F.col("__mix_own"), first_words(F.col(text_col), cut)).otherwise(F.col(text_col))).select(
        *docs.columns
    )
