"""Folding generations of change files into current and historical rows, and planning which files to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Generations that a fresh baseline replays.
OVERLAP = 3
STUB_BYTES = 10_000


def effective(from_: Column, until: Column, now: Column) -> Column:
    return (from_.isNull() | (from_ <= now)) & (until.isNull() | (until > now))


def fold_versions(changes: DataFrame, key: str, now: Column) -> DataFrame:
    """The best version of each key of its latest generation, or a tombstone if no version is open.

    ``changes`` has ``key``, ``generation``, ``effect_from``, ``effect_until``, ``recorded_from``,
    ``recorded_until`` and any others. Open means not superseded in the register. Currently effective
    versions win, then the latest effect, then the latest record; aggregation combines on the map side, so a
    key with many versions costs no large group.
    """
    rows = changes.filter(F.col(key).isNotNull())
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    order = F.struct(
        effective(F.col("effect_from"), F.col("effect_until"), now).alias("now"),
        F.coalesce("effect_from", never).alias("effect"),
        F.coalesce("recorded_from", never).alias("record"),
        F.xxhash64(*[c for c in changes.columns if c != key]).alias("tie"),  # equal versions: the same one in every run
    )
    open_ = F.col("recorded_until").isNull()
    whole = F.struct(*[c for c in changes.columns if c != key])
    best = rows.groupBy(key, "generation").agg(F.max_by(F.when(open_, whole), F.when(open_, order)).alias("row"))
    last = best.groupBy(key).agg(F.max_by("row", "generation").alias("row"), F.max("generation").alias("decided"))
    return last.select(key, "decided", F.col("row").isNull().alias("deleted"), *[F.col(f"row.{c}").alias(c) for c in changes.columns if c not in (key, "generation")])


def fold_status(changes: DataFrame, key: str, current: Column, tie: str) -> DataFrame:
    """The newest generation's row of each key; within it a current one first, then the smallest ``tie``. Never a tombstone."""
    order = F.struct(-F.col("generation"), F.when(current, 0).otherwise(1), F.col(tie), F.xxhash64(*changes.columns))
    whole = F.struct(*[c for c in changes.columns if c != key])
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, order).alias("row"))
    return last.select(key, *[F.col(f"row.{c}").alias(c) for c in changes.columns if c != key])


def fold_history(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per composite key, of its latest generation; rows with a null in the key are left out."""
    complete = changes.dropna(subset=keys)
    whole = F.struct(*[c for c in changes.columns if c not in keys])
    last = complete.groupBy(*keys).agg(F.max_by(whole, F.struct("generation", F.xxhash64(*changes.columns))).alias("row"))
    return last.select(*keys, *[F.col(f"row.{c}").alias(c) for c in changes.columns if c not in keys])


def applied(staged: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """``staged`` after upserts and tombstones of ``folded`` (same columns and ``deleted``)."""
    kept = staged.join(folded.select(key), key, "left_anti")
    return kept.unionByName(folded.filter("not deleted").select(*staged.columns))


def latest_totals(files: DataFrame, by: list[str]) -> DataFrame:
    """The newest full file of each group; stubs count only where there is nothing else."""
    full = files.filter("type = 'total' and national")
    order = F.struct((F.col("bytes") >= STUB_BYTES).alias("real"), "version", "generation")
    return full.groupBy(*by).agg(F.max_by(F.struct("file", "version", "generation", "bytes"), order).alias("f")).select(*by, "f.*")


def file_generation(name: Column, given: Column) -> Column:
    return F.coalesce(given.try_cast("int"), F.nullif(F.regexp_extract(name, r"_(\d+)\.zip$", 1), F.lit("")).try_cast("int"))


def gaps(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Deltas, one a generation, with whether each continues the one before it."""
    one = deltas.dropDuplicates([*by, "generation"])
    before = F.lag("generation").over(Window.partitionBy(*by).orderBy("generation"))
    return one.withColumn("before", before).withColumn("contiguous", before.isNull() | (F.col("generation") == before + 1))


def staging_plan(deltas: DataFrame, cursors: DataFrame, by: str) -> DataFrame:
    """(entity, action, new_cursor): SKIP without newer deltas, DELTA over a contiguous run from the cursor, else BASELINE.

    ``cursors`` has (entity, cursor, contract_ok, empty). A baseline's cursor stays ``OVERLAP`` generations behind.
    """
    newer = deltas.join(cursors, by, "right")
    stats = newer.groupBy(by, "cursor", "contract_ok", "empty").agg(
        F.max("generation").alias("newest"),
        F.count_distinct(F.when(F.col("generation") > F.col("cursor"), F.col("generation"))).alias("fresh"),
        F.min(F.when(F.col("generation") > F.col("cursor"), F.col("generation"))).alias("first"),
    )
    run = (F.col("first") == F.col("cursor") + 1) & (F.col("fresh") == F.col("newest") - F.col("cursor"))
    start = F.col("cursor").isNull() | F.col("empty") | ~F.col("contract_ok")
    action = F.when(start, "BASELINE").when(F.col("fresh") == 0, "SKIP").when(run, "DELTA").otherwise("BASELINE")
    cursor = F.when(action == "BASELINE", F.greatest(F.coalesce("newest", F.lit(0)) - OVERLAP, F.lit(0))).when(action == "SKIP", F.col("cursor")).otherwise(F.col("newest"))
    return stats.select(by, action.alias("action"), cursor.alias("new_cursor"))


def contract_hash(spec: Column) -> Column:
    return F.sha2(F.to_json(spec), 256)


def needs_build(cursors: DataFrame, watermark: DataFrame, shape: str | None, fingerprint: str) -> DataFrame:
    """One row (moved, reshaped, build): whether the staged tables (entity, cursor, contract) differ from the ``watermark`` of the last build, or no generation has this shape."""
    both = cursors.select("entity", F.struct("cursor", "contract").alias("now")).join(watermark.select("entity", F.struct("cursor", "contract").alias("then")), "entity", "full")
    moved = both.agg(F.count_if(~F.col("now").eqNullSafe(F.col("then"))).alias("moved"))
    reshaped = F.lit(shape is None or shape != fingerprint)
    return moved.select("moved", reshaped.alias("reshaped"), ((F.col("moved") > 0) | reshaped).alias("build"))


def should_swap(serving: Column, serving_contract: Column, candidate: Column, candidate_contract: Column) -> Column:
    """Whether to serve another generation: one that exists, is not served yet, and is of no older contract."""
    return candidate.isNotNull() & ~candidate.eqNullSafe(serving) & F.coalesce(candidate_contract >= serving_contract, F.lit(True))


def listing(files: DataFrame) -> DataFrame:
    """A register's listing (page, of_pages, ...) as files; a listing of several pages is an error, since the rest is not there."""
    if not files.filter("of_pages > 1").isEmpty():
        raise ValueError("the listing has more pages than one")
    return files.drop("page", "of_pages")


def lineage(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Deltas of the newest data model of each entity, one a generation: others cannot be applied to it."""
    newest = F.max("version").over(Window.partitionBy(*by))
    same = deltas.withColumn("_newest", newest).filter("version = _newest").drop("_newest")
    return same.groupBy(*by, "generation").agg(F.min(F.struct("file", "version", "bytes")).alias("f")).select(*by, "generation", "f.*")


def baseline_cursor(newest: Column, total_generation: Column, first_delta: Column) -> Column:
    """Where a baseline starts to replay: ``OVERLAP`` generations back, not past the full file's own; null (fatal) where deltas begin later than that."""
    start = F.least(F.greatest(newest - OVERLAP, F.lit(0)), total_generation)
    return F.when(first_delta.isNull() | (first_delta <= start + 1), start)


TRANSIENT = ("timeout", "connection", "unavailable", "throttled")


def next_attempt(error: Column, attempt: Column, first: int = 30, most: int = 900) -> Column:
    """Seconds until a failed load is tried again: doubled each time up to ``most``; null for an error that would come again."""
    passing = F.lit(False)
    for word in TRANSIENT:
        passing = passing | F.lower(error).contains(word)
    return F.when(passing, F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), attempt - 1)))
