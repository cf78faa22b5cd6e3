"""Deriving the served tables of one generation: names as of a time, lifecycles, hierarchies, labels, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii

# What the registers' status codes mean.
ADDRESS_STATUS = {"3": "current", "4": "retired", "2": "preliminary", "5": "abandoned"}
PARCEL_STATUS = {"gældende": "current", "historisk": "retired", "foreløbig": "preliminary", "ikke gennemført": "abandoned"}
PLACE_STATUS = {"iAnvendelse": "current", "historisk": "retired"}


def _by_status(status: Column, meanings: dict[str, str], otherwise: Column) -> Column:
    out = F.when(status.isNull(), "current")
    for code, state in meanings.items():
        out = out.when(status == code, state)
    return out.otherwise(otherwise)


def _open(until: Column) -> Column:
    return F.when(until.isNull(), "current").otherwise("retired")


def address_lifecycle(status: Column, from_: Column, until: Column, now: Column) -> Column:
    """A future start is preliminary whatever the status; an unknown status goes by whether the effect has ended."""
    return F.when(from_ > now, "preliminary").otherwise(_by_status(status, ADDRESS_STATUS, _open(until)))


def parcel_lifecycle(status: Column, from_: Column, until: Column, now: Column) -> Column:
    return F.when(from_ > now, "preliminary").otherwise(_by_status(F.lower(status), PARCEL_STATUS, _open(until)))


def area_lifecycle(from_: Column, until: Column, now: Column) -> Column:
    return F.when(from_ > now, "preliminary").otherwise(_open(until))


def place_lifecycle(status: Column) -> Column:
    return _by_status(status, PLACE_STATUS, F.lit("current"))


def unmapped(status: Column, meanings: dict[str, str]) -> Column:
    return status.isNotNull() & ~status.isin(*meanings)


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, row_id: str, value: list[str]) -> DataFrame:
    """``rows`` with the version of ``key`` in effect at ``at``: latest start at or before it (one that is not known is the earliest), not ended by it.

    ``versions`` has ``key``, ``effect_from``, ``effect_until`` and the ``value`` columns. An equality join on the
    key with the range as a filter, then a best-of aggregate; rows without a version keep nulls.
    """
    v = versions.select(F.col(key).alias("_key"), "effect_from", "effect_until", *[F.col(c).alias(f"_{c}") for c in value])
    holds = (F.col("effect_from").isNull() | (F.col("effect_from") <= F.col(at))) & (F.col("effect_until").isNull() | (F.col(at) < F.col("effect_until")))
    hits = rows.select(row_id, key, at).join(v, (F.col(key) == F.col("_key")) & holds)
    order = F.struct(F.col("effect_from"), *[F.col(f"_{c}") for c in value])
    best = hits.groupBy(row_id).agg(F.max_by(F.struct("effect_from", *[F.col(f"_{c}").alias(c) for c in value]), order).alias("v"))
    return rows.join(best, row_id, "left").select(*rows.columns, F.col("v.effect_from").alias("named_from"), *[F.col(f"v.{c}").alias(c) for c in value])


def best_of(rows: DataFrame, by: list[Column | str], order: list) -> DataFrame:
    """One row of each group, the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def preference(value: Column, preferred: list[str]) -> Column:
    """Place in a list of preferences; unknown values come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in preferred]), value)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(preferred) + 1).otherwise(at)


def ownership_chain(units: DataFrame, buildings: DataFrame, grounds: DataFrame) -> DataFrame:
    """Units with parent, ground and the chain up to it, at most three long.

    ``units`` (bfe, point, area, ground), ``buildings`` (id, bfe, ground), ``grounds`` (id, bfe): a building at a point wins
    over one on an area, either over the ground itself.
    """
    b = buildings.select(F.col("id").alias("_b"), F.col("bfe").alias("b_bfe"), F.col("ground").alias("b_ground"))
    u = units.withColumn("building", F.coalesce("point", "area"))
    u = u.join(b, F.col("building") == F.col("_b"), "left")
    u = u.withColumn("at", F.coalesce("b_ground", "ground"))
    g = grounds.select(F.col("id").alias("_g"), F.col("bfe").alias("ground_bfe"))
    u = u.join(g, F.col("at") == F.col("_g"), "left")
    chain = F.filter(F.array("bfe", "b_bfe", "ground_bfe"), lambda x: x.isNotNull())
    return u.select("bfe", F.coalesce("b_bfe", "ground_bfe").alias("parent"), "ground_bfe", chain.alias("chain"))


def children(nodes: DataFrame, node: str = "bfe", parent: str = "parent", kind: str = "type") -> DataFrame:
    """(parent, children, child_types): parallel arrays in the order of the children's ids. A row holds its own children."""
    both = F.array_sort(F.collect_list(F.struct(F.col(node).alias("id"), F.col(kind).alias("kind"))))
    return nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("parent")).agg(both.alias("c")).select(
        "parent", F.col("c.id").alias("children"), F.col("c.kind").alias("child_types")
    )


def orphans(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    return nodes.filter(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("_id"), "left_anti")


def street_ids(names: DataFrame, name: str = "name", lifecycle_rank: str = "rank") -> DataFrame:
    """(street_id, street, folded_street, best_rank): dense ids in the order of folded names; the smallest spelling is shown.

    Dense ids need one order over all names: there are about a hundred thousand, and a table of ids is small.
    """
    folded = names.withColumn("folded_street", normalize_ascii(F.col(name))).filter("folded_street <> ''")
    one = folded.groupBy("folded_street").agg(F.min(name).alias("street"), F.min(lifecycle_rank).alias("best_rank"))
    # counts by the first two characters give every group its base, so that no window spans all names; such pairs are few
    letter = F.substring("folded_street", 1, 2)
    base = one.groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("letter").orderBy("folded_street"))
    return one.withColumn("letter", letter).join(F.broadcast(base.select("letter", "base")), "letter").select(
        (F.col("base") + within - 1).cast("int").alias("street_id"), "street", "folded_street", "best_rank"
    )


def name_codes(rows: DataFrame, name: str, code: str) -> DataFrame:
    """(name, codes): sorted distinct codes of each folded name."""
    return rows.filter(F.col(name).isNotNull() & F.col(code).isNotNull()).groupBy(normalize_ascii(F.col(name)).alias("name")).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def aliases(history: DataFrame, current: DataFrame, key: str, name: str) -> DataFrame:
    """Earlier names of what has another name now, with the time of their last use."""
    now = current.select(F.col(key), F.col(name).alias("_now"))
    return history.join(now, key).filter(F.col(name) != F.col("_now")).groupBy(key, name).agg(F.max("effect_from").alias("last_from"))


def parcel_labels(number: Column, district: Column, code: Column) -> tuple[Column, Column]:
    """(shown, searched) label of a parcel."""
    shown = F.concat_ws(" ", number, district)
    return shown, normalize_ascii(F.concat_ws(" ", number, district, code))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the total, and the nulls of each column."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[(F.count(F.lit(1)) - F.count(c)).alias(f"null_{c}") for c in columns])


def shrink_violations(counts: DataFrame, prior: DataFrame, limit: float = 0.02) -> DataFrame:
    """Tables that lost more than ``limit`` of their rows against the generation before."""
    both = counts.join(prior.withColumnRenamed("rows", "before"), "name")
    return both.filter(F.col("rows") < F.col("before") * (1 - limit)).withColumn("lost", 1 - F.col("rows") / F.col("before"))


def floor_violations(counts: DataFrame, floors: dict[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return counts.withColumn("floor", F.element_at(table, F.col("name"))).filter(F.col("rows") < F.col("floor"))


def ratio_violations(counts: DataFrame, part: str, whole: str, limit: float) -> DataFrame:
    return counts.withColumn("ratio", F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)).filter(F.col("ratio") > limit)


def kept_generations(generations: DataFrame) -> DataFrame:
    """Which generations stay: two of the current contract, one of the previous and of each retired one, any that is leased."""
    newest = Window.partitionBy("contract").orderBy(F.desc("seeded_at"), F.desc("name"))
    allowed = F.when(F.col("contract_age") == 0, 2).otherwise(1)
    return generations.withColumn("n", F.row_number().over(newest)).withColumn("keep", (F.col("n") <= allowed) | F.col("leased"))


def serving_generation(generations: DataFrame) -> DataFrame:
    """The generation to serve: the current contract before the previous, then the newest."""
    return generations.filter("contract_age <= 1").orderBy("contract_age", F.desc("seeded_at"), F.desc("name")).limit(1)
