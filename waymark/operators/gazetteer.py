"""Search and projection over areas, streets, places and properties, and the confidence of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .knn import ranked, similarities
from .sized import small

# Components from the finest area to the coarsest, the parts of an address, and how many children are shown.
DEPTH = ("sogn", "postcode", "city", "sub_locality", "kommune", "region")
ADDRESS_PARTS = ("street", "house_number", "house_letter", "floor", "door", "postcode", "city", "sub_locality")
CHILDREN_SHOWN = 1000
SAME = 1e-9


def merged_components(found: Column, pinned: Column) -> Column:
    """Two maps of components, the pinned ones winning."""
    return F.map_concat(F.map_filter(found, lambda k, v: ~F.map_contains_key(pinned, k)), pinned)


def deepest_area(has: dict[str, Column]) -> Column:
    """The finest area component that is present; ``has`` maps component to value."""
    return F.coalesce(*[F.when(F.coalesce(has[c], F.lit("")) != "", F.lit(c)) for c in DEPTH if c in has])


def uses_features(has: dict[str, Column], autocomplete: Column) -> Column:
    """Whether a query asks for a street or area rather than for an address."""
    present = lambda c: F.coalesce(has[c], F.lit("")) != "" if c in has else F.lit(False)
    any_part = F.lit(False)
    for c in ADDRESS_PARTS:
        any_part = any_part | present(c)
    return ~present("house_number") & ~(autocomplete & any_part) & (present("street") | deepest_area(has).isNotNull())


def feature_confidence(rank: Column, score: Column, next_score: Column) -> Column:
    """Only a leader that is alone at the top is better than C: A if exact, else B."""
    flat = F.coalesce(next_score >= score - SAME, F.lit(False))
    return F.when((rank > 1) | flat, "C").when(score >= 1 - SAME, "A").otherwise("B")


def with_feature_confidence(hits: DataFrame, *query: str) -> DataFrame:
    """``hits`` (query, rank, sim) with ``confidence``."""
    after = F.lead("sim").over(Window.partitionBy(*(query or ("query",))).orderBy("rank"))
    return hits.withColumn("confidence", feature_confidence(F.col("rank"), F.col("sim"), after))


def by_name(queries: DataFrame, register: DataFrame, cap: int, lifecycles: tuple[str, ...] = ("current",)) -> DataFrame:
    """(query, id, name, sim, rank, confidence) of the rows of ``register`` (id, name, folded, lifecycle) closest in name."""
    allowed = register.filter(F.col("lifecycle").isin(*lifecycles))
    hits = similarities(queries, allowed, "query", "id", "folded").join(small(allowed.select("id", "name")), "id")
    return with_feature_confidence(ranked(hits, cap, [F.desc("sim"), "id"], ["query"]))


def by_code(queries: DataFrame, register: DataFrame, cap: int, lifecycles: tuple[str, ...] = ("current",)) -> DataFrame:
    """The same for queries that are codes; a historical name has no code and is not found."""
    allowed = register.filter(F.col("lifecycle").isin(*lifecycles) & F.col("code").isNotNull())
    hits = queries.select("query").distinct().join(small(allowed.select("id", "name", "code")), F.col("query") == F.col("code")).withColumn("sim", F.lit(1.0))
    return with_feature_confidence(ranked(hits.select("query", "id", "name", "sim"), cap, [F.desc("sim"), "id"], ["query"]))


def road_features(queries: DataFrame, streets: DataFrame, roads: DataFrame, cap: int, lifecycles: tuple[str, ...] = ("current",)) -> DataFrame:
    """Roads of the designations closest to each query (query, pin).

    The designations are cut to ``cap`` before the pin applies, and the roads after it.
    """
    sims = similarities(queries, streets, "query", "street_id", "folded_street").withColumnRenamed("id", "street_id")
    near = ranked(sims, cap, [F.desc("sim"), "street_id"], ["query"]).drop("rank")
    asked = queries.select("query", "pin").distinct().join(near, "query")
    hits = asked.join(roads.filter(F.col("lifecycle").isin(*lifecycles)), "street_id").filter(F.coalesce(F.arrays_overlap("postcodes", "pin"), F.lit(True)))
    return with_feature_confidence(ranked(hits, cap, [F.desc("sim"), "road_id"], ["query", "pin"]), "query", "pin")


def property_by_code(queries: DataFrame, properties: DataFrame, parcels: DataFrame, cap: int) -> DataFrame:
    """Properties with a number, and those with a parcel under a register code; the number wins, one row a property."""
    own = queries.join(properties.select("bfe"), F.col("query") == F.col("bfe")).select("query", "bfe", F.lit(0).alias("priority"))
    under = queries.join(parcels.select("bfe", "code"), F.col("query") == F.col("code")).select("query", "bfe", F.lit(1).alias("priority"))
    best = own.unionByName(under).groupBy("query", "bfe").agg(F.min("priority").alias("priority"))
    return ranked(best, cap, ["priority", "bfe"], ["query"])


def label_hits(queries: DataFrame, parcels: DataFrame, similarity_of, threshold: float = 0.6) -> DataFrame:
    """(query, the parcel's columns, sim) of parcels (folded) whose label holds the query to ``threshold`` or more, by ``similarity_of``.

    A stretch can only be that similar if it has that share of the query's trigrams, so it has one of the rarest of them: such
    a query shares one of its first trigrams, rarest first, with the label. Only labels that do are measured.
    """
    asked = queries.select("query").filter("query <> ''").distinct().withColumn("grams", trigrams(F.col("query")))
    labels = parcels.select("folded").filter("folded is not null").distinct().withColumn("grams", trigrams(F.col("folded")))
    posted = labels.select("folded", F.explode("grams").alias("gram"))
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("query", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(counts, "gram", "left")
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram")))
    # of size trigrams at least ceil(threshold * size) are in the label, so one of the first size - that + 1 is
    first = first.filter(F.col("at") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1)
    pairs = first.select("query", "gram").join(posted, "gram").select("query", "folded").distinct()
    near = pairs.withColumn("sim", similarity_of(F.col("query"), F.col("folded"))).filter(F.col("sim") >= threshold)
    return near.join(parcels, "folded")


def property_by_label(queries: DataFrame, parcels: DataFrame, similarity_of, cap: int, threshold: float = 0.6) -> DataFrame:
    """Parcels (bfe, parcel, folded) by word similarity of their label: an over-fetch, one row a property, then the cap."""
    pairs = label_hits(queries, parcels, similarity_of, threshold)
    wide = ranked(pairs, min(10 * cap, 1000), [F.desc("sim"), "bfe", "parcel"], ["query"]).drop("rank")
    one = ranked(wide, 1, [F.desc("sim"), "parcel"], ["query", "bfe"]).drop("rank")
    return with_feature_confidence(ranked(one, cap, [F.desc("sim"), "bfe"], ["query"]))


def projected(matches: DataFrame, value: str, cap: int) -> DataFrame:
    """Matches (qid, rank, confidence, ``value``) at a coarser layer: distinct values, best first, with one confidence.

    The leader's confidence: of its own match if only one match carries a value, A if all agree, B if
    most agree with the first, else C.
    """
    carried = matches.filter(F.col(value).isNotNull())
    first = F.min_by(value, "rank")
    stats = carried.groupBy("qid").agg(first.alias("top"), F.min_by("confidence", "rank").alias("own"), F.count(F.lit(1)).alias("n"))
    agree = carried.join(stats, "qid").groupBy("qid").agg(
        F.count_if(F.col(value) == F.col("top")).alias("agree"), F.first("n").alias("n"), F.first("own").alias("own")
    )
    label = F.when(F.col("n") == 1, F.col("own")).when(F.col("agree") == F.col("n"), "A").when(F.col("agree") * 2 > F.col("n"), "B").otherwise("C")
    values = carried.groupBy("qid", F.col(value).alias("value")).agg(F.min("rank").alias("best"))
    out = ranked(values, cap, ["best"], ["qid"]).join(agree.select("qid", label.alias("label")), "qid")
    return out.select("qid", "value", "rank", F.when(F.col("rank") == 1, F.col("label")).otherwise("C").alias("confidence"))


def with_area(values: DataFrame, areas: DataFrame) -> DataFrame:
    """Projected codes with their area's name; a code without an area is a feature of its own, named by the code."""
    return values.join(small(areas.select(F.col("code").alias("value"), "name")), "value", "left").withColumn("name", F.coalesce("name", "value")).withColumn("score", F.lit(1.0))


def property_card(properties: DataFrame, parcels: DataFrame) -> DataFrame:
    """Each property with its ground's parcel, children cut to what is shown, and whether that is all."""
    ground = properties.select(F.col("bfe").alias("ground_bfe"), F.col("parcel").alias("ground_parcel"))
    out = properties.join(ground, "ground_bfe", "left").withColumn("shown_parcel", F.coalesce("parcel", "ground_parcel"))
    out = out.join(parcels.select(F.col("parcel").alias("shown_parcel"), F.col("label")), "shown_parcel", "left")
    return out.withColumn("complete", F.size("children") <= CHILDREN_SHOWN).withColumn("children", F.slice("children", 1, CHILDREN_SHOWN))
