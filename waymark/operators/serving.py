"""What a caller asks and gets: checks of a request, dispatch to a register, shapes of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import best_of
from .gazetteer import by_code, by_name, property_by_code, road_features, with_feature_confidence
from .knn import ranked
from .resolve import LIFECYCLES, TOP
from .sized import small

# The most that a request may ask.
MOST_INPUT, MOST_COMPONENT, MOST_BATCH, MOST_MATCHES, MOST_HITS = 512, 128, 1000, 20, 100
# The address column that holds the code of each layer.
LAYER_COLUMNS = {
    "kommune": "municipality_code", "region": "region_code", "sogn": "parish_code", "retskreds": "court_code", "politikreds": "police_code",
    "opstillingskreds": "district_code", "ejendom": "property", "jordstykke": "parcel",
}
SRID = 25832


def rank_width(limit: int) -> int:
    """How many are ranked so that confidence sees the same rivals whatever is shown."""
    return max(limit, TOP)


def checked_request(components: dict[str, str], known: tuple[str, ...], lifecycles: tuple[str, ...] = ("current",), limit: int = TOP, most: int = MOST_MATCHES) -> None:
    """Stops a request that names unknown components or states, repeats a state, or asks for too much."""
    unknown = sorted(set(components) - set(known))
    if unknown:
        raise ValueError(f"unknown components: {', '.join(unknown)}")
    long = sorted(k for k, v in components.items() if len(v) > MOST_COMPONENT)
    if long:
        raise ValueError(f"components over {MOST_COMPONENT} characters: {', '.join(long)}")
    if not lifecycles or len(set(lifecycles)) < len(lifecycles) or not set(lifecycles) <= set(LIFECYCLES):
        raise ValueError("states must be known, and named once each")
    if not 1 <= limit <= most:
        raise ValueError(f"a limit lies between 1 and {most}")


def request_fault(text: Column, limit: Column) -> Column:
    """Why a row of a batch cannot be answered; null if it can. A bad row spoils no other."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "nothing is asked")
        .when(F.length(text) > MOST_INPUT, "the text is too long")
        .when(~limit.between(1, MOST_MATCHES), "the limit is out of range")
    )


def point_of(x: Column, y: Column) -> Column:
    """A GeoJSON point; null if either half is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))))


def display_point(access_x: Column, access_y: Column, road_x: Column, road_y: Column) -> Column:
    """The access point, else the road point."""
    return F.coalesce(point_of(access_x, access_y), point_of(road_x, road_y))


def property_name(kind: Column, label: Column, bfe: Column, unit: Column) -> Column:
    """The ground's parcel label, qualified for units and buildings on foreign ground; the number where there is no label."""
    own = F.concat(label, F.lit(", ejerlejlighed"), F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(""))
    building = F.concat(label, F.lit(", bygning på fremmed grund"))
    return F.when(F.coalesce(label, F.lit("")) == "", bfe).when(kind == "ejerlejlighed", own).when(kind == "bygning_paa_fremmed_grund", building).otherwise(label)


def geometry_block(geojson: Column, road_x: Column | None = None, road_y: Column | None = None) -> Column:
    """A geometry as JSON text, the GeoJSON spliced in as it is; null without one."""
    road = F.lit("null") if road_x is None else F.when(road_x.isNotNull() & road_y.isNotNull(), F.to_json(F.array(road_x, road_y))).otherwise("null")
    return F.when(geojson.isNotNull(), F.concat(F.lit(f'{{"srid":{SRID},"geojson":'), geojson, F.lit(',"vejpunkt":'), road, F.lit("}")))


def wire(matches: DataFrame, limit: int, query: str = "qid") -> DataFrame:
    """(query, answer): the first ``limit`` of the matches that were ranked, as one JSON text a query.

    ``matches`` has ``rank``, ``kind``, ``name``, ``lifecycle``, ``components`` (map), ``geometry`` (JSON text or null), ``score`` and ``confidence``.
    """
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias(c)))
    inner = lambda c: F.substring(quoted(c), 2, 1 << 30)
    fields = [F.expr("substring(s, 1, length(s) - 1)").alias("t")]
    one = matches.filter(F.col("rank") <= limit)
    for c in ("kind", "name", "lifecycle", "components", "score", "confidence"):
        one = one.withColumn("s", inner(c)).withColumn(f"_{c}", fields[0]).drop("s")
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.nullif(F.col(f"_{c}"), F.lit("")) for c in ("kind", "name", "lifecycle", "components", "score", "confidence")]), F.coalesce(F.concat(F.lit(',"geometry":'), F.col("geometry")), F.lit("")), F.lit("}"))
    # at most ``limit`` matches a query
    each = one.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("m"))
    return each.select(query, F.concat(F.lit('{"matches":['), F.array_join("m.text", ","), F.lit("]}")).alias("answer"))


def data_updated(seeded_at: Column) -> Column:
    return F.date_format(seeded_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_geometry(hits: DataFrame, register: DataFrame, key: str = "id") -> DataFrame:
    """Ranked hits with the geometry of what they hit: looked up for what is left only."""
    return hits.join(register.select(F.col(key), "geometry"), key, "left")


def cards_of(refs: DataFrame, properties: DataFrame, parcels: DataFrame) -> DataFrame:
    """(bfe, parcel) references with their property and the parcel that is shown: the reference's own, else that of the ground.

    ``properties`` (bfe, type, ground_bfe, parcel, lifecycle), ``parcels`` (parcel, label). References to unknown properties are left out.
    """
    ground = properties.select(F.col("bfe").alias("ground_bfe"), F.col("parcel").alias("_ground_parcel"))
    own = refs.select("bfe", F.col("parcel").alias("_asked"))
    out = own.join(properties.select("bfe", "type", "ground_bfe", "lifecycle"), "bfe").join(ground, "ground_bfe", "left")
    out = out.withColumn("shown_parcel", F.coalesce("_asked", "_ground_parcel"))
    return out.join(parcels.select(F.col("parcel").alias("shown_parcel"), "label"), "shown_parcel", "left").select("bfe", "type", "ground_bfe", "shown_parcel", "label", "lifecycle")


def property_by_code_shown(queries: DataFrame, properties: DataFrame, parcels: DataFrame, cap: int) -> DataFrame:
    """:func:`property_by_code`, with one parcel under the code for each property that was found by it."""
    hits = property_by_code(queries, properties, parcels, cap)
    under = best_of(parcels.select(F.col("bfe").alias("_bfe"), F.col("code").alias("_code"), F.col("parcel").alias("shown_parcel")), ["_bfe", "_code"], ["shown_parcel"])
    return hits.join(under, (F.col("priority") == 1) & (F.col("bfe") == F.col("_bfe")) & (F.col("query") == F.col("_code")), "left").drop("_bfe", "_code")


def property_by_past_label(hits: DataFrame, properties: DataFrame, lifecycles: tuple[str, ...], cap: int) -> DataFrame:
    """Properties by the similarity of a parcel's label, where a parcel or its property is in one of ``lifecycles``.

    ``hits`` (query, bfe, parcel, parcel_lifecycle, sim) is the over-fetch. A parcel that is not current and asked for shows its own
    state, else the property's counts. States are asked before each property is cut to its best parcel.
    """
    past = (F.col("parcel_lifecycle") != "current") & F.col("parcel_lifecycle").isin(*lifecycles)
    both = hits.join(properties.select("bfe", F.col("lifecycle").alias("_own")), "bfe").filter(past | F.col("_own").isin(*lifecycles))
    both = both.withColumn("lifecycle", F.when(past, F.col("parcel_lifecycle")).otherwise(F.col("_own")))
    one = ranked(both, 1, [F.desc("sim"), "parcel"], ["query", "bfe"]).drop("rank", "_own", "parcel_lifecycle")
    return with_feature_confidence(ranked(one, cap, [F.desc("sim"), "bfe"], ["query"]))


def layer_codes(addresses: DataFrame, ids: DataFrame, layer: str) -> DataFrame:
    """(address_id, code) of a layer, for the addresses in ``ids``; an unknown layer is an error."""
    if layer not in LAYER_COLUMNS:
        raise ValueError(f"unknown layer {layer}")
    return small(ids.select("address_id").distinct()).join(addresses.select("address_id", F.col(LAYER_COLUMNS[layer]).alias("code")), "address_id")


def resolve_features(asked: DataFrame, streets: DataFrame, roads: DataFrame, areas: dict[str, DataFrame], cap: int = TOP) -> DataFrame:
    """(qid, kind, id, name, rank, confidence) of queries without a house number.

    ``asked`` (qid, street, kind, value): a street goes to the roads, confined to ``value`` if ``kind`` is postcode; else a postcode is
    looked up by code and any other area by name, each in the register of its kind.
    """
    cap = rank_width(cap)
    on_street = asked.filter("street is not null")
    pinned = on_street.select("qid", F.col("street").alias("query"), F.when(F.col("kind") == "postcode", F.array("value")).alias("pin"))
    # a pin belongs to a query of its own: the register is asked once for each street and pin
    keyed = pinned.withColumn("asked", F.to_json(F.struct("query", "pin")))
    sims = road_features(keyed.select("query", "pin").distinct(), streets, roads, cap).withColumn("asked", F.to_json(F.struct("query", "pin")))
    named = sims.select("asked", "street_id", "road_id", "sim").join(streets.select("street_id", F.col("street").alias("name")), "street_id")
    hits = ranked(keyed.select("qid", "asked").join(named, "asked"), cap, [F.desc("sim"), "road_id"], ["qid"])
    out = with_feature_confidence(hits, "qid").select("qid", F.lit("street").alias("kind"), F.col("road_id").cast("string").alias("id"), "name", "rank", "confidence")
    for kind, register in areas.items():
        own = asked.filter(F.col("street").isNull() & (F.col("kind") == kind)).select("qid", F.col("value").alias("query"))
        hits = (by_code if kind == "postcode" else by_name)(own, register, cap)
        out = out.unionByName(own.join(hits, "query").select("qid", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name", "rank", "confidence"))
    return out


def search(asked: DataFrame, registers: dict[str, DataFrame], cap: int = TOP) -> DataFrame:
    """(qid, target, id, name, rank, confidence): each value in the register of its ``target``, by code if it is one and the register has codes, else by name.

    ``asked`` (qid, target, value, folded); ``registers`` have (id, name, folded, code, lifecycle).
    """
    from ..functions.text import is_code

    out = None
    for target, register in registers.items():
        own = asked.filter(F.col("target") == target)
        code = is_code(F.col("value")) if target not in ("street", "stednavne") else F.lit(False)
        for rows, query, find in ((own.filter(code), F.trim("value"), by_code), (own.filter(~code), F.col("folded"), by_name)):
            rows = rows.select("qid", query.alias("query"))
            one = rows.join(find(rows, register, cap), "query").select("qid", F.lit(target).alias("target"), "id", "name", "rank", "confidence")
            out = one if out is None else out.unionByName(one)
    return out
