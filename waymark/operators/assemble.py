"""Assembling the served tables from staged registers: addresses, parcels, roads, places.

Staged rows carry ``_deleted``. Register tables are dimensions of the address table and join by their ids; Spark
chooses each join by the sizes that it finds. Names of what is no longer in effect are those of its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import merge_polygons
from ..functions.text import normalize_ascii, split_house_number
from .build import address_lifecycle, as_of, best_of, parcel_lifecycle, place_lifecycle

#: States that show the name of their own time.
PAST = ("retired", "abandoned")


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not tombstones; an unknown flag is none."""
    return rows.filter(~F.coalesce(F.col("_deleted"), F.lit(False))).drop("_deleted")


def attach(rows: DataFrame, dimension: DataFrame, on: str, columns: dict[str, str], key: str = "id") -> DataFrame:
    """``rows`` with ``columns`` (own name to the dimension's) of the live row whose ``key`` is ``on``; nulls without one."""
    side = live(dimension).select(F.col(key).alias("_key"), *[F.col(c).alias(name) for name, c in columns.items()])
    return rows.join(side, F.col(on) == F.col("_key"), "left").drop("_key")


def address_rows(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """One row a unit address whose access address exists, with names, points, district codes, parcel and property.

    ``tables``: ``unit`` (id, access, floor, door, status, effect_from, effect_until), ``access`` (id, number, street, postcode,
    locality, point, road_point, municipality, parish, parcel), ``street`` (id, name), ``postcode`` (id, code,
    name), ``locality`` (id, name), ``point`` (id, x, y), ``municipality`` (id, code, region), ``region`` and ``parish``
    (id, code), ``parcel`` (id, property), ``unit_property`` (address, property, type), and the histories
    ``street_names`` and ``postcode_names`` (id, name, effect_from, effect_until); all but the histories with ``_deleted``.
    """
    access = live(tables["access"]).withColumnRenamed("id", "access_id")
    out = live(tables["unit"]).join(access, F.col("access") == F.col("access_id"))
    out = attach(out, tables["street"], "street", {"street_now": "name"})
    out = attach(out, tables["postcode"], "postcode", {"postcode_code": "code", "city_now": "name"})
    out = attach(out, tables["locality"], "locality", {"sub_locality": "name"})
    out = attach(out, tables["point"], "point", {"access_x": "x", "access_y": "y"})
    out = attach(out, tables["point"], "road_point", {"road_x": "x", "road_y": "y"})
    out = attach(out, tables["municipality"], "municipality", {"municipality_code": "code", "_region": "region"})
    out = attach(out, tables["region"], "_region", {"region_code": "code"})
    out = attach(out, tables["parish"], "parish", {"parish_code": "code"})
    out = attach(out, tables["parcel"], "parcel", {"served_parcel": "id", "_ground": "property"})
    # a property counts as a unit's only if it is one; then the smallest number of several
    units = live(tables["unit_property"]).filter("type = 'unit' and address is not null").groupBy("address").agg(F.min("property").alias("_own"))
    out = out.join(units.withColumnRenamed("address", "_address"), F.col("id") == F.col("_address"), "left")
    out = out.withColumn("lifecycle", address_lifecycle(F.col("status"), F.col("effect_from"), F.col("effect_until"), now))
    for column, key, history in (("street", "street", "street_names"), ("city", "postcode", "postcode_names")):
        then = as_of(out.select("id", key, "effect_from").withColumnRenamed("effect_from", "at"), tables[history].withColumnRenamed("id", key), key, "at", "id", ["name"])
        out = out.join(then.select(F.col("id").alias("_then"), F.col("name").alias(f"{column}_then")), F.col("id") == F.col("_then"), "left").drop("_then")
    past = F.col("lifecycle").isin(*PAST)
    number, letter = split_house_number(F.col("number"))
    shown = {c: F.when(past, F.coalesce(f"{c}_then", f"{c}_now")).otherwise(F.col(f"{c}_now")) for c in ("street", "city")}
    return out.select(
        F.col("id").alias("address_id"), shown["street"].alias("street"), number.alias("house_number"), letter.alias("house_letter"), "floor", "door", "sub_locality",
        F.col("postcode_code").alias("postcode"), F.coalesce(shown["city"], F.lit("")).alias("city"), "lifecycle", "access_x", "access_y", "road_x", "road_y", "municipality_code", "region_code",
        "parish_code", F.col("served_parcel").alias("parcel"), F.coalesce("_own", "_ground").alias("property"),
    )


def guarded(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The addresses that have a street, a number and a postcode, and one row that counts those (``kept``, ``skipped``)."""
    whole = F.lit(True)
    for c in ("street", "house_number", "postcode"):
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return addresses.filter(whole), addresses.agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("skipped"))


def parcel_rows(parcels: DataFrame, properties: DataFrame, districts: DataFrame, centroids: DataFrame, parts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Parcels with property, district, centroid and merged geometry, and one row of counts of what is left out.

    A current parcel needs a geometry, one that is not keeps its place without; either needs a property. The district's
    code may be its id if that is all digits. ``parcels`` (id, number, property, district, status, effect_from, effect_until),
    ``properties`` (id, bfe), ``districts`` (id, code, name), ``centroids`` (parcel, centroid), ``parts`` (parcel, geometry).
    """
    out = attach(live(parcels), properties, "property", {"bfe": "bfe"})
    side = districts.withColumn("code", F.coalesce("code", F.when(F.col("id").rlike("^[0-9]+$"), F.col("id"))))
    out = attach(out, side, "district", {"district_code": "code", "district_name": "name"})
    out = attach(out, centroids, "id", {"centroid": "centroid"}, key="parcel")
    shapes = merge_polygons(live(parts).filter("geometry is not null and parcel is not null"), ["parcel"], "geometry")
    out = out.join(shapes.withColumnRenamed("parcel", "_parcel"), F.col("id") == F.col("_parcel"), "left").drop("_parcel")
    out = out.withColumn("lifecycle", parcel_lifecycle(F.col("status"), F.col("effect_from"), F.col("effect_until"), now))
    bare = F.col("geometry").isNull() & (F.col("lifecycle") == "current")
    homeless = ~bare & (F.coalesce(F.col("bfe"), F.lit("")) == "")
    counts = out.agg(F.count_if(bare).alias("without_geometry"), F.count_if(homeless).alias("without_property"), F.count_if(~bare & ~homeless).alias("kept"))
    return out.filter(~bare & ~homeless).select("id", "number", "bfe", "district_code", "district_name", "centroid", "geometry", "lifecycle"), counts


def gathered_parts(parts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, parts, n): every part of each key, repeats kept, in a fixed order. As many as one parcel has parts."""
    return parts.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("parts"), F.count(F.lit(1)).alias("n"))


def road_rows(streets: DataFrame, access: DataFrame, postcodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """(road_id, street_id, postcodes, geometry, lifecycle) of the named roads with an access address in a live postcode and a served name.

    Postcodes are gathered by the road's id alone; its geometry joins afterwards.
    """
    found = attach(live(access), postcodes, "postcode", {"code": "code"}).filter("street is not null and code is not null")
    sets = found.groupBy("street").agg(F.array_sort(F.collect_set("code")).alias("postcodes"))
    out = live(streets).filter("name is not null").join(sets, F.col("id") == F.col("street"))
    out = out.withColumn("folded", normalize_ascii(F.col("name"))).join(ids.select("street_id", F.col("folded_street").alias("folded")), "folded")
    return out.select(F.col("id").alias("road_id"), "street_id", "postcodes", "geometry", address_lifecycle(F.col("status"), F.col("effect_from"), F.col("effect_until"), now).alias("lifecycle"))


def place_rows(names: DataFrame, shapes: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """(id, name, folded, type, geometry, lifecycle): each name with the geometry of the first table that has its place.

    ``names`` (id, place, name, status), ``shapes``: type and table (place, geometry) in order of precedence; None is a table that is absent.
    """
    every = None
    for rank, (kind, table) in enumerate(shapes):
        if table is not None:
            one = live(table).filter("geometry is not null").select("place", "geometry", F.lit(kind).alias("type"), F.lit(rank).alias("rank"))
            every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no table of geometries")
    best = best_of(every, ["place"], ["rank", "geometry"]).drop("rank")
    out = live(names).filter("name is not null").join(best, "place")
    return out.select("id", "name", normalize_ascii(F.col("name")).alias("folded"), "type", "geometry", place_lifecycle(F.col("status")).alias("lifecycle"))


def access_points(access: DataFrame, points: DataFrame) -> DataFrame:
    """(id, x, y) of the access addresses whose point has both coordinates."""
    found = attach(live(access), points, "point", {"x": "x", "y": "y"})
    return found.filter("x is not null and y is not null").select("id", "x", "y")


def disagreements(units: DataFrame, access: DataFrame, now: Column) -> DataFrame:
    """One row: of all unit addresses with an access address, how many are in another state than it."""
    state = address_lifecycle(F.col("status"), F.col("effect_from"), F.col("effect_until"), now)
    u = live(units).select("access", state.alias("own"))
    a = live(access).select(F.col("id").alias("access"), state.alias("theirs"))
    return u.join(a, "access").agg(F.count_if(F.col("own") != F.col("theirs")).alias("bad"), F.count(F.lit(1)).alias("total"))


def integrity_report(tables: dict[str, DataFrame], shapes: tuple[str, ...] = ()) -> DataFrame:
    """(table, lifecycle, rows, without_geometry) of the served tables, for people to read; ``shapes`` names those that have geometry."""
    out = None
    for name, table in sorted(tables.items()):
        bare = F.count_if(F.col("geometry").isNull()) if name in shapes else F.lit(None).cast("long")
        one = table.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("rows"), bare.alias("without_geometry")).select(F.lit(name).alias("table"), "lifecycle", "rows", "without_geometry")
        out = one if out is None else out.unionByName(one)
    return out


def run_lanes(lanes: list[list]) -> list:
    """Runs each lane's steps in order and the lanes side by side; the first failure is raised once all have ended.

    A step is a function without arguments. Spark schedules what the lanes submit, so a lane is a thread of the driver.
    """
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, len(lanes))) as pool:
        running = [pool.submit(lambda lane=lane: [step() for step in lane]) for lane in lanes]
    return [r.result() for r in running]
