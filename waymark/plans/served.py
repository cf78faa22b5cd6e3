"""Queries on assembling the served tables, on answers, and on planning and validation.

Orders stand in for unit addresses, customers for access addresses and parcels, nations for streets, postcodes and municipalities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import assemble, changes, evaluate, serving
from ..sources import store
from .registry import query, read

NOW = "TIMESTAMP '1998-06-01 00:00:00'"
STATE = f"CASE WHEN {{0}}f > {NOW} THEN 'preliminary' WHEN {{0}}st IS NULL OR {{0}}st = '3' THEN 'current' WHEN {{0}}st = '4' THEN 'retired' WHEN {{0}}st = '2' THEN 'preliminary' WHEN {{0}}st = '5' THEN 'abandoned' WHEN {{0}}u IS NULL THEN 'current' ELSE 'retired' END"


def now():
    return F.expr(NOW)


def _status(key):
    return F.element_at(F.array(*[F.lit(x) for x in ("2", "3", "4", "5", "9", None)]), (key % 6 + 1).cast("int"))


STATUS = "['2', '3', '4', '5', '9', NULL][{0} % 6 + 1]"


def registers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    o, c, n, r, li = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    day = lambda d, k: d + F.expr(f"INTERVAL {k} DAY")
    gone = lambda key, m: (F.col(key) % m == 0).alias("_deleted")
    text = lambda c: F.col(c).cast("string")
    start = F.lit("1995-01-01").cast("timestamp")
    nation = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (1000 + F.col("n_nationkey")).cast("string").alias("code"), F.col("n_regionkey").alias("region"), gone("n_nationkey", 11))
    past = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Old "), "n_name").alias("name"), F.lit(None).cast("timestamp").alias("effect_from"), start.alias("effect_until")).unionByName(
        n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Late "), "n_name").alias("name"), start.alias("effect_from"), F.lit(None).cast("timestamp").alias("effect_until"))
    )
    key = F.col("c_custkey")
    return {
        "unit": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("access"), F.when(F.col("o_orderkey") % 3 == 0, "1").alias("floor"), F.lit(None).cast("string").alias("door"), _status(F.col("o_orderkey")).alias("status"), F.col("o_orderdate").alias("effect_from"), F.when(F.col("o_custkey") % 2 == 0, day(F.col("o_orderdate"), 30)).alias("effect_until"), gone("o_orderkey", 13)),
        "access": c.select(key.alias("id"), F.when(key % 17 != 0, F.concat(text("c_nationkey"), F.when(key % 2 == 0, "B").otherwise(""))).alias("number"), F.col("c_nationkey").alias("street"), F.col("c_nationkey").alias("postcode"), (key % 7).alias("locality"), key.alias("point"), (key + 1).alias("road_point"), F.col("c_nationkey").alias("municipality"), F.col("c_nationkey").alias("parish"), key.alias("parcel"), gone("c_custkey", 19)),
        "street": nation, "postcode": nation, "municipality": nation, "parish": nation,
        "locality": r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("boolean").alias("_deleted")),
        "region": r.select(F.col("r_regionkey").alias("id"), text("r_regionkey").alias("code"), F.lit(False).alias("_deleted")),
        "point": c.select(key.alias("id"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("x"), (F.col("c_acctbal") + 1).alias("y"), gone("c_custkey", 23)),
        "parcel": c.filter("c_custkey % 3 = 0").select(key.alias("id"), F.concat(F.lit("G"), text("c_nationkey")).alias("property"), F.lit(False).alias("_deleted")),
        "unit_property": li.select(F.col("l_orderkey").alias("address"), F.concat(F.lit("U"), text("l_partkey")).alias("property"), F.when(F.col("l_linenumber") == 2, "unit").otherwise("other").alias("type"), (F.col("l_partkey") % 10 == 0).alias("_deleted")),
        "street_names": past, "postcode_names": past,
    }


ADDRESSES = f"""
u AS (SELECT o_orderkey AS id, o_custkey AS access, CASE WHEN o_orderkey % 3 = 0 THEN '1' END AS floor, {STATUS.format("o_orderkey")} AS st, o_orderdate AS f, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS u FROM orders WHERE o_orderkey % 13 <> 0),
n AS (SELECT n_nationkey AS id, n_name AS name, CAST(1000 + n_nationkey AS VARCHAR) AS code, n_regionkey AS region FROM nation WHERE n_nationkey % 11 <> 0),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS x, c_acctbal + 1 AS y FROM customer WHERE c_custkey % 23 <> 0),
h AS (SELECT n_nationkey AS id, 'Old ' || n_name AS name, NULL::TIMESTAMP AS ef, TIMESTAMP '1995-01-01' AS eu FROM nation UNION ALL SELECT n_nationkey, 'Late ' || n_name, TIMESTAMP '1995-01-01', NULL FROM nation WHERE n_nationkey % 2 = 0),
own AS (SELECT l_orderkey, min('U' || l_partkey) AS bfe FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 10 <> 0 GROUP BY l_orderkey),
j AS (SELECT u.*, c.c_custkey, c_nationkey, CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS num, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 2 = 0 THEN 'B' END AS letter, {STATE.format("")} AS lifecycle FROM u JOIN customer c ON c_custkey = access AND c_custkey % 19 <> 0),
k AS (SELECT j.*, n.name AS nname, n.code, n.region, (SELECT arg_max(h.name, coalesce(h.ef, TIMESTAMP '0001-01-01')) FROM h WHERE h.id = j.c_nationkey AND (h.ef IS NULL OR h.ef <= j.f) AND (h.eu IS NULL OR h.eu > j.f)) AS pname FROM j LEFT JOIN n ON n.id = c_nationkey),
addr AS (SELECT k.id AS address_id, CASE WHEN lifecycle IN ('retired', 'abandoned') THEN coalesce(pname, nname) ELSE nname END AS street, num AS house_number, letter AS house_letter, floor, r_name AS sub_locality, k.code AS postcode,
  coalesce(CASE WHEN lifecycle IN ('retired', 'abandoned') THEN coalesce(pname, nname) ELSE nname END, '') AS city, lifecycle, a.x AS access_x, a.y AS access_y, b.x AS road_x, b.y AS road_y, k.code AS municipality_code, CAST(k.region AS VARCHAR) AS region_code,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS parcel, coalesce(own.bfe, CASE WHEN c_custkey % 3 = 0 THEN 'G' || c_nationkey END) AS property
  FROM k LEFT JOIN p a ON a.id = c_custkey LEFT JOIN p b ON b.id = c_custkey + 1 LEFT JOIN region ON r_regionkey = c_custkey % 7 LEFT JOIN own ON own.l_orderkey = k.id)"""
SHOWN = "address_id, street, house_number, house_letter, floor, sub_locality, postcode, city, lifecycle, access_x, access_y, road_x, road_y, municipality_code, region_code, parcel, property"


@query("address_assembly", f"WITH {ADDRESSES} SELECT {SHOWN} FROM addr WHERE street IS NOT NULL AND house_number IS NOT NULL AND postcode IS NOT NULL")
def address_assembly(spark, sf):
    return assemble.guarded(assemble.address_rows(registers(spark, sf), now()))[0].select(*SHOWN.split(", "))


@query("address_guard", f"WITH {ADDRESSES} SELECT count(*) FILTER (street IS NOT NULL AND house_number IS NOT NULL AND postcode IS NOT NULL) AS kept, count(*) FILTER (street IS NULL OR house_number IS NULL OR postcode IS NULL) AS skipped FROM addr")
def address_guard(spark, sf):
    return assemble.guarded(assemble.address_rows(registers(spark, sf), now()))[1]


@query("layer_codes", f"WITH {ADDRESSES} SELECT address_id, region_code AS code FROM addr WHERE address_id % 10 = 0")
def layer_codes(spark, sf):
    rows = assemble.address_rows(registers(spark, sf), now())
    return serving.layer_codes(rows, read(spark, sf, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("address_id")), "region")


@query("display_points", f"WITH {ADDRESSES} SELECT address_id, CASE WHEN access_x IS NOT NULL AND access_y IS NOT NULL THEN round(access_x, 4) ELSE CASE WHEN road_y IS NOT NULL THEN round(road_x, 4) END END AS x FROM addr")
def display_points(spark, sf):
    rows = assemble.address_rows(registers(spark, sf), now())
    shown = serving.display_point(*[F.col(c) for c in ("access_x", "access_y", "road_x", "road_y")])
    return rows.select("address_id", F.round(F.get_json_object(shown, "$.coordinates[0]").cast("double"), 4).alias("x"))


@query("access_points", "SELECT c.c_custkey AS id, c.c_acctbal AS x, c.c_acctbal + 1 AS y FROM customer c WHERE c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 5 <> 0")
def access_points(spark, sf):
    t = registers(spark, sf)
    return assemble.access_points(t["access"], t["point"])


@query("lifecycle_disagreement", f"WITH u AS (SELECT o_custkey AS access, {STATUS.format('o_orderkey')} AS st, o_orderdate AS f, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS u FROM orders WHERE o_orderkey % 13 <> 0), a AS (SELECT c_custkey AS id, {STATUS.format('c_nationkey')} AS st, TIMESTAMP '1995-01-01' AS f, NULL::TIMESTAMP AS u FROM customer WHERE c_custkey % 19 <> 0) SELECT count(*) FILTER ({STATE.format('u.')} <> {STATE.format('a.')}) AS bad, count(*) AS total FROM u JOIN a ON a.id = u.access")
def lifecycle_disagreement(spark, sf):
    t = registers(spark, sf)
    access = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), _status(F.col("c_nationkey")).alias("status"), F.lit("1995-01-01").cast("timestamp").alias("effect_from"), F.lit(None).cast("timestamp").alias("effect_until"), (F.col("c_custkey") % 19 == 0).alias("_deleted"))
    return assemble.disagreements(t["unit"], access, now())


@query("integrity_report", f"WITH {ADDRESSES} SELECT 'addresses' AS \"table\", lifecycle, count(*) AS rows, count(*) FILTER (access_x IS NULL) AS without_geometry FROM addr GROUP BY lifecycle")
def integrity_report(spark, sf):
    rows = assemble.address_rows(registers(spark, sf), now()).withColumn("geometry", F.col("access_x").cast("string"))
    return assemble.integrity_report({"addresses": rows}, ("addresses",))


def _square(x, size=1):
    corner = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), F.lit(str(dy)), F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0)), F.lit("]]}"))


@query("parcel_build", f"""WITH j AS (SELECT c_custkey AS id, c_mktsegment AS number, c_nationkey, {STATUS.format('c_custkey')} AS s0, TIMESTAMP '1995-01-01' AS f FROM customer WHERE c_custkey % 19 <> 0),
  l AS (SELECT *, CASE s0 WHEN '3' THEN 'current' WHEN '4' THEN 'retired' WHEN '2' THEN 'preliminary' WHEN '5' THEN 'abandoned' ELSE 'current' END AS lifecycle FROM j),
  g AS (SELECT o_custkey, count(*) AS parts FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 4 = 0 GROUP BY o_custkey)
  SELECT l.id, number, 'P' || n_nationkey AS bfe, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'd' || n_nationkey END AS district_code, n_name AS district_name, CASE WHEN l.id % 2 = 0 THEN l.id || ' 1' END AS centroid, coalesce(parts, 0) AS parts, lifecycle
  FROM l JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 7 <> 0 LEFT JOIN g ON o_custkey = l.id WHERE parts IS NOT NULL OR lifecycle <> 'current'""")
def parcel_build(spark, sf):
    c, n, o = (read(spark, sf, t) for t in ("customer", "nation", "orders"))
    key, status = F.col("c_custkey"), _status(F.col("c_custkey"))
    words = F.create_map(*[F.lit(x) for x in ("2", "Foreløbig", "3", "Gældende", "4", "Historisk", "5", "Ikke gennemført", "9", "x")])
    parcels = c.select(key.alias("id"), F.col("c_mktsegment").alias("number"), F.col("c_nationkey").alias("property"), F.col("c_nationkey").cast("string").alias("district"), F.element_at(words, status).alias("status"), F.lit("1995-01-01").cast("timestamp").alias("effect_from"), F.lit(None).cast("timestamp").alias("effect_until"), (key % 19 == 0).alias("_deleted"))
    live = F.lit(False).alias("_deleted")
    properties = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("bfe"), (F.col("n_nationkey") % 7 == 0).alias("_deleted"))
    districts = n.select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))).alias("code"), F.col("n_name").alias("name"), live)
    centroids = c.filter("c_custkey % 2 = 0").select(key.alias("parcel"), F.concat(key.cast("string"), F.lit(" 1")).alias("centroid"), live)
    parts = o.filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("parcel"), _square(F.col("o_orderkey")).alias("geometry"), (F.col("o_orderkey") % 13 == 0).alias("_deleted"))
    rows, _ = assemble.parcel_rows(parcels, properties, districts, centroids, parts, now())
    found = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<string>")
    n_parts = F.when(F.col("geometry").isNull(), 0).when(F.get_json_object("geometry", "$.type") == "Polygon", 1).otherwise(F.size(found)).cast("long")
    return rows.select("id", "number", "bfe", "district_code", "district_name", "centroid", n_parts.alias("parts"), "lifecycle")


@query("gathered_parts", "SELECT o_custkey AS parcel, array_to_string(list(o_orderstatus ORDER BY o_orderstatus), '') AS parts, count(*) AS n FROM orders GROUP BY o_custkey")
def gathered_parts(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("parcel"), "o_orderstatus")
    return assemble.gathered_parts(rows, "parcel", "o_orderstatus").withColumn("parts", F.array_join("parts", ""))


@query("road_build", f"WITH a AS (SELECT DISTINCT c_nationkey AS s, CAST(1000 + c_nationkey AS VARCHAR) AS code FROM customer WHERE c_custkey % 19 <> 0 AND c_nationkey % 11 <> 0), x AS (SELECT n_nationkey AS id, n_name, {STATUS.format('n_nationkey')} AS st, TIMESTAMP '1995-01-01' AS f, NULL::TIMESTAMP AS u, row_number() OVER (ORDER BY lower(n_name)) - 1 AS street_id FROM nation) SELECT id AS road_id, CAST(street_id AS INTEGER) AS street_id, code AS postcodes, {STATE.format('')} AS lifecycle FROM x JOIN a ON a.s = id WHERE id % 11 <> 0")
def road_build(spark, sf):
    from ..operators.build import street_ids

    t, n = registers(spark, sf), read(spark, sf, "nation")
    streets = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), _status(F.col("n_nationkey")).alias("status"), F.lit("1995-01-01").cast("timestamp").alias("effect_from"), F.lit(None).cast("timestamp").alias("effect_until"), F.lit("x").alias("geometry"), (F.col("n_nationkey") % 11 == 0).alias("_deleted"))
    ids = street_ids(n.select(F.col("n_name").alias("name"), F.lit(1).alias("rank")))
    out = assemble.road_rows(streets, t["access"], t["postcode"], ids, now())
    return out.select("road_id", "street_id", F.array_join("postcodes", ",").alias("postcodes"), "lifecycle")


@query("place_build", "SELECT p_partkey AS id, p_name AS name, lower(p_name) AS folded, CASE WHEN p_size % 2 = 0 THEN 'even' WHEN p_size % 3 = 0 THEN 'third' ELSE 'any' END AS type, CASE WHEN p_partkey % 4 = 0 THEN 'retired' ELSE 'current' END AS lifecycle FROM part WHERE p_partkey % 9 <> 0 AND (p_size % 2 = 0 OR p_size % 3 = 0 OR p_size > 25)")
def place_build(spark, sf):
    p = read(spark, sf, "part")
    live = F.lit(False).alias("_deleted")
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("place"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, "historisk").alias("status"), (F.col("p_partkey") % 9 == 0).alias("_deleted"))
    places = p.select(F.col("p_size").alias("place"), F.lit("g").alias("geometry"), live).distinct()
    shapes = [("even", places.filter("place % 2 = 0")), ("gone", None), ("third", places.filter("place % 3 = 0")), ("any", places.filter("place > 25"))]
    return assemble.place_rows(names, shapes).drop("geometry")


@query("property_names", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'B' || c_custkey WHEN c_custkey % 3 = 1 THEN c_mktsegment || ', ejerlejlighed' || CASE WHEN c_custkey % 2 = 0 THEN ' 7' ELSE '' END WHEN c_custkey % 3 = 2 THEN c_mktsegment || ', bygning på fremmed grund' ELSE c_mktsegment END AS name FROM customer")
def property_names(spark, sf):
    key = F.col("c_custkey")
    kind = F.when(key % 3 == 1, "ejerlejlighed").when(key % 3 == 2, "bygning_paa_fremmed_grund").otherwise("samlet_fast_ejendom")
    name = serving.property_name(kind, F.when(key % 6 != 0, F.col("c_mktsegment")), F.concat(F.lit("B"), key.cast("string")), F.when(key % 2 == 0, "7"))
    return read(spark, sf, "customer").select("c_custkey", name.alias("name"))


@query("wire_answers", """WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders QUALIFY rank <= 2)
  SELECT o_custkey AS qid, '{"matches":[' || string_agg('{"kind":"address","name":"' || o_orderpriority || '","lifecycle":"current","components":{"id":"' || o_orderkey || '"},"score":1.5,"confidence":"C"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"geometry":{"srid":25832,"geojson":{"type":"Point"},"vejpunkt":null}' ELSE '' END || '}', ',' ORDER BY rank) || ']}' AS answer FROM m GROUP BY o_custkey""")
def wire_answers(spark, sf):
    from ..operators.knn import ranked

    o = ranked(read(spark, sf, "orders").withColumnRenamed("o_custkey", "qid"), 5, ["o_orderkey"], ["qid"])
    shape = serving.geometry_block(F.when(F.col("o_orderkey") % 2 == 0, '{"type":"Point"}'))
    m = o.select("qid", "rank", F.lit("address").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("current").alias("lifecycle"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")).alias("components"), shape.alias("geometry"), F.lit(1.5).alias("score"), F.lit("C").alias("confidence"))
    return serving.wire(m, 2)


@query("freshness", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated FROM orders")
def freshness(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", serving.data_updated(F.col("o_orderdate")).alias("updated"))


@query("property_references", "WITH p AS (SELECT c_custkey AS bfe, c_custkey // 2 AS g, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS parcel FROM customer), r AS (SELECT DISTINCT o_custkey AS bfe, CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 25 END AS ctx FROM orders) SELECT r.bfe, coalesce(ctx, q.parcel) AS shown_parcel, n_name AS label FROM r JOIN p ON p.bfe = r.bfe LEFT JOIN p q ON q.bfe = p.g LEFT JOIN nation ON n_nationkey = coalesce(ctx, q.parcel)")
def property_references(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("bfe"), F.lit("x").alias("type"), F.floor(F.col("c_custkey") / 2).alias("ground_bfe"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("parcel"), F.lit("current").alias("lifecycle"))
    refs = read(spark, sf, "orders").select(F.col("o_custkey").alias("bfe"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 25).alias("parcel")).distinct()
    parcels = read(spark, sf, "nation").select(F.col("n_nationkey").alias("parcel"), F.col("n_name").alias("label"))
    return serving.cards_of(refs, c, parcels).select("bfe", "shown_parcel", "label")


@query("property_history", """WITH h AS (SELECT o_orderpriority AS query, o_custkey AS bfe, o_orderkey AS parcel, ['current', 'retired', 'abandoned'][o_orderkey % 3 + 1] AS lc, o_totalprice / 1000000 AS sim FROM orders),
  e AS (SELECT c_custkey AS bfe, CASE WHEN c_custkey % 4 = 0 THEN 'retired' ELSE 'current' END AS own FROM customer),
  q AS (SELECT h.query, h.bfe, parcel, sim, CASE WHEN lc = 'retired' THEN lc ELSE own END AS lifecycle FROM h JOIN e ON e.bfe = h.bfe WHERE lc = 'retired' OR own = 'retired'),
  d AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query, bfe ORDER BY sim DESC, parcel) = 1)
  SELECT query, bfe, parcel, lifecycle, row_number() OVER (PARTITION BY query ORDER BY sim DESC, bfe) AS rank FROM d QUALIFY rank <= 10""")
def property_history(spark, sf):
    o = read(spark, sf, "orders")
    lc = F.element_at(F.array(*[F.lit(x) for x in ("current", "retired", "abandoned")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    hits = o.select(F.col("o_orderpriority").alias("query"), F.col("o_custkey").alias("bfe"), F.col("o_orderkey").alias("parcel"), lc.alias("parcel_lifecycle"), (F.col("o_totalprice") / 1000000).alias("sim"))
    properties = read(spark, sf, "customer").select(F.col("c_custkey").alias("bfe"), F.when(F.col("c_custkey") % 4 == 0, "retired").otherwise("current").alias("lifecycle"))
    return serving.property_by_past_label(hits, properties, ("retired",), 10).select("query", "bfe", "parcel", "lifecycle", "rank")


@query("request_faults", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'nothing is asked' WHEN length(text) > 512 THEN 'the text is too long' WHEN doc_id % 25 NOT BETWEEN 1 AND 20 THEN 'the limit is out of range' END AS fault FROM documents")
def request_faults(spark, sf):
    return read(spark, sf, "documents").select("doc_id", serving.request_fault(F.col("text"), F.col("doc_id") % 25).alias("fault"))


def _areas(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("folded"), F.col("n_nationkey").cast("string").alias("code"), F.lit("current").alias("lifecycle"))
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("folded"), F.lit(None).cast("string").alias("code"), F.lit("current").alias("lifecycle"))
    return {"postcode": n, "region": r}


@query("resolve_features", "SELECT c_custkey AS qid, CASE WHEN c_custkey % 3 = 1 THEN 'postcode' ELSE 'region' END AS kind, CAST(CASE WHEN c_custkey % 3 = 1 THEN n_nationkey ELSE n_regionkey END AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 1 THEN n_name ELSE r_name END AS name, 1 AS rank, 'A' AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'street', CAST(n_nationkey AS VARCHAR), n_name, 1, 'A' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0")
def resolve_features(spark, sf):
    """Each customer asks for a street, a postcode or a region by its exact name or code; the best answer of each is returned."""
    c, areas = read(spark, sf, "customer"), _areas(spark, sf)
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    key = F.col("c_custkey") % 3
    full = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    asked = full.select(F.col("c_custkey").alias("qid"), F.when(key == 0, F.lower("n_name")).alias("street"), F.when(key == 1, "postcode").when(key == 2, "region").alias("kind"), F.when(key == 1, F.col("n_nationkey").cast("string")).when(key == 2, F.lower("r_name")).alias("value"))
    streets = n.select(F.col("n_nationkey").alias("street_id"), F.col("n_name").alias("street"), F.lower("n_name").alias("folded_street"))
    roads = n.select(F.col("n_nationkey").alias("road_id"), F.col("n_nationkey").alias("street_id"), F.array(F.col("n_nationkey").cast("string")).alias("postcodes"), F.lit("current").alias("lifecycle"))
    return serving.resolve_features(asked, streets, roads, areas).filter("rank = 1")


@query("search_targets", "SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'postcode' ELSE 'region' END AS target, CASE WHEN c_custkey % 2 = 0 THEN n_nationkey ELSE n_regionkey END AS id, 1 AS rank, 'A' AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey")
def search_targets(spark, sf):
    full = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("c_custkey") % 2 == 0
    value = F.when(even & (F.col("c_custkey") % 4 == 0), F.col("n_nationkey").cast("string")).when(even, F.col("n_name")).otherwise(F.col("r_name"))
    asked = full.select(F.col("c_custkey").alias("qid"), F.when(even, "postcode").otherwise("region").alias("target"), value.alias("value"), F.lower(value).alias("folded"))
    return serving.search(asked, _areas(spark, sf)).filter("rank = 1").drop("name")


CURSORS = "c AS (SELECT o_orderpriority AS entity, max(o_custkey) AS cursor, 'x' AS contract FROM orders GROUP BY ALL)"


def _cursors(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity")).agg(F.max("o_custkey").alias("cursor")).withColumn("contract", F.lit("x"))


@query("needs_build", f"WITH {CURSORS} SELECT count(*) FILTER (entity LIKE '%O%') AS moved, false AS reshaped, count(*) FILTER (entity LIKE '%O%') > 0 AS build FROM c")
def needs_build(spark, sf):
    c = _cursors(spark, sf)
    then = c.withColumn("contract", F.when(F.col("entity").contains("O"), "w").otherwise(F.col("contract")))
    return changes.needs_build(c, then, "s", "s")


@query("stamped_watermark", f"WITH {CURSORS} SELECT entity, CASE WHEN entity LIKE '%O%' THEN cursor + 1 ELSE cursor END AS cursor, contract FROM c")
def stamped_watermark(spark, sf):
    c = _cursors(spark, sf)
    return store.stamped(c, c.filter(F.col("entity").contains("O")).withColumn("cursor", F.col("cursor") + 1))


@query("swap_rule", "SELECT o_orderkey, o_custkey % 3 > 0 AND o_orderkey % 4 <> o_custkey % 4 AND o_custkey % 5 >= o_orderkey % 5 AS swap FROM orders")
def swap_rule(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select("o_orderkey", changes.should_swap(k % 4, k % 5, F.when(c % 3 > 0, c % 4), c % 5).alias("swap"))


@query("delta_lineage", "WITH d AS (SELECT o_orderpriority AS entity, o_custkey % 3 AS version, o_custkey // 3 AS generation, o_orderkey AS file, o_totalprice AS bytes FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 < 2) SELECT entity, generation, min(file) AS file FROM (SELECT * FROM d QUALIFY version = max(version) OVER (PARTITION BY entity)) GROUP BY ALL")
def delta_lineage(spark, sf):
    d = read(spark, sf, "orders").filter("o_orderkey % 2 = 0 or o_custkey % 3 < 2").select(F.col("o_orderpriority").alias("entity"), (F.col("o_custkey") % 3).alias("version"), F.floor(F.col("o_custkey") / 3).alias("generation"), F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("bytes"), F.lit(1).alias("page"), F.lit(1).alias("of_pages"))
    return changes.lineage(changes.listing(d), ["entity"]).select("entity", "generation", "file")


@query("baseline_cursors", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 50 <= least(greatest(o_orderkey % 60 - 3, 0), o_custkey % 40) + 1 THEN least(greatest(o_orderkey % 60 - 3, 0), o_custkey % 40) END AS cursor FROM orders")
def baseline_cursors(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select("o_orderkey", changes.baseline_cursor(k % 60, c % 40, F.when(c % 7 != 0, c % 50)).alias("cursor"))


@query("retry_delays", "SELECT event_id, CASE WHEN event_type = 'error' THEN least(900.0::DOUBLE, 30.0::DOUBLE * power(2.0::DOUBLE, event_id % 8)) END AS delay FROM events")
def retry_delays(spark, sf):
    error = F.when(F.col("event_type") == "error", "Connection reset").otherwise("a header is missing")
    return read(spark, sf, "events").select("event_id", changes.next_attempt(error, F.col("event_id") % 8 + 1).alias("delay"))


def _records(spark, sf):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("casing", "typo", "ocr")]), (k % 3 + 1).cast("int"))
    span = F.array(F.struct(F.lit(0).alias("start"), F.when(k % 50 == 0, 99).otherwise(3).alias("end"), F.lit("street").alias("label")))
    return read(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw"), F.lower("o_orderpriority").alias("normalized"), F.array(name, F.when(k % 40 == 0, name).otherwise("fold")).alias("mutations"), F.when(k % 30 == 0, 1).otherwise(2).alias("noise"), (k % 2 + 1).cast("int").alias("tier"), span.alias("spans"), F.col("o_custkey").alias("target"))


CONFIGURED = ["casing", "typo", "ocr", "fold", "mojibake"]


@query("corpus_faults", "SELECT * FROM (SELECT 'noise differs from mutations' AS fault, count(*) FILTER (o_orderkey % 30 = 0) AS n FROM orders UNION ALL SELECT 'a mutation twice', count(*) FILTER (o_orderkey % 40 = 0) FROM orders UNION ALL SELECT 'a span outside the text', count(*) FILTER (o_orderkey % 50 = 0) FROM orders UNION ALL SELECT 'normalised otherwise', count(*) FILTER (lower(o_orderpriority) <> o_orderpriority) FROM orders UNION ALL SELECT 'mutations that no record has', 1 UNION ALL SELECT 'tiers that no record has', 1 UNION ALL SELECT 'no record without target', 1) WHERE n > 0")
def corpus_faults(spark, sf):
    return evaluate.corpus_faults(_records(spark, sf), CONFIGURED, lambda raw: raw)


@query("mutation_gaps", "SELECT 'mojibake' AS missing, 'ocr' AS unknown")
def mutation_gaps(spark, sf):
    out = evaluate.mutation_gaps(_records(spark, sf), [c for c in CONFIGURED if c != "ocr"])
    return out.select(F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("machine_factor", "WITH k AS (SELECT l_returnflag, median(l_quantity) AS own, (max(l_quantity) - min(l_quantity)) / median(l_quantity) AS spread, median(l_quantity + l_linenumber) AS baked FROM lineitem GROUP BY ALL) SELECT round(median(baked / own), 9) AS factor, round(max(baked / own) / min(baked / own), 9) AS divergence, count(*) FILTER (spread > 0.15) AS noisy, false AS trusted FROM k")
def machine_factor(spark, sf):
    li = read(spark, sf, "lineitem")
    out = evaluate.machine_factor(li.select(F.col("l_returnflag").alias("kernel"), F.col("l_quantity").alias("seconds")), li.select(F.col("l_returnflag").alias("kernel"), (F.col("l_quantity") + F.col("l_linenumber")).alias("seconds")))
    return out.select(F.round("factor", 9).alias("factor"), F.round("divergence", 9).alias("divergence"), "noisy", "trusted")


@query("thinned_gaps", "WITH d AS (SELECT DISTINCT c_nationkey AS gap FROM customer) SELECT gap FROM d QUALIFY (row_number() OVER (ORDER BY gap DESC) - 1) % CAST(ceil(count(*) OVER () / 7.0) AS BIGINT) = 0")
def thinned_gaps(spark, sf):
    return evaluate.thinned(read(spark, sf, "customer").select(F.col("c_nationkey").alias("gap")), "gap", 7)


def grades(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("qid"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("candidate"), (F.col("l_linenumber") == 1).alias("is_target"), (F.col("l_discount") * 10).alias("street"), F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.2).alias("postcode"))


@query("weight_objective", "WITH g AS (SELECT l_orderkey AS qid, l_linenumber, l_linenumber || '-' || l_partkey AS cand, 2.0 * ln(0.001 + l_discount * 10) + 1.0 * ln(0.001 + CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.2 END) AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cand) AS rank FROM g), t AS (SELECT qid, min(rank) FILTER (l_linenumber = 1) AS rank FROM r GROUP BY qid) SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM t")
def weight_objective(spark, sf):
    recall, mrr = evaluate.objective(grades(spark, sf), {"street": 2.0, "postcode": 1.0})
    return spark.createDataFrame([(round(recall, 6), round(mrr, 6))], "recall_5 double, mrr double")


@query("shape_bounds", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, n_nationkey + 2.0::DOUBLE AS x1, 2.0::DOUBLE AS y1 FROM nation")
def shape_bounds(spark, sf):
    box = geometry.bounds(_square(F.col("n_nationkey"), 2))
    return read(spark, sf, "nation").select("n_nationkey", box.alias("b")).select("n_nationkey", "b.*")


@query("united_areas", "SELECT n_regionkey, count(*) AS parts, CAST(min(n_nationkey) AS DOUBLE) AS x0, max(n_nationkey) + 1.0::DOUBLE AS x1, 2 * count(*) + 2 * (SELECT count(*) FROM nation a WHERE a.n_regionkey = n.n_regionkey AND NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey = a.n_nationkey - 1)) AS border FROM nation n GROUP BY n_regionkey")
def united_areas(spark, sf):
    """Squares of one region, dissolved: shared sides are no longer part of the border."""
    n = read(spark, sf, "nation").select("n_regionkey", _square(F.col("n_nationkey")).alias("geometry"))
    shape = geometry.union_areas(n, "n_regionkey", "geometry").withColumn("b", geometry.bounds(F.col("geometry")))
    border = F.aggregate(
        F.flatten(F.when(F.get_json_object("geometry", "$.type") == "Polygon", F.array(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>"))).otherwise(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<array<double>>>>"))),
        F.lit(0.0),
        lambda s, ring: s + F.aggregate(F.zip_with(F.slice(ring, 2, 1000), F.slice(ring, 1, F.size(ring) - 1), lambda a, b: F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])), F.lit(0.0), lambda x, y: x + y),
    )
    return shape.join(n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("parts")), "n_regionkey").select("n_regionkey", "parts", "b.x0", "b.x1", border.cast("long").alias("border"))
