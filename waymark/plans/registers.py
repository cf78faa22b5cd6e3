"""Queries on folding changes, building the served tables, quality gates and metrics.

Orders stand in for register versions, events for change files, line items, orders and customers for units,
buildings and grounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import build, changes, evaluate, gazetteer, synthesize
from ..operators.knn import ranked
from ..sources import store
from .registry import query, read

NOW = "TIMESTAMP '1998-06-01 00:00:00'"
STATES = "st AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '4' WHEN 3 THEN '5' WHEN 4 THEN '9' END AS status, o_orderdate AS f, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS u FROM orders)"


def states(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey") % 6
    status = F.when(key == 0, "2").when(key == 1, "3").when(key == 2, "4").when(key == 3, "5").when(key == 4, "9")
    until = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return read(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("f"), until.alias("u"))


def now():
    return F.expr(NOW)


@query("lifecycle_dar", f"WITH {STATES} SELECT o_orderkey, CASE WHEN f > {NOW} THEN 'preliminary' WHEN status = '3' OR status IS NULL THEN 'current' WHEN status = '4' THEN 'retired' WHEN status = '2' THEN 'preliminary' WHEN status = '5' THEN 'abandoned' WHEN u IS NULL THEN 'current' ELSE 'retired' END AS state, coalesce(status NOT IN ('2', '3', '4', '5'), false) AS unmapped FROM st")
def lifecycle_dar(spark, sf):
    return states(spark, sf).select("o_orderkey", build.address_lifecycle(F.col("status"), F.col("f"), F.col("u"), now()).alias("state"), build.unmapped(F.col("status"), build.ADDRESS_STATUS).alias("unmapped"))


@query("lifecycle_mat", f"WITH {STATES}, m AS (SELECT *, map {{'2': 'Foreløbig', '3': 'Gældende', '4': 'Historisk', '5': 'Ikke gennemført', '9': 'x'}}[status] AS t FROM st) SELECT o_orderkey, CASE WHEN f > {NOW} THEN 'preliminary' WHEN t IS NULL OR lower(t) = 'gældende' THEN 'current' WHEN lower(t) = 'historisk' THEN 'retired' WHEN lower(t) = 'foreløbig' THEN 'preliminary' WHEN lower(t) = 'ikke gennemført' THEN 'abandoned' WHEN u IS NULL THEN 'current' ELSE 'retired' END AS state FROM m")
def lifecycle_mat(spark, sf):
    words = F.create_map(*[F.lit(x) for x in ("2", "Foreløbig", "3", "Gældende", "4", "Historisk", "5", "Ikke gennemført", "9", "x")])
    return states(spark, sf).select("o_orderkey", build.parcel_lifecycle(F.element_at(words, F.col("status")), F.col("f"), F.col("u"), now()).alias("state"))


@query("lifecycle_dagi", f"WITH {STATES} SELECT o_orderkey, CASE WHEN f > {NOW} THEN 'preliminary' WHEN u IS NULL THEN 'current' ELSE 'retired' END AS state FROM st")
def lifecycle_dagi(spark, sf):
    return states(spark, sf).select("o_orderkey", build.area_lifecycle(F.col("f"), F.col("u"), now()).alias("state"))


@query("lifecycle_ds", f"WITH {STATES} SELECT o_orderkey, CASE WHEN status = '4' THEN 'retired' ELSE 'current' END AS state FROM st")
def lifecycle_ds(spark, sf):
    text = F.when(F.col("status") == "4", "historisk").when(F.col("status") == "3", "iAnvendelse").otherwise(F.col("status"))
    return states(spark, sf).select("o_orderkey", build.place_lifecycle(text).alias("state"))


VERSIONS = "v AS (SELECT user_id, ts AS effect_from, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 HOUR END AS effect_until, event_type FROM events)"


def versions(spark: SparkSession, sf: str) -> DataFrame:
    until = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 HOUR"))
    return read(spark, sf, "events").select("user_id", F.col("ts").alias("effect_from"), until.alias("effect_until"), "event_type")


@query("asof_point_in_time", f"WITH {VERSIONS}, h AS (SELECT e.event_id, v.event_type AS name, v.effect_from FROM events e JOIN v ON v.user_id = e.user_id AND v.effect_from <= e.ts AND (v.effect_until IS NULL OR e.ts < v.effect_until) QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY v.effect_from DESC, v.event_type DESC) = 1) SELECT e.event_id, h.effect_from AS named_from, h.name FROM events e LEFT JOIN h USING (event_id)")
def asof_point_in_time(spark, sf):
    rows = read(spark, sf, "events").select("event_id", "user_id", "ts")
    return build.as_of(rows, versions(spark, sf).withColumnRenamed("event_type", "name"), "user_id", "ts", "event_id", ["name"]).select("event_id", "named_from", "name")


@query("distinct_on_best", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey, p_size FROM part ORDER BY p_brand, p_size, p_partkey")
def distinct_on_best(spark, sf):
    return build.best_of(read(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_size", "p_partkey"])


@query("scale_pick", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey, p_type FROM part ORDER BY p_brand, coalesce(nullif(list_position(['STANDARD', 'PROMO'], p_type), 0), 3), p_partkey")
def scale_pick(spark, sf):
    return build.best_of(read(spark, sf, "part").select("p_brand", "p_partkey", "p_type"), ["p_brand"], [build.preference(F.col("p_type"), ["STANDARD", "PROMO"]), "p_partkey"])


@query("orphan_anti", "SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_anti(spark, sf):
    # ids and parents of different tables: the parents that exist are those with a balance
    parents = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("parent"))
    units = read(spark, sf, "orders").select((-F.col("o_orderkey") - 1).alias("id"), F.col("o_custkey").alias("parent"))
    return build.orphans(parents.unionByName(units), "id", "parent").select(F.col("parent").alias("o_custkey")).distinct()


@query("dual_ref_audit", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = o_custkey % 25")
def dual_ref_audit(spark, sf):
    li, o, s = (read(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(s, (li.l_suppkey == s.s_suppkey) & (s.s_nationkey == o.o_custkey % 25)).select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    "ownership_chain",
    """WITH u AS (SELECT 'U' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS bfe, CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS point, CASE WHEN l_linestatus = 'F' THEN l_orderkey + 1 END AS area, l_suppkey AS ground FROM lineitem),
    j AS (SELECT u.*, 'B' || o_orderkey AS b, o_custkey AS og FROM u LEFT JOIN orders ON o_orderkey = coalesce(point, area)),
    k AS (SELECT j.*, 'G' || c_custkey AS g FROM j LEFT JOIN customer ON c_custkey = coalesce(og, ground))
    SELECT bfe, coalesce(b, g) AS parent, g AS ground_bfe, array_to_string(list_filter([bfe, b, g], lambda x: x IS NOT NULL), '>') AS chain FROM k""",
)
def ownership_chain(spark, sf):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    units = read(spark, sf, "lineitem").select(
        F.concat(text("U", "l_orderkey"), text("-", "l_linenumber"), text("-", "l_partkey")).alias("bfe"), F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("point"),
        F.when(F.col("l_linestatus") == "F", F.col("l_orderkey") + 1).alias("area"), F.col("l_suppkey").alias("ground"),
    )
    buildings = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text("B", "o_orderkey").alias("bfe"), F.col("o_custkey").alias("ground"))
    grounds = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text("G", "c_custkey").alias("bfe"))
    return build.ownership_chain(units, buildings, grounds).withColumn("chain", F.array_join("chain", ">"))


@query("children_inversion", "SELECT o_custkey AS parent, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS children, array_to_string(list(o_orderstatus ORDER BY o_orderkey), ',') AS child_types FROM orders GROUP BY o_custkey")
def children_inversion(spark, sf):
    out = build.children(read(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")
    return out.select("parent", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), F.array_join("child_types", ",").alias("child_types"))


@query("property_card", "WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY ALL) SELECT c_custkey AS bfe, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE g.gp END AS shown_parcel, n_name AS label, coalesce(len(k) <= 1000, true) AS complete, coalesce(len(k[1:1000]), 0) AS shown FROM (SELECT customer.*, c_custkey // 2 AS gb FROM customer) x LEFT JOIN (SELECT c_custkey AS gk, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS gp FROM customer) g ON gk = gb LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE g.gp END LEFT JOIN c ON o_custkey = c_custkey")
def property_card(spark, sf):
    kids = build.children(read(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("bfe"), F.floor(F.col("c_custkey") / 2).alias("ground_bfe"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("parcel"))
    c = c.join(kids.select(F.col("parent").alias("bfe"), "children"), "bfe", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))
    parcels = read(spark, sf, "nation").select(F.col("n_nationkey").alias("parcel"), F.col("n_name").alias("label"))
    return gazetteer.property_card(c, parcels).select("bfe", "shown_parcel", "label", "complete", F.size("children").alias("shown"))


@query("multi_member_groups", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS representative FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def multi_member_groups(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("representative")).filter("n > 1")


CHANGES = "ch AS (SELECT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INTEGER) AS generation, ts AS effect_from, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY END AS effect_until, ts - INTERVAL 1 HOUR AS recorded_from, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR END AS recorded_until, event_id, event_type, value FROM events)"
AT = "TIMESTAMP '2024-01-15 00:00:00'"


def change_rows(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.expr("INTERVAL 1 HOUR")
    return read(spark, sf, "events").select(
        "user_id", F.datediff("ts", F.lit("2024-01-01")).alias("generation"), F.col("ts").alias("effect_from"), F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("effect_until"),
        (F.col("ts") - hour).alias("recorded_from"), F.when(F.col("event_type") == "error", F.col("ts") + hour).alias("recorded_until"), "event_id", "event_type", "value",
    )


@query("versioned_fold", f"WITH {CHANGES}, l AS (SELECT user_id, max(generation) AS generation FROM ch GROUP BY user_id), b AS (SELECT ch.*, (effect_from IS NULL OR effect_from <= {AT}) AND (effect_until IS NULL OR effect_until > {AT}) AS e FROM ch JOIN l USING (user_id, generation) WHERE recorded_until IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e DESC, effect_from DESC, recorded_from DESC) = 1) SELECT l.user_id, l.generation AS decided, b.user_id IS NULL AS deleted, b.event_id, b.event_type FROM l LEFT JOIN b USING (user_id)")
def versioned_fold(spark, sf):
    return changes.fold_versions(change_rows(spark, sf), "user_id", F.expr(AT)).select("user_id", "decided", "deleted", "event_id", "event_type")


@query("aktualitet_fold", f"WITH {CHANGES} SELECT user_id, generation, event_id, event_type FROM ch QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY generation DESC, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id) = 1")
def aktualitet_fold(spark, sf):
    return changes.fold_status(change_rows(spark, sf), "user_id", F.col("event_type") == "click", "event_id").select("user_id", "generation", "event_id", "event_type")


@query("history_fold", f"WITH {CHANGES}, k AS (SELECT user_id, event_type, generation, max(value) AS value FROM ch GROUP BY ALL) SELECT user_id, event_type, generation, value FROM k QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY generation DESC) = 1")
def history_fold(spark, sf):
    rows = change_rows(spark, sf).groupBy("user_id", "event_type", "generation").agg(F.max("value").alias("value"))
    return changes.fold_history(rows, ["user_id", "event_type"]).select("user_id", "event_type", "generation", "value")


@query("applied_changes", f"WITH {CHANGES}, n AS (SELECT * FROM ch WHERE event_type <> 'click'), s AS (SELECT user_id, max(value) AS value FROM ch WHERE event_type = 'click' GROUP BY user_id), l AS (SELECT user_id, max(generation) AS generation FROM n GROUP BY user_id), b AS (SELECT n.user_id, n.value, (effect_from <= {AT}) AND (effect_until IS NULL OR effect_until > {AT}) AS e FROM n JOIN l USING (user_id, generation) WHERE recorded_until IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e DESC, effect_from DESC, recorded_from DESC) = 1) SELECT user_id, value FROM s WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM b")
def applied_changes(spark, sf):
    """Clicks were staged before; everything else changes them."""
    rows = change_rows(spark, sf)
    staged = rows.filter("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("value"))
    return changes.applied(staged, changes.fold_versions(rows.filter("event_type <> 'click'"), "user_id", F.expr(AT)), "user_id")


@query("delta_gap_plan", f"WITH {CHANGES}, d AS (SELECT DISTINCT user_id, event_type, generation FROM ch) SELECT user_id, event_type, generation, lag(generation) OVER w AS before, coalesce(generation = lag(generation) OVER w + 1, true) AS contiguous FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY generation)")
def delta_gap_plan(spark, sf):
    return changes.gaps(change_rows(spark, sf).select("user_id", "event_type", "generation"), ["user_id", "event_type"])


@query("staging_plan", f"WITH {CHANGES}, d AS (SELECT DISTINCT user_id, generation FROM ch), c AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 <> 0 THEN 25 + user_id % 6 END AS cursor, user_id % 7 <> 0 AS ok, user_id % 11 = 0 AS empty FROM events), s AS (SELECT c.user_id, cursor, ok, empty, max(generation) AS newest, count(*) FILTER (generation > cursor) AS fresh, min(generation) FILTER (generation > cursor) AS first FROM c JOIN d USING (user_id) GROUP BY ALL), a AS (SELECT *, CASE WHEN cursor IS NULL OR empty OR NOT ok THEN 'BASELINE' WHEN fresh = 0 THEN 'SKIP' WHEN first = cursor + 1 AND fresh = newest - cursor THEN 'DELTA' ELSE 'BASELINE' END AS action FROM s) SELECT user_id, action, CAST(CASE action WHEN 'BASELINE' THEN greatest(newest - 3, 0) WHEN 'SKIP' THEN cursor ELSE newest END AS BIGINT) AS new_cursor FROM a")
def staging_plan(spark, sf):
    u = F.col("user_id")
    cursors = read(spark, sf, "events").select("user_id").distinct().select("user_id", F.when(u % 5 != 0, 25 + u % 6).alias("cursor"), (u % 7 != 0).alias("contract_ok"), (u % 11 == 0).alias("empty"))
    return changes.staging_plan(change_rows(spark, sf).select("user_id", "generation").distinct(), cursors, "user_id").withColumn("new_cursor", F.col("new_cursor").cast("long"))


@query("latest_totals", "SELECT o_orderpriority, o_orderkey AS file, version, generation, bytes FROM (SELECT o_orderpriority, o_orderkey, o_custkey % 3 AS version, o_orderkey AS generation, CAST(o_totalprice AS BIGINT) AS bytes FROM orders WHERE o_orderstatus = 'O') QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY bytes >= 10000 DESC, version DESC, generation DESC) = 1")
def latest_totals(spark, sf):
    files = read(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 3).alias("version"), F.col("o_orderkey").alias("generation"), F.round("o_totalprice").cast("long").alias("bytes"), F.when(F.col("o_orderstatus") == "O", "total").otherwise("delta").alias("type"), F.lit(True).alias("national"))
    return changes.latest_totals(files, ["o_orderpriority"])


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    each = [read(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows")) for t in ("part", "orders", "customer", "supplier")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


COUNTS = "ct AS (SELECT 'part' AS name, count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier)"


@query("quality_floors", f"WITH {COUNTS} SELECT name, rows, f AS floor FROM ct JOIN (VALUES ('part', 1), ('orders', 100000000), ('supplier', 1000000)) v(n, f) ON n = name WHERE rows < f")
def quality_floors(spark, sf):
    return build.floor_violations(table_counts(spark, sf), {"part": 1, "orders": 100_000_000, "supplier": 1_000_000})


@query("shrink_gate", f"WITH {COUNTS} SELECT name, rows, CAST(rows * 1.5 AS BIGINT) AS before, round(1 - CAST(rows AS DOUBLE) / CAST(rows * 1.5 AS BIGINT), 6) AS lost FROM ct WHERE name LIKE '%er%'")
def shrink_gate(spark, sf):
    counts = table_counts(spark, sf)
    factor = F.when(F.col("name").contains("er"), 1.5).otherwise(1.0)
    prior = counts.select("name", F.round(F.col("rows") * factor).cast("long").alias("rows"))
    return build.shrink_violations(counts, prior).withColumn("lost", F.round("lost", 6))


@query("ratio_gate", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_totalprice < 50000) AS low, round(CAST(count(*) FILTER (o_totalprice < 50000) AS DOUBLE) / count(*), 9) AS ratio FROM orders GROUP BY ALL HAVING CAST(count(*) FILTER (o_totalprice < 50000) AS DOUBLE) / count(*) > 0.05")
def ratio_gate(spark, sf):
    counts = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_totalprice") < 50000).alias("low"))
    return build.ratio_violations(counts, "low", "total", 0.05).withColumn("ratio", F.round("ratio", 9))


@query("null_coverage", "SELECT count(*) AS total, count(*) - count(l) AS null_l, count(*) - count(s) AS null_s FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN lang END AS l, nullif(source, 'src0') AS s FROM documents)")
def null_coverage(spark, sf):
    rows = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("l"), F.nullif(F.col("source"), F.lit("src0")).alias("s"))
    return build.coverage(rows, ["l", "s"])


@query("conditional_counts", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01') AS early, min(l_shipdate) AS horizon FROM lineitem GROUP BY l_returnflag")
def conditional_counts(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).alias("early"), F.min("l_shipdate").alias("horizon"))


GENS = "g AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_custkey % 100 AS contract, o_custkey % 100 AS contract_age, o_orderdate AS seeded_at, o_orderkey % 50 = 0 AS leased FROM orders)"


def generations(spark: SparkSession, sf: str) -> DataFrame:
    contract = F.col("o_custkey") % 100
    return read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), contract.alias("contract"), contract.alias("contract_age"), F.col("o_orderdate").alias("seeded_at"), (F.col("o_orderkey") % 50 == 0).alias("leased"))


@query("kept_generations", f"WITH {GENS} SELECT name, row_number() OVER w AS n, row_number() OVER w <= CASE WHEN contract_age = 0 THEN 2 ELSE 1 END OR leased AS keep FROM g WINDOW w AS (PARTITION BY contract ORDER BY seeded_at DESC, name DESC)")
def kept_generations(spark, sf):
    return build.kept_generations(generations(spark, sf)).select("name", "n", "keep")


@query("serving_generation", f"WITH {GENS} SELECT name, contract, seeded_at FROM g WHERE contract_age <= 1 ORDER BY contract_age, seeded_at DESC, name DESC LIMIT 1")
def serving_generation(spark, sf):
    return build.serving_generation(generations(spark, sf)).select("name", "contract", "seeded_at")


@query("street_ids_dense", "SELECT CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS street_id, p_name AS street, p_name AS folded_street, min(p_size) AS best_rank FROM part GROUP BY p_name")
def street_ids_dense(spark, sf):
    return build.street_ids(read(spark, sf, "part"), "p_name", "p_size")


@query("gazetteer_map", "SELECT lower(p_type) AS name, array_to_string(list_sort(list(DISTINCT substr(p_brand, 7))), ',') AS codes FROM part GROUP BY p_type")
def gazetteer_map(spark, sf):
    rows = read(spark, sf, "part").withColumn("code", F.substring("p_brand", 7, 9))
    return build.name_codes(rows, "p_type", "code").withColumn("codes", F.array_join("codes", ","))


@query("bridge_distinct", "SELECT DISTINCT p_name AS street, substr(p_brand, 7) AS postcode FROM part")
def bridge_distinct(spark, sf):
    return read(spark, sf, "part").select(F.col("p_name").alias("street"), F.substring("p_brand", 7, 9).alias("postcode")).distinct()


@query("name_aliases", "WITH c AS (SELECT user_id, arg_max(event_type, ts) AS now FROM events GROUP BY user_id) SELECT user_id, event_type, max(ts) AS last_from FROM events JOIN c USING (user_id) WHERE event_type <> now GROUP BY ALL")
def name_aliases(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("effect_from"))
    current = e.groupBy("user_id").agg(F.max_by("event_type", "effect_from").alias("event_type"))
    return build.aliases(e, current, "user_id", "event_type")


@query("parcel_labels", "SELECT p_partkey, CAST(p_size AS VARCHAR) || ' ' || p_type AS shown, regexp_replace(lower(CAST(p_size AS VARCHAR) || ' ' || p_type || ' ' || p_brand), '\\b0+(\\d)', '\\1', 'g') AS searched FROM part")
def parcel_labels(spark, sf):
    shown, searched = build.parcel_labels(F.col("p_size").cast("string"), F.col("p_type"), F.col("p_brand"))
    return read(spark, sf, "part").select("p_partkey", shown.alias("shown"), searched.alias("searched"))


@query("postcode_sets", "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS postcodes, list_has_any(list(l_suppkey), [3, 14, 15]) AS pinned FROM lineitem GROUP BY l_partkey")
def postcode_sets(spark, sf):
    sets = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    pin = F.array(*[F.lit(x).cast("long") for x in (3, 14, 15)])
    return sets.select("l_partkey", F.array_join(F.col("s").cast("array<string>"), ",").alias("postcodes"), F.coalesce(F.arrays_overlap("s", pin), F.lit(True)).alias("pinned"))


@query("wkt_point_parse", "SELECT vec_id, round(CAST(CAST(embedding[1] AS VARCHAR) AS DOUBLE), 6) AS x, round(CAST(CAST(embedding[2] AS VARCHAR) AS DOUBLE), 6) AS y FROM embeddings")
def wkt_point_parse(spark, sf):
    text = F.concat(F.lit("POINT Z ("), F.col("embedding")[0].cast("string"), F.lit(" "), F.col("embedding")[1].cast("string"), F.lit(" 0)"))
    x, y = geometry.wkt_xy(text)
    return read(spark, sf, "embeddings").select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("wkt_geojson")
def wkt_geojson(spark, sf):
    e = read(spark, sf, "embeddings")
    xy = lambda i: F.concat_ws(" ", F.format_number(F.col("embedding")[i], 4), F.format_number(F.col("embedding")[i + 1], 4))
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", xy(0), xy(2), xy(4), xy(0)), F.lit("))"))
    return e.select("vec_id", geometry.geojson_from_wkt(text).alias("geometry"))


def _square(x, y, size):
    corner = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), (y + dy).cast("string"), F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0)), F.lit("]]}"))


@query("geojson_merge", "SELECT n_regionkey, CASE WHEN count(*) = 1 THEN '{\"type\":\"Polygon\",\"coordinates\":' ELSE '{\"type\":\"MultiPolygon\",\"coordinates\":[' END || string_agg(part, ',' ORDER BY part) || CASE WHEN count(*) = 1 THEN '}' ELSE ']}' END AS geometry FROM (SELECT n_regionkey, '[[[' || n_nationkey || '.0,0.0],[' || (n_nationkey + 2) || '.0,0.0],[' || (n_nationkey + 2) || '.0,2.0],[' || n_nationkey || '.0,2.0],[' || n_nationkey || '.0,0.0]]]' AS part FROM nation) GROUP BY n_regionkey")
def geojson_merge(spark, sf):
    n = read(spark, sf, "nation").select("n_regionkey", _square(F.col("n_nationkey").cast("int"), F.lit(0), 2).alias("g"))
    return geometry.merge_polygons(n, ["n_regionkey"], "g")


@query("point_in_rectangle_stamp", "WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y FROM embeddings), r AS (SELECT n_nationkey AS code, n_nationkey % 5 * 2 - 5 AS x0, n_nationkey // 5 * 2 - 5 AS y0 FROM nation) SELECT id, min(code) AS code FROM p JOIN r ON x BETWEEN x0 AND x0 + 3 AND y BETWEEN y0 AND y0 + 3 GROUP BY id")
def point_in_rectangle_stamp(spark, sf):
    p = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 20).alias("x"), (F.col("embedding")[1].cast("double") * 20).alias("y"))
    k = F.col("n_nationkey")
    r = read(spark, sf, "nation").select(F.lit("k").alias("kind"), k.alias("code"), k.alias("priority"), _square(k % 5 * 2 - 5, F.floor(k / 5) * 2 - 5, 3).alias("geometry"))
    return geometry.stamp_points(p, r, cell=2.0).select("id", "code")


@query("utm_projection")
def utm_projection(spark, sf):
    lon, lat = 9 + F.col("n_nationkey") / 10, 55 + F.col("n_regionkey") / 2
    east, north = geometry.utm32(lon, lat)
    return read(spark, sf, "nation").select("n_nationkey", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


RANKS = "r AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 7 < 5 THEN doc_id % 7 + 1 END AS rank FROM labels)"


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "labels").withColumn("rank", F.when(F.col("doc_id") % 7 < 5, F.col("doc_id") % 7 + 1))


@query("rank_metrics", f"WITH {RANKS} SELECT quality, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM r GROUP BY quality")
def rank_metrics(spark, sf):
    out = evaluate.rank_metrics(ranks(spark, sf), ["quality"])
    return out.select("quality", "n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_5", "mrr")])


@query("refusal_metrics", f"WITH {RANKS} SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS return_rate, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 9) AS confident_rate FROM r WHERE toxic = 0")
def refusal_metrics(spark, sf):
    rows = ranks(spark, sf).filter("toxic = 0").select(F.col("rank").isNotNull().alias("returned"), F.when(F.col("rank") == 1, "A").otherwise("C").alias("confidence"))
    return evaluate.refusal_metrics(rows).select("n", F.round("return_rate", 9).alias("return_rate"), F.round("confident_rate", 9).alias("confident_rate"))


SPANS = "e AS (SELECT DISTINCT doc_id AS id, lang AS label, n_chars % 50 AS start, n_chars % 50 + 5 AS \"end\" FROM documents), p AS (SELECT DISTINCT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS label, n_chars % 50 AS start, n_chars % 50 + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 5 END AS \"end\" FROM documents)"


@query("span_prf", f"WITH {SPANS}, c AS (SELECT label, sum(tp) AS tp, sum(p) AS predicted, sum(e) AS expected FROM (SELECT coalesce(e.label, p.label) AS label, CASE WHEN e.id IS NOT NULL AND p.id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS p, CASE WHEN e.id IS NOT NULL THEN 1 ELSE 0 END AS e FROM e FULL JOIN p ON e.id = p.id AND e.label = p.label AND e.start = p.start AND e.\"end\" = p.\"end\") GROUP BY label) SELECT label, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, CAST(expected AS BIGINT) AS expected, round(CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END, 9) AS precision, round(CASE WHEN expected > 0 THEN CAST(tp AS DOUBLE) / expected ELSE 0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + expected) ELSE 0 END, 9) AS f1 FROM c")
def span_prf(spark, sf):
    d = read(spark, sf, "documents")
    start = F.col("n_chars") % 50
    expected = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), start.alias("start"), (start + 5).alias("end"))
    predicted = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("label"), start.alias("start"), (start + F.when(F.col("doc_id") % 3 == 0, 4).otherwise(5)).alias("end"))
    out = evaluate.span_scores(predicted, expected, ["label"])
    return out.select("label", "tp", "predicted", "expected", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("nearest_rank_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) FILTER (i >= ceil(50 * n / 100)) AS p50, min(value) FILTER (i >= ceil(95 * n / 100)) AS p95, min(value) FILTER (i >= ceil(99 * n / 100)) AS p99 FROM r GROUP BY event_type")
def nearest_rank_percentiles(spark, sf):
    return evaluate.nearest_rank(read(spark, sf, "events"), "value", [50, 95, 99], ["event_type"])


@query("throughput_summary", "SELECT count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok, count(*) FILTER (event_type = 'view') AS shed, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type NOT IN ('error', 'view') AND user_id % 10 = 0) AS empty, round(count(*) FILTER (event_type NOT IN ('error', 'view')) / 60.0, 9) AS per_second FROM events")
def throughput_summary(spark, sf):
    rows = read(spark, sf, "events").select(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "shed").otherwise("ok").alias("status"), (F.col("user_id") % 10).alias("found"))
    return evaluate.throughput(rows, F.lit(60.0)).withColumn("per_second", F.round("per_second", 9))


@query("fs_weights", "WITH a AS (SELECT l_returnflag, count(*) FILTER (l_discount > 0.03 AND l_linestatus = 'F') AS mh, count(*) FILTER (l_linestatus = 'F') AS mn, count(*) FILTER (l_tax > 0.06 AND l_linestatus = 'O') AS uh, count(*) FILTER (l_linestatus = 'O') AS un FROM lineitem GROUP BY l_returnflag), b AS (SELECT l_returnflag, (mh + 1) / (mn + 2) AS m, (uh + 1) / (un + 2) AS u FROM a) SELECT l_returnflag, round(greatest(0, (ln(m / u) - ln((1 - m) / (1 - u))) / ln(1000)), 9) AS weight FROM b")
def fs_weights(spark, sf):
    f, o = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    a = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if((F.col("l_discount") > 0.03) & f).alias("mh"), F.count_if(f).alias("mn"), F.count_if((F.col("l_tax") > 0.06) & o).alias("uh"), F.count_if(o).alias("un"))
    m, u = evaluate.agreement(F.col("mh"), F.col("mn"), F.col("uh"), F.col("un"))
    return a.select("l_returnflag", F.round(evaluate.axis_weight(m, u), 9).alias("weight"))


@query("margin_grid", "WITH g AS (SELECT l_discount * 10 AS gap, l_returnflag <> 'R' AS correct FROM lineitem), v AS (SELECT a / 2.0 AS a, b / 2.0 AS b FROM range(0, 20) x(a), range(0, 20) y(b) WHERE b <= a), t AS (SELECT a, b, count(*) AS confident, count(*) FILTER (NOT correct) AS false_confident FROM g JOIN v ON gap >= a GROUP BY ALL) SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, confident, false_confident, confident >= 40 AND false_confident / confident <= 0.34 AS keep FROM t")
def margin_grid(spark, sf):
    half = lambda c: (F.col(c) / 2).alias(c)
    grid = spark.range(20).withColumnRenamed("id", "a").crossJoin(spark.range(20).withColumnRenamed("id", "b")).filter("b <= a").select(half("a"), half("b"))
    gaps = read(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("gap"), (F.col("l_returnflag") != "R").alias("correct"))
    return evaluate.margin_grid(gaps, grid, 0.34)


@query("hash_sample", "SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark, sf):
    return synthesize.sample(read(spark, sf, "customer"), "c_custkey", 50, 7).select("c_custkey")


@query("strata", "SELECT o_custkey, o_orderkey, ntile(5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stratum FROM orders")
def strata(spark, sf):
    from pyspark.sql import Window

    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ntile(5).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("stratum"))


@query("train_held_overlap", "SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 10 = 9 INTERSECT SELECT c_nationkey FROM customer WHERE c_custkey % 10 < 9")
def train_held_overlap(spark, sf):
    c = read(spark, sf, "customer")
    return c.filter("c_custkey % 10 = 9").select("c_nationkey").intersect(c.filter("c_custkey % 10 < 9").select("c_nationkey"))


@query("area_hierarchy", "SELECT c_custkey, n_name AS kommune, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def area_hierarchy(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", F.col("n_name").alias("kommune"), F.col("r_name").alias("region"))


@query("unit_stamp", "WITH u AS (SELECT o_custkey, min(l_partkey) AS bfe FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY o_custkey) SELECT c_custkey, bfe FROM customer LEFT JOIN u ON o_custkey = c_custkey")
def unit_stamp(spark, sf):
    li, o, p, c = (read(spark, sf, t) for t in ("lineitem", "orders", "part", "customer"))
    units = li.join(o, li.l_orderkey == o.o_orderkey).join(p.filter("p_size > 25"), li.l_partkey == p.p_partkey, "left_semi")
    return c.join(units.groupBy("o_custkey").agg(F.min("l_partkey").alias("bfe")), c.c_custkey == F.col("o_custkey"), "left").select("c_custkey", "bfe")


@query("schema_fingerprint")
def schema_fingerprint(spark, sf):
    return spark.createDataFrame([(t, store.fingerprint(read(spark, sf, t))) for t in ("part", "orders", "customer")], "name string, fingerprint string")


@query("over_fetch_then_dedup", "WITH w AS (SELECT o_orderpriority, o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 50), d AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) SELECT o_orderpriority, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM d QUALIFY rank <= 5")
def over_fetch_then_dedup(spark, sf):
    o = read(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_totalprice", "o_orderkey")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    wide = ranked(o, 50, order, ["o_orderpriority"]).drop("rank")
    one = ranked(wide, 1, order, ["o_orderpriority", "o_custkey"]).drop("rank")
    return ranked(one, 5, order, ["o_orderpriority"]).select("o_orderpriority", "o_custkey", "o_orderkey", "rank")
