"""Queries on text, trigrams, scoring and resolution.

Parts stand in for addresses: the name is the street, the size the house number, the brand's number the
postcode and the type the city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagging
from ..functions import text as X
from ..operators import gazetteer, resolve
from ..operators.knn import close_members, knn, similarities, street_combos
from ..operators.sized import small
from ..operators.synthesize import corpus
from .registry import query, read

GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all({0}, '[0-9a-z]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
NAMES = "n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id, " + GRAMS.format("name") + " AS g FROM (SELECT DISTINCT p_name AS name FROM part))"
ASKED = "q AS (SELECT query, " + GRAMS.format("query") + " AS g FROM (SELECT DISTINCT replace(p_name, 'e', '') AS query FROM part))"
SIMS = (
    f"{NAMES}, {ASKED}, s AS (SELECT query, id, name, len(list_intersect(q.g, n.g)) AS c, len(q.g) + len(n.g) AS t FROM q, n), "
    "sims AS (SELECT query, id, name, CAST(c AS DOUBLE) / (t - c) AS sim FROM s WHERE c > 0 AND CAST(c AS DOUBLE) / (t - c) >= 0.1)"
)


def names(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, folded): distinct part names with dense ids in their order."""
    from ..operators.build import street_ids

    raw = read(spark, sf, "part").select(F.col("p_name").alias("name"), F.lit(1).alias("rank"))
    return street_ids(raw).select(F.col("street_id").alias("id"), F.col("street").alias("name"), F.col("folded_street").alias("folded"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.replace("p_name", F.lit("e"), F.lit("")).alias("query")).distinct()


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").join(small(names(spark, sf).select(F.col("id").alias("street_id"), "name")), F.col("p_name") == F.col("name"))
    null = F.lit(None).cast("string")
    return part.select(
        F.col("p_partkey").cast("string").alias("address_id"), "street_id", F.substring("p_brand", 7, 9).alias("postcode"), F.col("p_size").cast("string").alias("house_number"),
        null.alias("house_letter"), F.when(F.col("p_partkey") % 5 == 0, "1").alias("floor"), F.when(F.col("p_partkey") % 5 == 0, "tv").alias("door"), null.alias("sub_locality"),
        F.col("p_type").alias("city"), F.when(F.col("p_partkey") % 11 == 0, "retired").otherwise("current").alias("lifecycle"),
    )


ADDR = (
    f"{NAMES}, addr AS (SELECT CAST(p_partkey AS VARCHAR) AS address_id, id AS street_id, p_name AS street, substr(p_brand, 7) AS postcode, CAST(p_size AS VARCHAR) AS house_number, "
    "CASE WHEN p_partkey % 5 = 0 THEN '1' END AS floor, CASE WHEN p_partkey % 5 = 0 THEN 'tv' END AS door, p_type AS city, "
    "CASE WHEN p_partkey % 11 = 0 THEN 'retired' ELSE 'current' END AS lifecycle FROM part JOIN n ON p_name = n.name)"
)


@query("trigram_set", f"WITH {NAMES} SELECT name, array_to_string(list_sort(g), '|') AS grams, len(g) AS n FROM n")
def trigram_set(spark, sf):
    return names(spark, sf).select("name", F.array_join(F.array_sort(X.trigrams(F.col("folded"))), "|").alias("grams"), F.size(X.trigrams(F.col("folded"))).alias("n"))


@query("trigram_similarity", f"WITH {SIMS} SELECT query, id, round(sim, 9) AS sim FROM sims")
def trigram_similarity(spark, sf):
    return similarities(asked(spark, sf), names(spark, sf)).select("query", "id", F.round("sim", 9).alias("sim"))


@query("trigram_knn_top5", f"WITH {SIMS} SELECT query, id, round(sim, 9) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM sims QUALIFY rank <= 5")
def trigram_knn_top5(spark, sf):
    return knn(asked(spark, sf), names(spark, sf), 5).select("query", "id", F.round("sim", 9).alias("sim"), "rank")


@query(
    "trigram_knn_pinned",
    f"WITH {SIMS}, b AS (SELECT DISTINCT n.id, substr(p_brand, 7) AS postcode FROM part JOIN n ON p_name = n.name) "
    "SELECT query, id AS street_id, postcode, round(sim, 9) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id, postcode) AS rank "
    "FROM sims JOIN b USING (id) WHERE length(query) % 2 = 0 OR postcode IN ('3', '14') QUALIFY rank <= 64",
)
def trigram_knn_pinned(spark, sf):
    sims = similarities(asked(spark, sf), names(spark, sf)).select(F.col("query").alias("qid"), F.col("id").alias("street_id"), "sim")
    pins = asked(spark, sf).select(F.col("query").alias("qid"), F.when(F.length("query") % 2 == 1, F.array(F.lit("3"), F.lit("14"))).alias("postcodes"))
    out = street_combos(sims, addresses(spark, sf), 64, pins)
    return out.select(F.col("qid").alias("query"), "street_id", "postcode", F.round("sim", 9).alias("sim"), "rank")


PAIRS = "p AS (SELECT DISTINCT l_partkey, l_suppkey, l_discount * 10 AS sim FROM lineitem), j AS (SELECT p.*, CAST(s_nationkey AS VARCHAR) AS qn, CAST(s_suppkey % 25 + 1 AS VARCHAR) AS qp, CASE WHEN s_suppkey % 3 = 0 THEN '1' END AS qf, CAST(p_size AS VARCHAR) AS rn, substr(p_brand, 7) AS rp, CASE WHEN p_partkey % 5 = 0 THEN '1' END AS rf FROM p JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"
HN = "CASE WHEN qn = rn THEN 1.0 WHEN length(qn) <> length(rn) THEN 0.0 ELSE 1 - levenshtein(qn, rn) / length(qn) END"
PC = "greatest(0.0, 1 - levenshtein(rp, qp) / 4)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Queries from suppliers against rows from parts, as the structs that scoring reads."""
    li = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("sim")).distinct()
    sup = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("qn"), (F.col("s_suppkey") % 25 + 1).cast("string").alias("qp"), F.when(F.col("s_suppkey") % 3 == 0, "1").alias("qf"))
    part = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("rn"), F.substring("p_brand", 7, 9).alias("rp"), F.when(F.col("p_partkey") % 5 == 0, "1").alias("rf"))
    null, codes = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    q = F.struct(F.lit("x").alias("street"), F.col("qn").alias("house_number"), null.alias("house_letter"), F.col("qf").alias("floor"), null.alias("door"), F.col("qp").alias("postcode"), F.array("qp").alias("city_codes"), codes.alias("sub_locality_codes"))
    r = F.struct("sim", F.col("rn").alias("house_number"), null.alias("house_letter"), F.col("rf").alias("floor"), null.alias("door"), F.col("rp").alias("postcode"))
    return li.join(sup, F.col("s_suppkey") == F.col("l_suppkey")).join(part, F.col("p_partkey") == F.col("l_partkey")).withColumn("q", q).withColumn("r", r)


@query(
    "score_log_sum",
    f"WITH {PAIRS} SELECT l_partkey, l_suppkey, round(sim, 6) AS sim, round(2.4283 * ln(0.001 + sim) + 0.0384 * ln(0.001 + {HN}) + 3.556 * ln(0.001 + {PC}) + 1.7858 * ln(0.001 + CASE WHEN qp = rp THEN 1 ELSE 0 END) "
    "+ CASE WHEN qf IS NOT NULL THEN 2.2611 * CASE WHEN qf = rf THEN 1 ELSE 0 END ELSE 0 END, 6) AS score FROM j",
)
def score_log_sum(spark, sf):
    return pairs(spark, sf).select("l_partkey", "l_suppkey", F.round("sim", 6).alias("sim"), F.round(resolve.score(resolve.WEIGHTS), 6).alias("score"))


@query("husnr_grade", f"WITH {PAIRS} SELECT DISTINCT qn, rn, round({HN}, 9) AS grade FROM j")
def husnr_grade(spark, sf):
    return pairs(spark, sf).select("qn", "rn").distinct().withColumn("grade", F.round(resolve.house_number_grade(F.col("qn"), F.col("rn")), 9))


@query("postcode_grade", f"WITH {PAIRS} SELECT DISTINCT qp, rp, CAST({PC} AS DOUBLE) AS grade FROM j")
def postcode_grade(spark, sf):
    return pairs(spark, sf).select("qp", "rp").distinct().withColumn("grade", resolve.postcode_grade(F.col("qp"), F.col("rp")))


@query("unit_bonus", f"WITH {PAIRS} SELECT qf, rf, count(*) AS n, sum(CASE WHEN qf = rf THEN 1 ELSE 0 END) AS same FROM j GROUP BY ALL")
def unit_bonus(spark, sf):
    same = resolve.same(F.col("qf"), F.col("rf")).cast("int")
    return pairs(spark, sf).groupBy("qf", "rf").agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("same"))


@query("ta_threshold", f"WITH {PAIRS} SELECT DISTINCT round(sim, 6) AS sim, qf, round(2.4283 * ln(0.001 + sim) + 3.556 * ln(1.001) + CASE WHEN qf IS NULL THEN 0 ELSE 2.2611 END, 6) AS bound FROM j")
def ta_threshold(spark, sf):
    bound = resolve.stream_bound(resolve.WEIGHTS, F.col("sim"), {"street": F.lit(True), "postcode": F.lit(True), "floor": F.col("qf").isNotNull()})
    return pairs(spark, sf).select(F.round("sim", 6).alias("sim"), "qf", F.round(bound, 6).alias("bound")).distinct()


def components(spark: SparkSession, sf: str) -> DataFrame:
    """One query a supplier, on all axes: a street name without the letter e, a number with or without a letter, floor and door, postcodes (some mistyped), cities (some mistyped)."""
    li = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("l_partkey"))  # a part of each supplier
    sup = read(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    null, key = F.lit(None).cast("string"), F.col("s_suppkey")
    brand, city = F.substring("p_brand", 7, 9), F.lower("p_type")
    return sup.select(
        key.alias("qid"), F.when(key % 13 != 0, F.replace("p_name", F.lit("e"), F.lit(""))).alias("street"), F.when(key % 7 != 0, F.col("p_size").cast("string")).alias("house_number"),
        F.when(key % 8 == 0, "b").alias("house_letter"), F.when(key % 6 == 0, "1").alias("floor"), F.when(key % 12 == 0, "tv").alias("door"),
        F.when(key % 3 == 0, brand).when(key % 11 == 0, F.concat(brand, F.lit("0"))).alias("postcode"), F.when(key % 4 == 0, city).when(key % 4 == 1, F.replace(city, F.lit("a"), F.lit("o"))).alias("city"),
        F.when(key % 9 == 0, city).otherwise(null).alias("sub_locality"),
    )


def asked_in_full(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """The queries with the postcodes that their components stand for, as the gazetteers of ``rows`` have them."""
    from ..operators.build import name_codes

    q = components(spark, sf)
    towns = resolve.locality_members(q.select(F.col("city").alias("name")).union(q.select("sub_locality")), name_codes(rows, "city", "postcode"))
    return resolve.evidence(q, resolve.postcode_members(q, rows.select("postcode")), towns, towns)


@query("resolve_batch")
def resolve_batch(spark, sf):
    streets = names(spark, sf).select(F.col("id").alias("street_id"), F.col("name").alias("street"), F.col("folded").alias("folded_street"))
    rows = addresses(spark, sf)
    # every fifth street had its name spelled backwards once
    past = streets.filter("street_id % 5 = 0").select("street_id", F.reverse("street").alias("street"), F.reverse("folded_street").alias("folded_street"), F.lit("retired").alias("lifecycle"))
    return resolve.resolve(asked_in_full(spark, sf, rows), rows, streets, rows.select("street_id", "postcode"), aliases=past)


@query("postcode_members")
def postcode_members(spark, sf):
    q = components(spark, sf)
    return resolve.postcode_members(q, addresses(spark, sf).select("postcode")).select("name", F.array_join("codes", ",").alias("codes"))


@query("locality_members")
def locality_members(spark, sf):
    from ..operators.build import name_codes

    q = components(spark, sf)
    return resolve.locality_members(q.select(F.col("city").alias("name")), name_codes(addresses(spark, sf), "city", "postcode")).select("name", F.array_join("codes", ",").alias("codes"))


@query(
    "resolve_stream_topk",
    f"""WITH {ADDR}, qq AS (SELECT s_suppkey AS qid, p_name AS street, CAST(s_nationkey AS VARCHAR) AS num FROM supplier JOIN part ON p_partkey = s_suppkey),
    qg AS (SELECT DISTINCT street, {GRAMS.format("street")} AS g FROM qq),
    sm AS (SELECT qg.street, n.id, CAST(len(list_intersect(qg.g, n.g)) AS DOUBLE) / (len(qg.g) + len(n.g) - len(list_intersect(qg.g, n.g))) AS sim FROM qg, n),
    cur AS (SELECT * FROM addr WHERE lifecycle = 'current'),
    br AS (SELECT DISTINCT street_id, postcode FROM addr),
    cb AS (SELECT qid, num, street_id, postcode, sim FROM qq JOIN sm ON qq.street = sm.street JOIN br ON br.street_id = sm.id WHERE sim >= 0.1
           QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, street_id, postcode) <= 64),
    cd AS (SELECT qid, cb.street_id, cb.postcode, house_number,
           max(2.4283 * ln(0.001 + sim) + 0.0384 * ln(0.001 + CASE WHEN num = house_number THEN 1.0 WHEN length(num) <> length(house_number) THEN 0.0 ELSE 1 - levenshtein(num, house_number) / length(num) END)) AS score
           FROM cb JOIN cur ON cur.street_id = cb.street_id AND cur.postcode = cb.postcode GROUP BY ALL)
    SELECT qid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS rank FROM cd QUALIFY rank <= 5""",
)
def resolve_stream_topk(spark, sf):
    """Scores by rank of queries with street and number only; which of several equal scores comes first is left out."""
    streets = names(spark, sf).select(F.col("id").alias("street_id"), F.col("name").alias("street"), F.col("folded").alias("folded_street"))
    rows = addresses(spark, sf)
    part = read(spark, sf, "part").select("p_partkey", "p_name")
    null = F.lit(None).cast("string")
    q = read(spark, sf, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_suppkey").alias("qid"), F.col("p_name").alias("street"), F.col("s_nationkey").cast("string").alias("house_number"), *[null.alias(c) for c in ("house_letter", "floor", "door", "postcode", "city", "sub_locality")]
    )
    return resolve.resolve(resolve.evidence(q), rows, streets, rows.select("street_id", "postcode")).select("qid", F.round("score", 6).alias("score"), "rank")


@query(
    "recovery_by_postcode",
    f"WITH {ADDR} SELECT s_suppkey AS qid, address_id FROM supplier JOIN addr ON postcode = CAST(s_suppkey % 25 + 1 AS VARCHAR) WHERE lifecycle = 'current' QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY address_id) <= 4000",
)
def recovery_by_postcode(spark, sf):
    wanted = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") % 25 + 1).cast("string").alias("code"), F.lit(None).cast("string").alias("house_number"), F.lit(None).cast("string").alias("q_street"), F.lit(True).alias("pinned"))
    streets = names(spark, sf).select(F.col("id").alias("street_id"), F.col("name").alias("street"), F.col("folded").alias("folded_street"))
    current = addresses(spark, sf).filter("lifecycle = 'current'")
    return resolve._by_postcode(wanted, current, streets, F.lit(resolve.POSTCODE_CAP)).select("qid", "address_id")


@query("unit_collapse", f"WITH {ADDR} SELECT address_id FROM addr a WHERE (floor IS NULL AND door IS NULL) OR NOT EXISTS (SELECT 1 FROM addr b WHERE b.street_id = a.street_id AND b.postcode = a.postcode AND b.house_number = a.house_number AND b.floor IS NULL AND b.door IS NULL)")
def unit_collapse(spark, sf):
    return resolve.collapse_units(addresses(spark, sf), ["street_id", "postcode", "house_number", "house_letter"]).select("address_id")


@query(
    "resolve_confidence",
    "WITH r AS (SELECT o_custkey AS qid, o_orderkey, ln(o_totalprice) AS score, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5), "
    "g AS (SELECT *, score - lead(score) OVER (PARTITION BY qid ORDER BY rank) AS gap FROM r) "
    "SELECT qid, rank, CASE WHEN pr = '1-URGENT' OR rank > 1 THEN 'C' WHEN gap IS NULL THEN 'B' WHEN gap < 0.05 THEN 'C' WHEN gap >= 0.3 AND pr <> '5-LOW' THEN 'A' ELSE 'B' END AS confidence FROM g",
)
def resolve_confidence(spark, sf):
    from ..operators.knn import ranked

    o = ranked(read(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey", "o_totalprice", F.ln("o_totalprice").alias("score"), "o_orderpriority"), 5, [F.desc("o_totalprice"), "o_orderkey"], ["qid"])
    null = F.lit(None).cast("string")
    hard, soft = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    q = F.struct(null.alias("street"), F.lit("1").alias("house_number"), null.alias("house_letter"), F.lit("1").alias("floor"), null.alias("door"), null.alias("postcode"))
    row = F.struct(
        F.col("o_orderkey").cast("string").alias("address_id"), F.lit(0).alias("street_id"), null.alias("street"), null.alias("folded_street"), null.alias("postcode"), F.when(hard, "2").otherwise("1").alias("house_number"),
        null.alias("house_letter"), F.when(soft, "2").otherwise("1").alias("floor"), null.alias("door"), null.alias("city"), F.lit("current").alias("lifecycle"),
    )
    top = o.withColumn("q", q).withColumn("row", row)
    return resolve._confident(top, resolve.Params(margin_a=0.3, margin_b=0.05)).select("qid", "rank", "confidence")


@query("normalize_documents", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(lower(text), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), 'àáâãäçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaceeeeiiiinooooouuuuyy'), '[.,/\\-\\s]+', ' ', 'g'), '\\b0+(\\d)', '\\1', 'g'), '^ +| +$', '', 'g')) AS normalized FROM documents")
def normalize_documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.normalize_ascii(F.col("text")).alias("normalized"))


@query("normalize_urls")
def normalize_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.normalize_text(F.col("url")).alias("normalized"), X.url_decode_text(F.col("url")).alias("decoded"), X.repair_text(F.col("url")).alias("repaired"), F.md5(X.normalize_text(F.col("html"))).alias("html_normalized"))


@query("fold_text", "SELECT doc_id, strip_accents(replace(replace(replace(replace(replace(replace(text, 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), 'Æ', 'Ae'), 'Ø', 'Oe'), 'Å', 'Aa')) AS folded FROM documents")
def fold_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.fold_text(F.col("text")).alias("folded"))


@query("strip_recipient", "SELECT conv_id, turn, CASE WHEN len(list_filter(string_split(t, ','), lambda p: regexp_matches(p, '\\d') OR NOT regexp_matches(p, '(^|[^\\pL\\pN_])(c/?o|att(n|ention)?)($|[^\\pL\\pN_])|(^|[^\\pL\\pN_])v/'))) > 0 THEN array_to_string(list_filter(string_split(t, ','), lambda p: regexp_matches(p, '\\d') OR NOT regexp_matches(p, '(^|[^\\pL\\pN_])(c/?o|att(n|ention)?)($|[^\\pL\\pN_])|(^|[^\\pL\\pN_])v/')), ' ') ELSE t END AS kept FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'c/o x, ' ELSE '' END || text AS t FROM conversations)")
def strip_recipient(spark, sf):
    text = F.concat(F.when(F.col("turn") % 2 == 0, "c/o x, ").otherwise(""), F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", X.strip_recipient_column(text).alias("kept"))


@query("strip_pad", "SELECT DISTINCT c_name, regexp_replace(replace(c_name, '#', ' '), '\\b0+(\\d)', '\\1', 'g') AS stripped FROM customer")
def strip_pad(spark, sf):
    return read(spark, sf, "customer").select("c_name", X.strip_pad(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("stripped")).distinct()


@query("house_number_split", "SELECT p_partkey, CASE WHEN regexp_matches(t, '^\\d+[A-Za-z]?$') THEN regexp_extract(t, '^\\d+') ELSE t END AS number, CASE WHEN regexp_matches(t, '^\\d+[A-Za-z]?$') THEN nullif(regexp_extract(t, '[A-Za-z]$'), '') END AS letter FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN '' WHEN 2 THEN '-b' ELSE 'c' END AS t FROM part)")
def house_number_split(spark, sf):
    tail = F.element_at(F.array(F.lit("H"), F.lit(""), F.lit("-b"), F.lit("c")), (F.col("p_partkey") % 4 + 1).cast("int"))
    number, letter = X.split_house_number(F.concat(F.col("p_size").cast("string"), tail))
    return read(spark, sf, "part").select("p_partkey", number.alias("number"), letter.alias("letter"))


@query("value_conversion", "SELECT event_id, nullif(trim(t), '') AS cleaned, TRY_CAST(nullif(trim(t), '') AS DOUBLE) AS number, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS utc FROM (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || CAST(value AS VARCHAR) || ' ' ELSE event_type END AS t FROM events)")
def value_conversion(spark, sf):
    t = F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).otherwise(F.col("event_type"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read(spark, sf, "events").select("event_id", X.clean(t).alias("cleaned"), X.to_float(t).alias("number"), X.utc_text(stamp).alias("utc"))


@query("unit_synonyms", "SELECT s_suppkey, coalesce(map {'stuen': 'st', 'kl': 'kld', 'kaelder': 'kld'}[f], f) AS floor, coalesce(map {'venstre': 'tv', 'hoejre': 'th', 'midt': 'mf'}[d], d) AS door FROM (SELECT s_suppkey, ['stuen', 'kl', 'kaelder', '3'][s_suppkey % 4 + 1] AS f, ['venstre', 'hoejre', 'midt', '7'][s_suppkey % 4 + 1] AS d FROM supplier)")
def unit_synonyms(spark, sf):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf, "supplier").select("s_suppkey", X.canonical(pick("stuen", "kl", "kaelder", "3"), X.FLOORS).alias("floor"), X.canonical(pick("venstre", "hoejre", "midt", "7"), X.DOORS).alias("door"))


@query("search_token", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND regexp_matches(v, '^[0-9]+$') THEN v ELSE p_name END AS token FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS v FROM part)")
def search_token(spark, sf):
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    target = F.when(F.col("p_partkey") % 3 == 0, "street").otherwise("postcode")
    return read(spark, sf, "part").select("p_partkey", X.search_token(target, value, F.col("p_name")).alias("token"))


@query("render_address", "SELECT p_partkey, array_to_string(list_filter([p_name || ' ' || CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN '1. tv' ELSE '' END, substr(p_brand, 7) || ' ' || p_type], lambda x: x <> ''), ', ') AS address FROM part")
def render_address(spark, sf):
    some, null = F.col("p_partkey") % 5 == 0, F.lit(None).cast("string")
    shown = X.render_address(F.col("p_name"), F.col("p_size").cast("string"), null, F.when(some, "1"), F.when(some, "tv"), F.substring("p_brand", 7, 9), F.col("p_type"))
    return read(spark, sf, "part").select("p_partkey", shown.alias("address"))


@query("component_map", "SELECT p_partkey, array_to_string(list_filter(['street=' || p_name, 'floor=' || CASE WHEN p_partkey % 5 = 0 THEN '1' END, 'postcode=' || substr(p_brand, 7)], lambda x: x IS NOT NULL), ';') AS components FROM part")
def component_map(spark, sf):
    parts = X.present_map({"street": F.col("p_name"), "floor": F.when(F.col("p_partkey") % 5 == 0, "1"), "door": F.lit(""), "postcode": F.substring("p_brand", 7, 9)})
    shown = F.array_join(F.transform(F.map_entries(parts), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return read(spark, sf, "part").select("p_partkey", shown.alias("components"))


@query("edit_cost")
def edit_cost(spark, sf):
    """The cost between each query and every name that is similar to it."""
    n = names(spark, sf)
    pairs = similarities(asked(spark, sf), n).join(small(n.select("id", "folded")), "id")
    return pairs.select("query", "folded", X.edit_cost(F.col("query"), F.col("folded")).alias("cost"))


@query("word_extent")
def word_extent(spark, sf):
    """The extent of each query in every name that is similar to it."""
    n = names(spark, sf)
    pairs = similarities(asked(spark, sf), n).join(small(n.select("id", "folded")), "id")
    return pairs.select("query", "folded", F.round(X.best_extent(F.col("query"), F.col("folded")), 9).alias("extent"))


@query("close_match_members")
def close_match_members(spark, sf):
    found = close_members(asked(spark, sf).select(F.col("query").alias("token")), names(spark, sf).select(F.col("folded").alias("name")), 0.75, 8)
    return found.select(F.col("token").alias("query"), "name", F.round("ratio", 9).alias("ratio"), "rank")


@query("char_vocabulary", "SELECT char, CAST(row_number() OVER (ORDER BY char) + 1 AS INTEGER) AS code FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS char FROM part) WHERE char <> ''")
def char_vocabulary(spark, sf):
    return tagging.vocabulary(read(spark, sf, "part"), "p_name")


@query("segment_addresses")
def segment_addresses(spark, sf):
    text = X.render_address(F.col("p_name"), F.col("p_size").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lpad(F.substring("p_brand", 7, 9), 4, "2"), F.lower("p_type"))
    rows = read(spark, sf, "part").select("p_partkey", X.normalize_ascii(text).alias("text")).withColumn("spans", tagging.segment(F.col("text")))
    return rows.select("p_partkey", "text", *tagging.decomposed(F.col("text"), F.col("spans"), ("street", "house_number", "house_letter", "postcode", "city")))


@query("noise_corpus")
def noise_corpus(spark, sf):
    a = addresses(spark, sf).join(names(spark, sf).select(F.col("id").alias("street_id"), F.col("name").alias("street")), "street_id").withColumn("postcode", F.lpad("postcode", 4, "2"))
    return corpus(a.select(F.col("address_id").alias("id"), "street", "house_number", "house_letter", "floor", "door", "postcode", "city"))


PLACES = "pl AS (SELECT c_custkey AS id, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS code, CASE WHEN c_custkey % 4 = 0 THEN 'retired' ELSE 'current' END AS lifecycle FROM customer)"


def places(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lower("c_mktsegment").alias("folded"), F.col("c_nationkey").cast("string").alias("code"), F.when(F.col("c_custkey") % 4 == 0, "retired").otherwise("current").alias("lifecycle"))


@query("search_by_code", f"WITH {PLACES}, h AS (SELECT CAST(n_nationkey AS VARCHAR) AS query, id, row_number() OVER (PARTITION BY n_nationkey ORDER BY id) AS rank FROM nation JOIN pl ON code = CAST(n_nationkey AS VARCHAR) WHERE lifecycle = 'current' QUALIFY rank <= 5) SELECT query, id, rank, CASE WHEN rank > 1 OR lead(rank) OVER (PARTITION BY query ORDER BY rank) IS NOT NULL THEN 'C' ELSE 'A' END AS confidence FROM h")
def search_by_code(spark, sf):
    q = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("query"))
    return gazetteer.by_code(q, places(spark, sf), 5).select("query", "id", "rank", "confidence")


@query("search_by_name", f"WITH {SIMS}, h AS (SELECT query, id, name, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM sims QUALIFY rank <= 3), l AS (SELECT *, lead(sim) OVER (PARTITION BY query ORDER BY rank) AS nx FROM h) SELECT query, id, name, rank, CASE WHEN rank > 1 OR coalesce(nx >= sim - 1e-9, false) THEN 'C' WHEN sim >= 1 - 1e-9 THEN 'A' ELSE 'B' END AS confidence FROM l")
def search_by_name(spark, sf):
    register = names(spark, sf).withColumn("lifecycle", F.lit("current"))
    return gazetteer.by_name(asked(spark, sf), register, 3).select("query", "id", "name", "rank", "confidence")


@query("road_features", f"""WITH {SIMS}, d AS (SELECT query, id, sim FROM sims QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) <= 5),
    rd AS (SELECT p_partkey AS road_id, n.id AS street_id, substr(p_brand, 7) AS pc FROM part JOIN n ON p_name = n.name)
    SELECT query, road_id, round(sim, 9) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, road_id) AS rank FROM d JOIN rd ON rd.street_id = d.id WHERE length(query) % 2 = 0 OR pc IN ('3', '14') QUALIFY rank <= 5""")
def road_features(spark, sf):
    roads = addresses(spark, sf).select(F.col("address_id").cast("long").alias("road_id"), "street_id", F.array("postcode").alias("postcodes"), F.lit("current").alias("lifecycle"))
    streets = names(spark, sf).select(F.col("id").alias("street_id"), F.col("folded").alias("folded_street"))
    q = asked(spark, sf).withColumn("pin", F.when(F.length("query") % 2 == 1, F.array(F.lit("3"), F.lit("14"))))
    return gazetteer.road_features(q, streets, roads, 5).select("query", "road_id", F.round("sim", 9).alias("sim"), "rank")


@query("property_by_code", "WITH h AS (SELECT CAST(p_size AS VARCHAR) AS query, CAST(c_custkey AS VARCHAR) AS bfe, 0 AS p FROM (SELECT DISTINCT p_size FROM part) JOIN customer ON c_custkey = p_size UNION ALL SELECT DISTINCT CAST(p_size AS VARCHAR), CAST(c_custkey AS VARCHAR), 1 FROM (SELECT DISTINCT p_size FROM part) JOIN customer ON c_nationkey = p_size), m AS (SELECT query, bfe, min(p) AS priority FROM h GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, bfe) AS rank FROM m QUALIFY rank <= 20")
def property_by_code(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("bfe"), F.col("c_nationkey").cast("string").alias("code"))
    return gazetteer.property_by_code(read(spark, sf, "part").select(F.col("p_size").cast("string").alias("query")).distinct(), c, c, 20)


@query("property_by_label")
def property_by_label(spark, sf):
    parcels = names(spark, sf).select(F.col("id").alias("bfe"), F.col("id").alias("parcel"), "folded")
    return gazetteer.property_by_label(asked(spark, sf), parcels, X.best_extent, 5).select("query", "bfe", F.round("sim", 9).alias("sim"), "rank", "confidence")


@query(
    "project_confidence",
    """WITH r AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders QUALIFY rank <= 5),
    c AS (SELECT * FROM r WHERE v IS NOT NULL), t AS (SELECT qid, arg_min(v, rank) AS top, count(*) AS n, min(rank) AS best FROM c GROUP BY qid),
    a AS (SELECT t.qid, n, best, count(*) FILTER (v = top) AS agree FROM c JOIN t USING (qid) GROUP BY ALL),
    d AS (SELECT qid, v AS value, min(rank) AS b FROM c GROUP BY ALL)
    SELECT d.qid, value, row_number() OVER (PARTITION BY d.qid ORDER BY b) AS rank,
           CASE WHEN row_number() OVER (PARTITION BY d.qid ORDER BY b) > 1 THEN 'C' WHEN n = 1 THEN CASE WHEN best = 1 THEN 'A' ELSE 'C' END WHEN agree = n THEN 'A' WHEN agree * 2 > n THEN 'B' ELSE 'C' END AS confidence
    FROM d JOIN a USING (qid)""",
)
def project_confidence(spark, sf):
    from ..operators.knn import ranked

    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v"))
    top = ranked(o, 5, [F.desc("o_totalprice"), "o_orderkey"], ["qid"]).withColumn("confidence", F.when(F.col("rank") == 1, "A").otherwise("C"))
    return gazetteer.projected(top, "v", 10)


@query("projected_area", "SELECT CAST(c_custkey AS BIGINT) AS qid, value, coalesce(n_name, value) AS name, 1.0::DOUBLE AS score FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer) LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = value")
def projected_area(spark, sf):
    values = read(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 9 == 0, "x").otherwise(F.col("c_nationkey").cast("string")).alias("value"))
    return gazetteer.with_area(values, read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))).select("qid", "value", "name", "score")






@query("deepest_area", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'sogn' WHEN p_partkey % 5 = 0 THEN 'postcode' WHEN p_partkey % 3 = 0 THEN 'city' WHEN p_partkey % 2 = 0 THEN 'kommune' END AS area, p_size > 20 AND NOT (p_partkey % 4 = 0 AND (p_size > 40 OR p_partkey % 5 = 0 OR p_partkey % 3 = 0)) AND (p_size > 40 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0) AS features FROM part")
def deepest_area(spark, sf):
    k = F.col("p_partkey")
    has = {c: F.when(k % n == 0, "x") for c, n in (("sogn", 7), ("postcode", 5), ("city", 3), ("kommune", 2))}
    asks = has | {"street": F.when(F.col("p_size") > 40, "x"), "house_number": F.when(F.col("p_size") <= 20, "1")}
    return read(spark, sf, "part").select("p_partkey", gazetteer.deepest_area(has).alias("area"), gazetteer.uses_features(asks, k % 4 == 0).alias("features"))
