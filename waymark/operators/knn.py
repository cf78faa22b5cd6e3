"""Trigram nearest neighbours over an exploded index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio, trigrams
from ..sources.staging import staged
from .sized import ROWS, is_small, small

#: Similarities below this are not kept; the bound belongs to what is kept.
FLOOR = 0.1


def similarities(queries: DataFrame, names: DataFrame, query_col: str = "query", id_col: str = "id", name_col: str = "folded") -> DataFrame:
    """(query, id, sim) of every query and name whose trigram sets have a similarity of ``FLOOR`` or more.

    Equal queries and equal names are worked on once. Both sides are exploded to (trigram, text); the
    count of common trigrams is pre-aggregated before it is shuffled. The index of the names is
    broadcast if it is small.
    """
    q = queries.select(F.col(query_col).alias("query")).filter("query is not null").distinct().withColumn("q_grams", trigrams(F.col("query")))
    known = names.select(F.col(name_col).alias("name")).filter("name is not null").distinct().withColumn("n_grams", trigrams(F.col("name")))
    left = q.select("query", F.size("q_grams").alias("q_size"), F.explode("q_grams").alias("gram"))
    right = known.select("name", F.size("n_grams").alias("n_size"), F.explode("n_grams").alias("gram"))
    # the rows that would be broadcast are counted as they are: some ten a name
    near = F.broadcast if is_small(right, ROWS) else (lambda df: df)
    common = left.join(near(right), "gram").groupBy("query", "name", "q_size", "n_size").agg(F.count(F.lit(1)).alias("common"))
    sim = F.col("common") / (F.col("q_size") + F.col("n_size") - F.col("common"))
    scored = common.select("query", "name", sim.alias("sim")).filter(F.col("sim") >= FLOOR)
    ids = names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"))
    return scored.join(small(ids), "name").select("query", "id", "sim")


def ranked(hits: DataFrame, cap: int, by: list, partition: list[str]) -> DataFrame:
    """The first ``cap`` rows of each partition, with their ``rank``; filters belong before this."""
    order = Window.partitionBy(*partition).orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def knn(queries: DataFrame, names: DataFrame, cap: int, query_col: str = "query", id_col: str = "id", name_col: str = "folded") -> DataFrame:
    """(query, id, sim, rank): similarity descending, id ascending."""
    return ranked(similarities(queries, names, query_col, id_col, name_col), cap, [F.desc("sim"), "id"], ["query"])


def street_combos(sims: DataFrame, bridge: DataFrame, cap: int, pins: DataFrame | None = None) -> DataFrame:
    """(qid, street_id, postcode, sim, rank) of the first ``cap`` combinations of street and postcode, with what else ``sims`` has.

    ``sims`` has (qid, street_id, sim), perhaps ``alias_lifecycle``, null for a street's own name, which comes before earlier ones; ``pins``
    (qid, postcodes) confines a query to postcodes: a null array pins nothing, an unknown postcode leaves nothing.
    """
    order = [F.desc("sim"), "street_id"]
    if "alias_lifecycle" in sims.columns:
        order.append(F.col("alias_lifecycle").isNotNull())
    if "folded_street" in sims.columns:
        order.append("folded_street")
    # a street's postcodes come one after the other, so streets are counted off first and only those that the cap reaches are spread out
    held = bridge.select("street_id", "postcode").groupBy("street_id").agg(F.sort_array(F.collect_set(F.struct("postcode"))).alias("held"))
    held = small(staged(held, "combos-held"))
    rows, size = sims.join(held, "street_id"), F.size("held")
    own = F.lit(None).cast(held.schema["held"].dataType)
    if pins is not None:
        rows = rows.join(pins, "qid", "left")
        within = F.filter("held", lambda p: F.coalesce(F.array_contains("postcodes", p["postcode"]), F.lit(True)))
        own, size = F.when(F.col("postcodes").isNotNull(), within), F.when(F.col("postcodes").isNotNull(), F.size(within)).otherwise(F.size("held"))
    rows = rows.select(*sims.columns, own.alias("own"), size.alias("size"))
    before = Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")).filter((F.col("above") < cap) & (F.col("size") > 0))
    reached = F.slice(F.coalesce("own", "held"), F.lit(1), F.lit(cap) - F.col("above"))
    rows = rows.join(held, "street_id").select(*sims.columns, "above", F.posexplode(reached).alias("at", "combo"))
    return rows.select(*sims.columns, F.col("combo.postcode").alias("postcode"), (F.col("above") + F.col("at") + 1).alias("rank"))


def close_members(tokens: DataFrame, names: DataFrame, cutoff: float, n: int | None = None) -> DataFrame:
    """(token, name, ratio, rank) of the names close to each token: itself if it is one, else those of a matching ratio of ``cutoff`` or more, best first.

    A ratio counts twice the matched characters over all of them, so no pair that shares fewer characters than ``cutoff`` asks for can
    reach it. Tokens and names meet by a character that both have among their first, rarest ones, and by their lengths.
    """
    t = tokens.select("token").filter("token is not null").distinct()
    known = names.select("name").filter("name is not null").distinct()
    exact = t.join(known, F.col("token") == F.col("name")).select("token", "name", F.lit(1.0).alias("ratio"))
    rest = t.join(exact.select("token"), "token", "left_anti")

    def letters(rows: DataFrame, text: str) -> DataFrame:
        """A character and which occurrence of it in the text it is."""
        chars = rows.select(text, F.length(text).alias("size"), F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("char"))
        counts = chars.groupBy(text, "size", "char").agg(F.count(F.lit(1)).alias("times"))
        numbered = F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda k: F.concat_ws("#", "char", k.cast("string")))
        return counts.select(text, "size", F.explode(numbered).alias("char"))

    a, b = letters(rest, "token"), letters(known, "name")
    counts = b.groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("token").orderBy(F.coalesce("n", F.lit(0)), "char")
    # at least cutoff / (2 - cutoff) of the token's characters are matched, whatever the name
    first = a.join(counts, "char", "left").withColumn("at", F.row_number().over(order))
    first = first.filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * (cutoff / (2 - cutoff)) - 1e-9) + 1)
    fits = 2 * F.least("size", "size_b") >= (cutoff - 1e-9) * (F.col("size") + F.col("size_b"))
    pairs = first.select("token", "size", "char").join(b.select("name", F.col("size").alias("size_b"), "char"), "char").filter(fits).select("token", "name").distinct()
    near = pairs.withColumn("ratio", ratio(F.col("token"), F.col("name"))).filter(F.col("ratio") >= cutoff)
    found = exact.unionByName(near)
    return ranked(found, n or 1 << 30, [F.desc("ratio"), F.desc("name")], ["token"])
