"""Metrics of ranked results and taggings, and the calibration of weights and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall at 1 and 5 and mean reciprocal rank of ``results`` (target rank ``rank``, null if missed)."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), hit(1).alias("recall_1"), hit(5).alias("recall_5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")]
    return (results.groupBy(*by) if by else results).agg(*aggs)


def refusal_metrics(results: DataFrame) -> DataFrame:
    """For inputs without a target: how often something was returned, and how often with confidence A."""
    return results.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("returned").cast("double")).alias("return_rate"), F.avg((F.col("confidence") == "A").cast("double")).alias("confident_rate"))


def span_scores(predicted: DataFrame, expected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of exact spans (id, label, start, end)."""
    keys = ["id", "label", "start", "end"]
    both = predicted.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(expected.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("e")))
    spans = both.groupBy(*keys).agg(F.max("p").alias("p"), F.max("e").alias("e"))
    aggs = [F.sum(F.col("p") * F.col("e")).alias("tp"), F.sum("p").alias("predicted"), F.sum("e").alias("expected")]
    counts = (spans.groupBy(*by) if by else spans).agg(*aggs)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("expected"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """Percentiles that are values of the data: the ceil(p n / 100)-th smallest. Groups are counted, not gathered."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(*by))
    placed = counts.withColumn("upto", upto).withColumn("total", total)
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total") / 100), F.col(value))).alias(f"p{p}") for p in percents])


def agreement(m_hits: Column, m_n: Column, u_hits: Column, u_n: Column) -> tuple[Column, Column]:
    """Shares of agreeing axes among true and among false pairs, each with one more of either kind."""
    return (m_hits + 1) / (m_n + 2), (u_hits + 1) / (u_n + 2)


def axis_weight(m: Column, u: Column, eps: float = 1e-3) -> Column:
    """The log-likelihood ratio between agreement and disagreement, in units of ln(1 / eps), not below 0."""
    return F.greatest(F.lit(0.0), (F.ln(m / u) - F.ln((1 - m) / (1 - u))) / F.ln(F.lit(1 / eps)))


def margin_grid(gaps: DataFrame, grid: DataFrame, reference_rate: float, least: int = 40) -> DataFrame:
    """Margin pairs (a, b), b at most a, with their confident and false counts; ``keep`` marks those that are as safe as the reference.

    ``gaps`` has (gap, correct) of leaders; it is summed per gap before it meets the grid, which is a bounded parameter.
    """
    per_gap = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("correct")).cast("int")).alias("wrong"))
    met = per_gap.join(F.broadcast(grid), F.col("gap") >= F.col("a"))
    totals = met.groupBy("a", "b").agg(F.sum("n").alias("confident"), F.sum("wrong").alias("false_confident"))
    return totals.withColumn("keep", (F.col("confident") >= least) & (F.col("false_confident") / F.col("confident") <= reference_rate))


def throughput(results: DataFrame, seconds: Column) -> DataFrame:
    """Counts of outcomes, and answers a second."""
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "shed").alias("shed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if((F.col("status") == "ok") & (F.col("found") == 0)).alias("empty"), (F.count_if(F.col("status") == "ok") / F.max(seconds)).alias("per_second"),
    )


def corpus_faults(records: DataFrame, configured: list[str], normalized_of=None) -> DataFrame:
    """(fault, n): what is wrong with a corpus: records whose ``noise`` is not the number of their ``mutations``, that name one twice, or have a span
    outside their text, ``configured`` mutations and tiers that no record has, and no record without ``target``. Only faults that occur are returned."""
    listed = F.col("mutations")
    tests = {
        "noise differs from mutations": F.col("noise") != F.size(listed),
        "a mutation twice": F.size(listed) != F.size(F.array_distinct(listed)),
        "a span outside the text": F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length("normalized"))),
    }
    if normalized_of is not None:
        tests["normalised otherwise"] = normalized_of(F.col("raw")) != F.col("normalized")
    want = F.array(*[F.lit(x) for x in configured])
    seen = records.agg(
        *[F.count_if(test).alias(name) for name, test in tests.items()],
        F.size(F.array_except(want, F.flatten(F.collect_set(listed)))).cast("long").alias("mutations that no record has"),  # as many sets as there are combinations of names
        F.size(F.array_except(F.array(*[F.lit(x) for x in (1, 2, 3)]), F.collect_set("tier"))).cast("long").alias("tiers that no record has"),
        (F.count_if(F.col("target").isNull()) == 0).cast("long").alias("no record without target"),
    )
    names = [*tests, "mutations that no record has", "tiers that no record has", "no record without target"]
    return seen.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(f"`{n}`").alias("n")) for n in names])).alias("f")).select("f.*").filter("n > 0")


def mutation_gaps(records: DataFrame, configured: list[str]) -> DataFrame:
    """(missing, unknown): configured mutations that no record has, and names that are not configured."""
    seen = records.select(F.explode("mutations").alias("m")).distinct().agg(F.collect_set("m").alias("seen"))  # as many as there are names
    want = F.array(*[F.lit(x) for x in configured])
    return seen.select(F.array_sort(F.array_except(want, "seen")).alias("missing"), F.array_sort(F.array_except("seen", want)).alias("unknown"))


def machine_factor(now: DataFrame, baked: DataFrame, spread: float = 0.15, divergence: float = 1.5) -> DataFrame:
    """One row: how this machine compares with the one of the published figures, and whether the comparison can be trusted.

    ``now`` and ``baked`` have (kernel, seconds), one row a repetition; the factor is the median over kernels of the ratio of medians.
    """
    per = lambda df, name: df.groupBy("kernel").agg(F.median("seconds").alias(name), ((F.max("seconds") - F.min("seconds")) / F.median("seconds")).alias(f"{name}_spread"))
    both = per(now, "own").join(per(baked, "then"), "kernel").withColumn("ratio", F.col("then") / F.col("own"))
    out = both.agg(F.median("ratio").alias("factor"), (F.max("ratio") / F.min("ratio")).alias("divergence"), F.count_if(F.col("own_spread") > spread).alias("noisy"))
    return out.withColumn("trusted", (F.col("noisy") == 0) & (F.col("divergence") <= divergence))


def thinned(values: DataFrame, value: str, most: int) -> DataFrame:
    """At most ``most`` of the distinct values, evenly spaced in their order: every n-th, and the largest. For grids, whose values are few."""
    distinct = values.select(value).distinct()
    stride = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / F.lit(most))
    placed = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(value))) - 1).withColumn("_s", stride)
    return placed.filter("_n % _s = 0").select(value)


FACTORS = (0.25, 0.5, 0.8, 1.25, 2.0, 4.0)


def objective(grades: DataFrame, weights: dict[str, float], eps: float = 1e-3) -> tuple[float, float]:
    """(recall at 5, mean reciprocal rank) of candidates (qid, candidate, is_target, and a grade or null an axis) scored by ``weights``."""
    total = sum((F.coalesce(F.lit(w) * F.ln(F.lit(eps) + F.col(axis)), F.lit(0.0)) for axis, w in weights.items()), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_score"), "candidate"))
    hit = grades.withColumn("_score", total).withColumn("_rank", rank).groupBy("qid").agg(F.min(F.when(F.col("is_target"), F.col("_rank"))).alias("rank"))
    row = rank_metrics(hit).first()
    return round(row.recall_5 or 0.0, 9), round(row.mrr or 0.0, 9)


def tuned_weights(grades: DataFrame, weights: dict[str, float], passes: int = 3, factors: tuple[float, ...] = FACTORS, eps: float = 1e-3) -> tuple[dict[str, float], tuple[float, float]]:
    """Weights after coordinate ascent on :func:`objective`: each axis in turn takes the factor that is best, until a pass changes nothing.

    All factors of an axis are scored in one pass over the candidates, so a round costs one aggregate an axis.
    """
    now, best = dict(weights), objective(grades, weights, eps)
    for _ in range(passes):
        changed = False
        for axis in list(now):
            found = []
            for factor, (recall, mrr) in zip(factors, _trials(grades, now, axis, factors, eps), strict=True):
                found.append(((recall, mrr), factor))
            top, factor = max(found, key=lambda x: x[0])
            if top > best:
                best, now[axis], changed = top, now[axis] * factor, True
        if not changed:
            break
    return now, best


def _trials(grades: DataFrame, weights: dict[str, float], axis: str, factors: tuple[float, ...], eps: float) -> list[tuple[float, float]]:
    part = lambda a, w: F.coalesce(F.lit(w) * F.ln(F.lit(eps) + F.col(a)), F.lit(0.0))
    rest = sum((part(a, w) for a, w in weights.items() if a != axis), F.lit(0.0))
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (rest + part(axis, weights[axis] * f)).alias("score")) for k, f in enumerate(factors)]))
    each = grades.select("qid", "candidate", "is_target", tried.alias("t")).select("qid", "candidate", "is_target", "t.*")
    rank = F.row_number().over(Window.partitionBy("k", "qid").orderBy(F.desc("score"), "candidate"))
    hit = each.withColumn("_rank", rank).groupBy("k", "qid").agg(F.min(F.when(F.col("is_target"), F.col("_rank"))).alias("rank"))
    rows = {r.k: r for r in rank_metrics(hit, ["k"]).collect()}  # one row a factor
    return [(round(rows[k].recall_5 or 0.0, 9), round(rows[k].mrr or 0.0, 9)) if k in rows else (0.0, 0.0) for k in range(len(factors))]
