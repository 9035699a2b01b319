"""Ranking metrics over judged pairs, stratified samples and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = 2


def metrics(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """One row per `by`: recall, precision, nDCG and MRR at k from (by, rank, label); null labels are unjudged.

    No denominator gives null, never 0; MRR is 0 if nothing relevant is in the window and null if nothing is judged.
    """
    gain, seen = F.pow(F.lit(2.0), F.col("label")) - 1, F.col("label").isNotNull()
    ideal = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("label"), "rank"))
    inside, good = F.col("rank") <= k, F.col("label") >= RELEVANT
    out = ranked.withColumn("ideal", ideal).groupBy(by).agg(
        F.count_if(seen).alias("judged"),
        F.count_if(~seen).alias("unjudged"),
        F.count_if(good).alias("relevant"),
        F.count_if(good & inside).alias("hits"),
        F.count_if(seen & inside).alias("judged_in"),
        F.sum(F.when(seen & inside, gain / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.sum(F.when(seen & (F.col("ideal") <= k), gain / F.log2(F.col("ideal") + 1.0))).alias("best"),
        F.min(F.when(good & inside, F.col("rank"))).alias("first"),
    )
    mrr = F.when(F.col("judged") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    return out.select(
        by, "judged", "unjudged", "relevant",
        F.expr("try_divide(hits, relevant)").alias("recall"),
        F.expr("try_divide(hits, judged_in)").alias("precision"),
        F.expr("try_divide(coalesce(dcg, 0.0), nullif(best, 0.0))").alias("ndcg"),
        mrr.alias("mrr"),
    )


def metric_report(ranked: DataFrame, by: str, ks: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """(by, metric, k, value): recall at every k, nDCG up to 20, precision and MRR at 10, and the counts judged, unjudged, relevant (k null).

    ranked: (by, rank, label), ranks from 1. A metric without a denominator is null. The best order, which nDCG needs, is
    looked at no further than its greatest k, so no task sorts all pairs of a ranking.
    """
    deep = tuple(k for k in ks if k <= 20)
    gain, seen, good = F.pow(F.lit(2.0), F.col("label")) - 1, F.col("label").isNotNull(), F.col("label") >= RELEVANT
    within = lambda k: F.col("rank") <= k
    out = ranked.groupBy(by).agg(
        F.count_if(seen).alias("judged"), F.count_if(~seen).alias("unjudged"), F.count_if(good).alias("relevant"),
        *(F.count_if(good & within(k)).alias(f"hits_{k}") for k in ks), *(F.sum(F.when(seen & within(k), gain / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}") for k in deep),
        F.count_if(good & within(10)).alias("hits_ten"), F.count_if(seen & within(10)).alias("judged_ten"), F.min(F.when(good & within(10), F.col("rank"))).alias("first"),
    )
    if deep:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("label"), "rank"))
        best = ranked.where(seen).withColumn("place", place).where(F.col("place") <= max(deep))
        best = best.groupBy(by).agg(*(F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1.0))).alias(f"best_{k}") for k in deep))
        out = out.join(best.withColumnRenamed(by, "by_"), F.col(by).eqNullSafe(F.col("by_")), "left")
    one = lambda name, k, v: F.struct(F.lit(name).alias("metric"), F.lit(k).cast("int").alias("k"), v.cast("double").alias("value"))
    rows = [one(c, None, F.col(c)) for c in ("judged", "unjudged", "relevant")]
    rows += [one("recall", k, F.try_divide(F.col(f"hits_{k}"), F.col("relevant"))) for k in ks]
    rows += [one("ndcg", k, F.try_divide(F.coalesce(f"dcg_{k}", F.lit(0.0)), F.nullif(F.col(f"best_{k}"), F.lit(0.0)))) for k in deep]
    rows += [one("precision", 10, F.try_divide(F.col("hits_ten"), F.col("judged_ten"))), one("mrr", 10, F.when(F.col("judged") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))))]
    return out.select(by, F.explode(F.array(*rows)).alias("m")).select(by, "m.*")


def score_band(score: Column) -> Column:
    """0, 10, ... 90."""
    return (F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(99.999)) / 10) * 10).cast("int")


def stratified_sample(pool: DataFrame, size: int) -> DataFrame:
    """Round robin over (band, language) strata in rising order, best score first: (id, score, language, band, depth), no chance involved."""
    pool = pool.withColumn("band", score_band(F.col("score"))).withColumn("stratum", F.coalesce("language", F.lit("unknown")))
    depth = F.row_number().over(Window.partitionBy("band", "stratum").orderBy(F.desc("score"), "id"))
    deep = pool.withColumn("depth", depth).where(F.col("depth") <= size)
    return deep.orderBy("depth", "band", "stratum").limit(size).drop("stratum")


def coverage(pool: DataFrame) -> DataFrame:
    """Rows by band and by language, in one pass."""
    banded = pool.withColumn("band", score_band(F.col("score")))
    sets = banded.groupingSets([["band"], ["language"]], "band", "language")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("kind"))


def new_sample(pool: DataFrame, existing: DataFrame, size: int) -> DataFrame:
    """`stratified_sample` of what isn't in existing (id)."""
    return stratified_sample(pool.join(existing.select("id"), "id", "left_anti"), size)


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    """(label, n) of labels that aren't null."""
    return labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
