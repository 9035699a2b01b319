"""Mix sources to target weights by thresholds on a hash, found from histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import WORD, materialize

_HASH_BITS = 60


def hash60(*columns: str) -> Column:
    """First 60 bits of the md5 of the values' texts, as a long; null counts as an own value."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target) per source: the budget shared by weight, no target over `most` x the source's size.

    What sources over their limit can't take is shared among the rest by weight until none is above. In order of
    limit / weight the limited sources come first, so the fixed point is found by running sums. One row a source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = one.withColumn("place", F.row_number().over(place)).withColumn("weight", weight.cast("double"))
    one = one.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    one = one.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(everything),
            "total": budget * F.sum("source_size").over(everything),
        }
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    one = one.withColumn("level", level)
    # The first source that its level doesn't fill sets the level of all from there on.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level").alias("level"))))
    one = one.withColumn("final", free.over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return one.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    bits: int = 12,
) -> DataFrame:
    """Words that the mix takes of every document, so that each source comes near its target.

    docs: (doc_id, text, source, ...). A source takes all its documents as often as its target holds its size whole,
    and for the rest those whose hash lies below a threshold. To find it, words are summed by source and leading
    `bits` of the hash; the first bucket that passes the rest of the budget is the boundary, and only its documents
    are split by the next bits, down to the last. Nothing is sorted by document; a source of any share of the rows
    is summed map-side into at most 2^bits buckets. Thresholds of growing budgets are nested.

    A null text has size 0 and takes 0; null is a source of its own, the last. Documents with equal ids share their
    fate. Ends within half a document (or group of equal ids) of the target. Other columns are ignored.
    Returns doc_id, size, source_size, target, taken.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = materialize(docs.select("doc_id", "source", size, hash60("doc_id").alias("hash")), "sizes")
    wanted = targets(sized, weights, budget, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("passes", passes.cast("long"))
    wanted = materialize(wanted.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")

    # state: per source the leading bits of the boundary, and the words below it; gone once no boundary is left.
    state = wanted.select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for fixed in range(0, _HASH_BITS, bits):
        shift = _HASH_BITS - fixed
        inside = sized.join(state, F.col("source").eqNullSafe(F.col("of")))
        inside = inside.where(F.shiftright("hash", shift) == F.col("prefix")) if fixed else inside
        bucket = F.shiftright("hash", shift - bits).alias("bucket")
        sums = inside.groupBy("of", "rest", "below", bucket).agg(F.sum("size").alias("words"))
        running = F.col("below") + F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        first = sums.withColumn("upto", running).where("upto > rest").groupBy("of", "rest").agg(
            F.min_by(F.struct("bucket", "upto", "words"), "bucket").alias("b")
        )
        state = first.select("of", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("below"), F.col("b.words").alias("words"))
    # Documents at the threshold itself are taken if that ends nearer to the target.
    state = materialize(state, "boundary")
    over = 2 * F.col("below") + F.col("words") <= 2 * F.col("rest")
    limits = state.select("of", (F.col("prefix") + over.cast("long")).alias("limit"))
    ends = wanted.join(limits, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("whose"), "source_size", "target", "passes", "limit"
    )
    chosen = F.coalesce(F.col("hash") < F.col("limit"), F.lit(False)).cast("long")
    taken = F.col("size") * (F.col("passes") + chosen)
    return sized.join(ends, F.col("source").eqNullSafe(F.col("whose"))).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken")
    )
