"""Requirement coverage: what a candidate's evidence says of each requirement of a posting, in four statuses, and its rollup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ways to a decision, first one first: (name, status).
METHODS = (("denied", "conflicting"), ("confirmed", "satisfied"), ("concept", "satisfied"), ("narrower", "partial"), ("broader", "partial"), ("similar", "partial"))


@dataclass(frozen=True)
class Policy:
    """Weights of requirements and values of statuses, which must keep their order."""

    required: float = 3.0
    preferred: float = 1.0
    satisfied: float = 1.0
    partial: float = 0.65
    unknown: float = 0.45
    conflicting: float = 0.0
    #: Similarity from which a text counts as partial evidence.
    least_similarity: float = 0.8

    def __post_init__(self) -> None:
        if not self.conflicting < self.unknown <= self.partial < self.satisfied:
            raise ValueError("statuses must rise from conflicting over unknown and partial to satisfied")
        if min(self.required, self.preferred) <= 0:
            raise ValueError("weights must be over 0")


def requirement_statuses(pairs: DataFrame, requirements: DataFrame, evidence: DataFrame, hierarchy: DataFrame, similar: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """(user_id, posting_id, requirement_id, necessity, status, method, evidence_id) of every requirement of every pair.

    requirements: (posting_id, requirement_id, concept_id, necessity, negated); evidence: (evidence_id, user_id,
    concept_id, has, confirmed, confidence), `has` false where the text denies it; hierarchy: (node, ancestor, distance);
    similar: (user_id, requirement_id, evidence_id, similarity).

    The first method that finds evidence decides: evidence that denies the same concept conflicts; a confirmed or linked
    one of the same concept satisfies; one of a narrower or broader concept, or of a similar text, is partial, the nearest
    and surest first. Without evidence the status is unknown, never conflicting. A negated requirement is satisfied by a
    denial and conflicts with possession; what is only near it says nothing. requirement_id tells a posting's requirements apart.

    What is asked and what is known of a user are dealt out by user once and meet in windows; these and the groups after them
    are within users, so the rows that ancestors add never leave their task.
    """
    keys = ["user_id", "posting_id", "requirement_id"]
    above = hierarchy.groupBy(F.col("node").alias("concept_id")).agg(F.collect_list(F.struct("ancestor", F.col("distance").cast("long").alias("distance"))).alias("above"))
    # Pairs are told apart where they meet the requirements of their posting.
    both = pairs.select("user_id", "posting_id").repartition("posting_id").dropDuplicates(["user_id", "posting_id"])
    needs = requirements.withColumn("negated", F.coalesce("negated", F.lit(False))).join(above, "concept_id", "left")
    # Rows with lists of ancestors are far larger than Spark takes them for, so it must not send them to all tasks by way of the driver.
    asked = both.join(needs.hint("merge"), "posting_id").select(*keys, "concept_id", "necessity", "negated", F.when(~F.col("negated"), F.col("above")).alias("above"))
    own = evidence.where("concept_id is not null and user_id is not null").join(above, "concept_id", "left").select(
        "user_id", "concept_id", F.when(F.coalesce("has", F.lit(True)), F.col("above")).alias("above"), "evidence_id", F.coalesce("has", F.lit(True)).alias("has"),
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    # Both sides stand at their own concept and climb to its ancestors, of which a concept has few; descendants are never listed.
    places = F.concat(F.array(F.struct(F.col("concept_id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))), F.coalesce("above", F.array().cast(above.schema["above"].dataType)))
    rows = asked.unionByName(own, allowMissingColumns=True).repartition("user_id")
    rows = rows.select(*(c for c in rows.columns if c != "above"), F.posexplode(places).alias("nth", "to"))
    rows = rows.select("*", F.col("to.ancestor").alias("at"), F.col("to.distance").alias("steps")).drop("to")

    number = {name: k for k, (name, _) in enumerate(METHODS)}
    ranked = lambda order, distance: F.struct(order.alias("order"), distance.cast("long").alias("distance"), (-F.col("confidence")).alias("unsure"), F.col("evidence_id"))
    fact, same = F.col("has").isNotNull(), F.col("nth") == 0
    sure = F.when(F.col("confirmed"), number["confirmed"]).otherwise(number["concept"])
    plain = ranked(F.when(~same, number["narrower"]).when(F.col("has"), sure).otherwise(number["denied"]), F.col("steps"))
    # Of a negated requirement a denial is what was asked for.
    turned = ranked(F.when(F.col("has"), number["denied"]).otherwise(sure), F.lit(0))
    met = Window.partitionBy("user_id", "at")
    best = lambda which, value: F.min(F.when(fact & which, value)).over(met)
    rows = rows.select("*", best(F.lit(True), plain).alias("plain"), best(same, turned).alias("turned"), best(same & F.col("has"), ranked(F.lit(number["broader"]), F.lit(0))).alias("held"))
    held = F.when(F.col("held").isNotNull(), F.struct("held.order", F.col("steps").alias("distance"), "held.unsure", "held.evidence_id"))
    found = F.when(~same, held).when(F.col("negated"), F.col("turned")).otherwise(F.col("plain"))
    best = rows.where(~fact).select(*keys, "concept_id", "necessity", "negated", found.alias("best")).groupBy(*keys, "concept_id", "necessity", "negated").agg(F.min("best").alias("best"))
    if similar is not None:
        near = similar.where(F.col("similarity") >= policy.least_similarity).withColumn("confidence", F.col("similarity"))
        near = near.groupBy("user_id", "requirement_id").agg(F.min(ranked(F.lit(number["similar"]), F.lit(0))).alias("like"))
        best = best.join(near, ["user_id", "requirement_id"], "left").withColumn("best", F.least("best", F.when(~F.col("negated"), F.col("like"))))
    method = F.coalesce(*(F.when(F.col("best.order") == k, F.lit(name)) for name, k in number.items()))
    status = F.coalesce(*(F.when(F.col("best.order") == number[name], F.lit(value)) for name, value in METHODS), F.lit("unknown"))
    return best.select(*keys, "necessity", status.alias("status"), method.alias("method"), F.col("best.evidence_id").alias("evidence_id"))


def coverage(statuses: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(user_id, posting_id, a count of each status, required_coverage, preferred_coverage, requirement_coverage, evidence_completeness).

    A coverage is the mean value of the statuses of its kind, null without any; the rollup weighs those that are there.
    Completeness is the share of requirements that anything is known of.
    """
    value = F.coalesce(*(F.when(F.col("status") == s, F.lit(getattr(policy, s))) for s in ("satisfied", "partial", "unknown", "conflicting")))
    mean = lambda kind: F.avg(F.when(F.col("necessity") == kind, value))
    out = statuses.groupBy("user_id", "posting_id").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("satisfied", "partial", "unknown", "conflicting")),
        mean("required").alias("required_coverage"), mean("preferred").alias("preferred_coverage"), F.avg(F.when(F.col("status") == "unknown", 0.0).otherwise(1.0)).alias("evidence_completeness"),
    )
    parts = (("required_coverage", policy.required), ("preferred_coverage", policy.preferred))
    over = sum(F.coalesce(w * F.col(c), F.lit(0.0)) for c, w in parts)
    under = sum(F.when(F.col(c).isNull(), 0.0).otherwise(w) for c, w in parts)
    return out.withColumn("requirement_coverage", F.try_divide(over, F.nullif(under, F.lit(0.0))))
