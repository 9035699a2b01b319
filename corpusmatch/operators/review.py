"""Review of unknown terms: the last decision on a term counts, and promoted terms become internal concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_terms(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue (term, occurrences) with status: promoted, ignored or pending, by the last decision (term, action, ord).

    Undo is the action `pending`. Decisions on terms outside the queue come back with null occurrences and status missing.
    """
    last = decisions.groupBy("term").agg(F.max_by("action", "ord").alias("action"))
    both = queue.join(last, "term", "full")
    status = F.when(F.col("occurrences").isNull(), "missing").otherwise(F.coalesce("action", F.lit("pending")))
    return both.select("term", "occurrences", status.alias("status"))


def internal_concepts(reviewed: DataFrame, existing: DataFrame) -> DataFrame:
    """(concept_id, label, active): a concept for every term once promoted; those no longer promoted retire."""
    wanted = reviewed.where("status = 'promoted'").select(F.concat(F.lit("internal:"), "term").alias("concept_id"), F.col("term").alias("label"))
    old = existing.select("concept_id", F.col("label").alias("old_label"))
    both = wanted.join(old, "concept_id", "full")
    return both.select("concept_id", F.coalesce("label", "old_label").alias("label"), F.col("label").isNotNull().alias("active"))
