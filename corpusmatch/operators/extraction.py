"""Extraction over parsed revisions: profiles from spans, evidence checked against the stored text, links, and every move of a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.operators.linking import link_rows, status_counts
from corpusmatch.operators.profiles import competencies, verified_spans
from corpusmatch.operators.tables import latest_per_key

# Codes of a failed extraction.
EXTRACTION_ERROR, INVALID_EVIDENCE = "extraction_error", "invalid_evidence"
_MOVE = "step int, from_status string, to_status string, reason string, code string, detail string"


def extraction_job(revisions: DataFrame, spans: DataFrame, index: DataFrame, most_chars: int = 12_000, longest: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, rows of `link_rows`, moves) of an extraction.

    revisions: (doc_id, status, text, input_text, error): the stored text, the text that the extractor was given, and what
    it failed with, if it did. spans: (doc_id, label, start_char, end_char, quote, confidence), what it found.

    Only parsed revisions are taken up. A span that doesn't quote the extractor's text is discarded, and the profile goes on
    without it; one that does but doesn't quote the stored text fails the revision, and no profile is written. Without
    spans a profile is structural, with a warning. Linked are the spans kept, or the whole text without any. A text beyond
    `most_chars` is cut for the extractor, and the outcome says so.

    outcomes: (doc_id, extracted, skipped_reason, origin, kept, discarded, linked, warnings); moves: (doc_id, step,
    from_status, to_status, reason, code, detail), none for revisions that weren't parsed.
    """
    r = revisions.select("doc_id", "status", "text", F.coalesce("input_text", "text").alias("input_text"), "error")
    ready = r.where("status = 'parsed'")
    working = ready.where("error is null")
    judged = verified_spans(working.select("doc_id", F.col("input_text").alias("text")), spans.join(working.select("doc_id"), "doc_id", "left_semi"), most_chars)
    kept = judged.where("outcome = 'kept'")
    again = verified_spans(working.select("doc_id", "text"), kept.drop("outcome", "truncated"), most_chars=2**31 - 1)
    wrong = again.where("outcome <> 'kept'").groupBy("doc_id").agg(F.count("*").alias("wrong"))
    found = competencies(judged).select("doc_id", F.size("kept").alias("kept"), F.size("rejected").alias("discarded"))

    good = working.join(wrong, "doc_id", "left_anti")
    given = kept.join(good.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("quote").alias("raw_text"), "start_char", "end_char", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    links = link_rows(good.select("doc_id", "text"), given, index, longest)
    linked = status_counts(links).select("doc_id", "linked")

    both = r.join(found, "doc_id", "left").join(wrong, "doc_id", "left").join(linked, "doc_id", "left")
    parsed = F.coalesce(F.col("status") == "parsed", F.lit(False))
    code = F.when(F.col("error").isNotNull(), EXTRACTION_ERROR).when(F.col("wrong") > 0, INVALID_EVIDENCE)
    bad = F.concat(F.col("wrong").cast("string"), F.lit(" evidence span(s) do not quote the stored text"))
    detail = F.coalesce(F.substring("error", 1, 500), bad)
    skipped = F.when(~parsed, F.concat(F.lit("revision is "), F.coalesce("status", F.lit("without a status")), F.lit(", not parsed"))).otherwise(detail)
    extracted = parsed & code.isNull()
    cut = F.length("input_text") > most_chars
    warnings = F.array_compact(F.array(F.when(F.coalesce("kept", F.lit(0)) == 0, "no spans were kept: structural facts only"), F.when(cut, "the text was cut before extraction")))
    outcomes = both.select(
        "doc_id", extracted.alias("extracted"), skipped.alias("skipped_reason"), F.when(extracted, F.when(F.coalesce("kept", F.lit(0)) > 0, "neural_extraction").otherwise("structural_extraction")).alias("origin"),
        F.when(extracted, F.coalesce("kept", F.lit(0))).alias("kept"), F.when(extracted, F.coalesce("discarded", F.lit(0))).alias("discarded"),
        F.when(extracted, F.coalesce("linked", F.lit(0))).alias("linked"), F.when(extracted, warnings).alias("warnings"),
    )
    none = F.lit(None).cast("string")
    end = F.when(code.isNull(), "extracted").otherwise("failed")
    steps = F.array(
        F.struct(F.lit(1), F.lit("parsed"), F.lit("extracting"), F.lit("extraction started"), none, none),
        F.struct(F.lit(2), F.lit("extracting"), end, F.coalesce(code, F.lit("extraction succeeded")), code, detail),
    ).cast(f"array<struct<{', '.join(': '.join(c.split()) for c in _MOVE.split(', '))}>>")
    moves = both.where(parsed).select("doc_id", F.explode(steps).alias("m")).select("doc_id", "m.*")
    return outcomes, links, moves


def reextraction_queue(profiles: DataFrame, revisions: DataFrame, extractor: str, limit: int) -> DataFrame:
    """Moves that put extracted revisions back to parsed whose newest profile another extractor made, the oldest `limit`.

    profiles: (doc_id, extractor_model_id, created_at); a null model is another one. revisions: (doc_id, status). Those that
    aren't extracted now are left to their own way.
    """
    newest = latest_per_key(profiles, ["doc_id"], F.desc("created_at"), F.asc_nulls_first("extractor_model_id"))
    stale = newest.where(~F.col("extractor_model_id").eqNullSafe(F.lit(extractor))).join(revisions.where("status = 'extracted'").select("doc_id"), "doc_id", "left_semi")
    first = stale.orderBy("created_at", "doc_id").limit(limit)
    reason = F.concat(F.lit("extractor was "), F.coalesce("extractor_model_id", F.lit("unknown")))
    return first.select("doc_id", F.lit("extracted").alias("from_status"), F.lit("parsed").alias("to_status"), reason.alias("reason"))
