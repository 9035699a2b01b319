"""Structured profiles: requirements derived from known facts, each with the place in the text that says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmatch.functions.render import plain_number
from corpusmatch.functions.text import find_span, once

_VALUE = "map<string,string>"


def _requirement(kind: str, necessity: str, operator: str | None, value: dict[str, Column], span: Column | None) -> Column:
    pairs = [x for k, v in value.items() for x in (F.lit(k), v.cast("string"))]
    none = F.lit(None).cast("struct<start:int,end:int,quote:string>")
    span = none if span is None else span.cast("struct<start:int,end:int,quote:string>")
    return once(span, lambda found: F.struct(
        F.lit(kind).alias("kind"), F.lit(necessity).alias("necessity"), F.lit(operator).cast("string").alias("operator"),
        F.create_map(*pairs).cast(_VALUE).alias("value"), found.isNotNull().alias("explicit"), found.alias("evidence"),
    ))


def _discarded(kind: str, reason: str, raw: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit("rejected").alias("outcome"), F.lit(reason).alias("reason"), raw.alias("raw_value"))


def job_profile(
    text: Column, years: Column, level: Column, employment: Column, remote: Column, low: Column, high: Column, currency: Column
) -> tuple[Column, Column, Column]:
    """(requirements, discarded, confidence). Absent facts make none; impossible ones are discarded with their reason.

    A requirement is explicit only if the text itself says its value; employment and remote never are. Confidence is
    1 with any requirement, else 0.
    """
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    crossed = F.coalesce(low > high, F.lit(False))
    anchor = F.coalesce(high, low)
    pay = {"min": low, "max": high, "currency": currency}
    requirements = F.array_compact(F.array(
        F.when(years >= 0, _requirement("experience", "required", "at_least", {"years_min": years}, find_span(text, plain_number(years)))),
        F.when(has(level), _requirement("experience", "unspecified", None, {"seniority": level}, find_span(text, level))),
        F.when(has(employment), _requirement("employment_type", "unspecified", None, {"employment_type": employment}, None)),
        F.when(remote.isNotNull(), _requirement("location", "unspecified", None, {"remote": remote}, None)),
        F.when(anchor.isNotNull() & ~crossed, _requirement("compensation", "unspecified", None, pay, find_span(text, plain_number(anchor)))),
    ))
    discarded = F.array_compact(F.array(
        F.when(years < 0, _discarded("experience", "negative years", years.cast("string"))),
        F.when(crossed, _discarded("compensation", "floor over ceiling", F.concat_ws("-", low.cast("string"), high.cast("string")))),
    ))
    return requirements, discarded, F.when(F.size(requirements) > 0, 1.0).otherwise(0.0)


# Category of a competency by the label of its span.
CATEGORIES = {"technology": "technology", "tool": "tool", "professional skill": "professional_skill"}


def verified_spans(docs: DataFrame, spans: DataFrame, most_chars: int = 12_000) -> DataFrame:
    """spans (doc_id, label, start_char, end_char, quote, confidence) with `outcome`: kept, or why not, and `truncated`.

    A span must have whole places, lie within the first `most_chars` characters, and quote the text there; `truncated` says
    that the document goes on after these. A span of an unknown document is out of bounds.
    """
    cut = docs.select("doc_id", F.substring("text", 1, most_chars).alias("text"), (F.length("text") > most_chars).alias("truncated"))
    bare = F.col("start_char").isNull() | F.col("end_char").isNull() | (F.coalesce("quote", F.lit("")) == "")
    bad = (F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char")) | (F.col("end_char") > F.length("text"))
    said = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    outcome = F.when(bare, "bare").when(F.coalesce(bad, F.lit(True)), "out of bounds").when(said != F.col("quote"), "misquoted").otherwise("kept")
    return spans.join(cut, "doc_id", "left").withColumns({"outcome": outcome, "truncated": F.coalesce("truncated", F.lit(False))}).drop("text")


def span_report(verified: DataFrame) -> DataFrame:
    """(doc_id, kept, rejected, truncated, warning) of verified spans; the warning says that the text was cut before its spans were found."""
    counts = verified.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "kept").alias("kept"), F.count_if(F.col("outcome") != "kept").alias("rejected"), F.bool_or("truncated").alias("truncated"))
    return counts.withColumn("warning", F.when(F.col("truncated"), "the text was cut before extraction"))


def competencies(verified: DataFrame) -> DataFrame:
    """(doc_id, kept, rejected, warning): competencies of each document with category and confidence within 0 and 1, in order, and rejected spans with their reasons."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p))[F.col("label")], F.lit("other"))
    sure = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    good = F.struct("start_char", "end_char", "quote", kind.alias("category"), sure.alias("confidence"))
    wrong = F.struct("start_char", "end_char", "quote", F.col("outcome").alias("reason"))
    pick = lambda one, when: F.array_sort(F.collect_list(F.when(when, one)))
    ok = F.col("outcome") == "kept"
    return verified.groupBy("doc_id").agg(pick(good, ok).alias("kept"), pick(wrong, ~ok).alias("rejected"))


def with_fallback(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with its competencies; those that no spans came for are structural, with a warning, and go to review."""
    both = docs.select("doc_id").join(found, "doc_id", "left")
    missing = F.col("kept").isNull()
    return both.withColumns({"origin": F.when(missing, "structural").otherwise("neural"), "warning": F.when(missing, "no spans were found"), "review": missing})


def profile_spans(requirements: Column, competencies_: Column) -> Column:
    """Places of all evidence of a profile, from requirements (evidence) and competencies (start_char, end_char)."""
    own = F.transform(F.filter(requirements, lambda r: r["evidence"].isNotNull()), lambda r: F.struct(r["evidence"]["start"].alias("start"), r["evidence"]["end"].alias("end")))
    more = F.transform(F.filter(competencies_, lambda c: c["start_char"].isNotNull()), lambda c: F.struct(c["start_char"].alias("start"), c["end_char"].alias("end")))
    return F.concat(own, more)


def profile_violations(requirement: Column) -> Column:
    """array<string> of the rules that a requirement breaks: places, evidence if explicit, known kinds."""
    span = requirement["evidence"]
    rules = {
        "span bounds": span.isNotNull() & ((span["start"] < 0) | (span["end"] <= span["start"])),
        "explicit without evidence": requirement["explicit"] & span.isNull(),
        "unknown kind": ~requirement["kind"].isin("experience", "employment_type", "location", "compensation"),
        "unknown necessity": ~requirement["necessity"].isin("required", "preferred", "unspecified"),
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def candidate_profile(language: Column, truncated: Column) -> Column:
    """Profile of a candidate's document that no extractor has read: empty, with its language and a warning."""
    return F.struct(
        language.alias("language"), F.array().cast("array<string>").alias("competencies"), F.lit(0.0).alias("confidence"),
        F.array(F.lit("no extractor for candidates is configured")).alias("warnings"), truncated.alias("truncated"),
    )


def extraction_run(revisions: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, outcome, origin, n_competencies) of an extraction over revisions (doc_id, status).

    Only parsed revisions are extracted; the others say why not. found: (doc_id, kept) of the span source; a document that
    it says nothing of keeps its structural profile.
    """
    both = revisions.join(found.select("doc_id", "kept"), "doc_id", "left")
    parsed = F.coalesce(F.col("status") == "parsed", F.lit(False))
    outcome = F.when(parsed, "extracted").otherwise(F.concat(F.lit("not parsed: "), F.coalesce("status", F.lit("no status"))))
    origin = F.when(parsed, F.when(F.col("kept").isNull(), "structural").otherwise("neural"))
    count = F.when(parsed, F.coalesce(F.size("kept"), F.lit(0))).otherwise(0)
    return both.select("doc_id", outcome.alias("outcome"), origin.alias("origin"), count.cast("long").alias("n_competencies"))


def rewound(stale: DataFrame) -> DataFrame:
    """Transitions that put stale profiles' revisions (doc_id) back to parsed, so that the next run extracts them again."""
    return stale.select("doc_id", F.lit("extracted").alias("from_status"), F.lit("parsed").alias("to_status"), F.lit("stale extractor").alias("reason"))
