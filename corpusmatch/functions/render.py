"""Documents rendered for models and people: labelled lines, absent fields leave none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmatch.functions.text import collapse, fold_distinct, html_escape, once, redact

JOB_CHARS, CV_CHARS = 4000, 8000


def line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.trim(value)))


def joined(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")), separator)


def plain_number(x: Column) -> Column:
    """Whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def job_document(
    title: Column, company: Column, level: Column, years: Column, remote: Column, places: Column,
    low: Column, high: Column, currency: Column, description: Column,
) -> Column:
    """0 years and a salary of 0 count as absent."""
    bounds = F.concat_ws("-", F.when(low != 0, low.cast("long").cast("string")), F.when(high != 0, high.cast("long").cast("string")))
    pay = F.when(bounds != "", F.concat_ws(" ", bounds, F.nullif(currency, F.lit(""))))
    return F.concat_ws(
        "\n",
        line("TITLE", title),
        line("COMPANY", company),
        line("SENIORITY", level),
        line("EXPERIENCE REQUIRED", F.when(years != 0, F.concat(plain_number(years), F.lit("+ years")))),
        line("WORK FORMAT", F.when(F.coalesce(remote, F.lit(False)), "remote").otherwise("on-site or hybrid")),
        line("LOCATION", joined(places)),
        line("COMPENSATION", pay),
        line("DESCRIPTION", F.substring(collapse(description), 1, JOB_CHARS)),
    )


def profile_document(cv: Column, roles: Column, stack: Column, formats: Column) -> Column:
    return F.concat_ws(
        "\n",
        line("LOOKING FOR", joined(roles)),
        line("PREFERRED STACK", joined(stack)),
        line("WORK FORMAT", joined(formats)),
        line("CV", F.substring(collapse(cv), 1, CV_CHARS)),
    )


def amount_range(low: Column, high: Column, currency: Column) -> Column:
    """`low–high currency`, or the one that is there; null without both."""
    both = F.concat_ws("–", plain_number(low), plain_number(high))
    return F.when(both != "", F.concat_ws(" ", both, F.nullif(currency, F.lit(""))))


def source_label(source: Column, labels: dict[str, str]) -> Column:
    """A source's own label, or else its name with a capital."""
    own = F.coalesce(*(F.when(source == k, F.lit(v)) for k, v in labels.items()), F.lit(None).cast("string"))
    return F.coalesce(own, F.concat(F.upper(F.substring(source, 1, 1)), F.lower(F.substring(source, 2, 1000))))


def card(match: dict[str, Column], job: dict[str, Column], links: Column, totals: dict[str, Column], labels: dict[str, str] | None = None) -> Column:
    """Text of a notification: score and band, title and company, facts, signals, links, totals; blank lines between.

    match: score, recommendation, similarity, relevance; a null relevance is said to be missing, not shown as 0.
    job: title, company, low, high, currency, remote, level; facts that are null, empty or false are left out, and their
    line without any. links: array<struct<source, url>>. totals: pending, approved, rejected. Shares are rounded half
    to even.
    """
    whole = lambda x: F.rint(x).cast("long").cast("string")
    percent = lambda x: F.concat(whole(x * 100), F.lit("%"))
    facts = F.concat_ws(
        " · ",
        F.concat(F.lit("💰 "), amount_range(job["low"], job["high"], job["currency"])),
        F.when(job["remote"], F.lit("📍 Remote")),
        F.concat(F.lit("🎓 "), html_escape(F.nullif(job["level"], F.lit("")))),
    )
    signals = F.concat(
        F.lit("🧮 similarity "), percent(match["similarity"]), F.lit(" · "),
        F.coalesce(F.concat(F.lit("rerank "), percent(match["relevance"])), F.lit("not reranked")),
    )
    link = lambda s: F.concat(F.lit('<a href="'), html_escape(s["url"]), F.lit('">'), html_escape(source_label(s["source"], labels or {})), F.lit("</a>"))
    stats = F.concat_ws(" · ", *(F.concat(F.coalesce(v, F.lit(0)).cast("string"), F.lit(f" {k}")) for k, v in totals.items()))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), whole(match["score"]), F.lit("% MATCH</b> · "), F.upper(match["recommendation"])),
        F.lit(""),
        F.concat(F.lit("<b>"), html_escape(job["title"]), F.lit("</b> — "), html_escape(job["company"])),
        F.nullif(facts, F.lit("")),
        F.lit(""),
        signals,
        F.lit(""),
        F.concat(F.lit("🔗 "), F.array_join(F.transform(links, link), " · ")),
        F.lit(""),
        F.concat(F.lit("📊 "), stats),
    )


def rerank_query(instruction: str, document: Column) -> Column:
    """A fixed instruction, a blank line, the candidate's document."""
    return F.concat(F.lit(instruction + "\n\n"), document)


def competency_lists(items: Column) -> dict[str, Column]:
    """required, preferred and other competencies of array<struct<necessity, name>>, each name once without regard to case."""
    names = lambda keep: fold_distinct(F.transform(F.filter(items, keep), lambda c: c["name"]))
    return {
        "required": names(lambda c: c["necessity"] == "required"),
        "preferred": names(lambda c: c["necessity"] == "preferred"),
        "other": names(lambda c: ~F.coalesce(c["necessity"], F.lit("")).isin("required", "preferred")),
    }


FIELD_CHARS, FULL_CHARS = 1200, 4000  # fixed values


def section(label: str, value: Column) -> Column:
    """`[LABEL]` over the value; null without one."""
    return once(F.trim(value), lambda v: F.when(v != "", F.concat(F.lit(f"[{label}]\n"), v)))


def sections(*parts: Column, limit: int = FIELD_CHARS, last: tuple[str, Column] | None = None) -> Column:
    """The sections that are there, a blank line between two, cut at the limit; empty without any.

    `last`: label and long text of one more section at the end; the text has been collapsed already and isn't again.
    """
    own = lambda *more: collapse(F.concat_ws("\n\n", *parts, *more))
    if last is None:
        return F.substring(own(), 1, limit)
    label, text = last
    whole = F.concat(own(F.lit(f"[{label}]")), F.lit("\n"), F.substring(text, 1, limit))
    # What `$` also stands before may have a blank in front, which collapsing takes away.
    again = F.right(text, F.lit(1)).isin("\u0085", "\u2028", "\u2029")
    return F.substring(F.when(again, own(section(label, text))).when(text != "", whole).otherwise(own()), 1, limit)


def competency_sections(items: Column, canonical: Column) -> list[Column]:
    """Sections of array<struct<necessity, name>> by necessity, and of the taxonomy's names for them."""
    lists = competency_lists(items)
    return [
        section("REQUIRED COMPETENCIES", lists["required"]), section("PREFERRED COMPETENCIES", lists["preferred"]),
        section("COMPETENCIES", lists["other"]), section("CANONICAL COMPETENCIES", fold_distinct(canonical)),
    ]


def _fields(made: dict[str, Column]) -> Column:
    """array<struct<field, body>> of the fields that say something."""
    each = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("body")) for k, v in made.items()))
    return F.filter(each, lambda f: f["body"] != "")


def job_representations(
    title: Column, level: Column, occupations: Column, competencies: Column, canonical: Column, years: Column, responsibilities: Column,
    remote: Column, low: Column, high: Column, currency: Column, description: Column,
) -> Column:
    """The five fields of a posting; those with nothing to say are absent. 0 years and a salary of 0 count as absent.

    competencies: array<struct<necessity, name>>. Contact details are taken out of the description.
    """
    bounds = F.concat_ws("-", F.when(low != 0, low.cast("long").cast("string")), F.when(high != 0, high.cast("long").cast("string")))
    pay = F.when(bounds != "", F.concat_ws(" ", bounds, F.nullif(currency, F.lit(""))))
    experience = section("EXPERIENCE", F.when(years != 0, F.concat(plain_number(years), F.lit("+ years required"))))
    role, seniority = section("ROLE", title), section("SENIORITY", level)
    place = section("WORK FORMAT", F.when(F.coalesce(remote, F.lit(False)), "remote").otherwise("on-site or hybrid"))
    return once(redact(collapse(description)), lambda text: _fields({
        "occupation": sections(role, seniority, section("OCCUPATIONS", fold_distinct(occupations))),
        "competencies": sections(*competency_sections(competencies, canonical)),
        "experience": sections(experience),
        "responsibilities": sections(section("RESPONSIBILITIES", F.array_join(responsibilities, "\n"))),
        "full_profile": sections(role, seniority, experience, place, section("COMPENSATION", pay), limit=FULL_CHARS, last=("DESCRIPTION", text)),
    }))


def candidate_representations(roles: Column, stack: Column, formats: Column, competencies: Column, canonical: Column, cv: Column) -> Column:
    """The four fields of a candidate. The CV itself, without contact details, is the experience."""
    looking, preferred, place = section("LOOKING FOR", fold_distinct(roles)), section("PREFERRED STACK", fold_distinct(stack)), section("WORK FORMAT", fold_distinct(formats))
    return once(redact(collapse(cv)), lambda text: _fields({
        "occupation": sections(looking, place), "competencies": sections(preferred, *competency_sections(competencies, canonical)),
        "experience": sections(limit=FULL_CHARS, last=("CV", text)), "full_profile": sections(looking, preferred, place, limit=FULL_CHARS, last=("CV", text)),
    }))


def snapshot(facts: dict[str, Column]) -> Column:
    """map of the facts that are there, as text, to be kept with a revision."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
