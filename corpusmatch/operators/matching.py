"""Matching: exact cosine search, hard filters with reasons, blended scores and bands."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.functions.text import round_score


@dataclass(frozen=True)
class MatchConfig:
    """Names, defaults and bounds of the settings."""

    retrieval_limit: int = 400
    rerank_top_k: int = 0  # 0: all
    rerank_weight: float = 0.7
    apply_threshold: float = 70.0
    consider_threshold: float = 45.0
    job_retention_days: int = 18

    def __post_init__(self) -> None:
        bounds = {"retrieval_limit": (1, 100_000), "rerank_top_k": (0, 100_000), "rerank_weight": (0, 1), "apply_threshold": (0, 100), "consider_threshold": (0, 100), "job_retention_days": (1, 365)}
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie within {low} and {high}")
        if self.consider_threshold > self.apply_threshold:
            raise ValueError("consider_threshold is over apply_threshold")


def config_of(settings: dict[str, object], base: MatchConfig = MatchConfig()) -> MatchConfig:
    """base with settings, which may be texts; an unknown name, a blank text, and what is no number or out of bounds are refused."""
    made = {}
    for name, value in settings.items():
        kind = {f.name: type(f.default) for f in fields(MatchConfig)}.get(name)
        if kind is None:
            raise ValueError(f"unknown setting {name!r}")
        if isinstance(value, bool) or value is None or isinstance(value, str) and not value.strip():
            raise ValueError(f"{name} must be a number")
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"{name} must be a number") from None
        if kind is int and number != int(number):
            raise ValueError(f"{name} must be a whole number")
        made[name] = kind(number)
    return replace(base, **made)


def refused_vectors(vectors: DataFrame, model: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose size is that of most of their model's vectors, rows refused with `reason`); of equal numbers the smaller size counts."""
    sizes = vectors.groupBy(model, F.size(vector).alias("size_")).agg(F.count("*").alias("n_"))
    usual = sizes.groupBy(model).agg(F.max_by("size_", F.struct("n_", (-F.col("size_")).alias("less_"))).alias("size_"))
    both = vectors.join(usual, model, "left")
    right = F.coalesce(F.size(vector) == F.col("size_"), F.lit(False))
    said = F.concat(F.lit("has "), F.coalesce(F.size(vector).cast("string"), F.lit("no")), F.lit(" dimensions, the model's have "), F.coalesce(F.col("size_").cast("string"), F.lit("none")))
    return both.where(right).drop("size_"), both.where(~right).withColumn("reason", said).drop("size_")


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, queries_a_block: int = 512, item_blocks: int = 64) -> DataFrame:
    """user_id, item_id, similarity, rank: for (user_id, vector) and (item_id, vector), exact and whole.

    Queries are the stated set that meets all items, block by block: items are dealt into `item_blocks` parts, queries
    into parts of `queries_a_block`, and a task holds one of each. A matrix product a pair of blocks and the k best of
    each query leave it. Vectors of another dimension than the query's don't meet it; a zero vector, and one with a component
    that is null or not finite, takes no part, as the cosine isn't defined; ties go to the smaller item id.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = lambda df: df.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & finite)
    parts = F.lit(max(1, -(-queries.count() // queries_a_block)))
    raw = F.col("vector").cast("array<double>").alias("vector")
    q = ok(queries).select("user_id", raw, F.size("vector").alias("d"), F.pmod(F.xxhash64("user_id"), parts).alias("part"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    i = ok(items).select("item_id", raw, F.size("vector").alias("d"), F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).cast("int").alias("block"))
    i = i.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = (np.stack([np.asarray(v) for v in x["vector"]]) for x in (left, right))
            items_ = right["item_id"].to_numpy()
            scores = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
            for user, row in zip(left["user_id"], scores, strict=True):
                best = np.lexsort((items_, -row))[:k]
                out.append(pd.DataFrame({"user_id": user, "item_id": items_[best], "similarity": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"user_id": [], "item_id": [], "similarity": []})

    keys = ("d", "block", "part")
    kinds = (queries.schema["user_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    found = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(nearest, "user_id {}, item_id {}, similarity double".format(*kinds))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def dimension_report(vectors: DataFrame, model: str, vector: str) -> DataFrame:
    """(model, dimensions, rows): more than one dimension of a model is a clash."""
    return vectors.groupBy(model, F.size(vector).alias("dimensions")).agg(F.count("*").alias("rows"))


def mentions_keyword(text: Column, keyword: Column) -> Column:
    """Word borders around the keyword taken literally; a keyword that ends in a symbol needs a word character after it."""
    escaped = F.regexp_replace(keyword, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.rlike(text, F.concat(F.lit(r"(?iuU)\b"), escaped, F.lit(r"\b")))


def filter_reasons(job: dict[str, Column], wish: dict[str, Column]) -> Column:
    """array<string> of the reasons that apply, with the values that decide, in fixed order; empty means eligible.

    job: company, text, years, salary_max, currency, remote, places. wish: blacklist, blocked, max_years, salary,
    formats, locations. A null on either side of a rule never fires it.
    """
    low = lambda a: F.transform(a, F.lower)
    blocked = F.filter(wish["blocked"], lambda k: mentions_keyword(job["text"], k))
    near = F.exists(low(job["places"]), lambda p: F.exists(low(wish["locations"]), lambda x: F.contains(p, x) | F.contains(x, p)))
    listed = F.array_contains(F.transform(wish["blacklist"], lambda n: F.lower(F.trim(n))), F.lower(F.trim(job["company"])))
    number = lambda c: c.cast("double").cast("string")
    listing = lambda a: F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))
    rules = (
        (listed, F.concat(F.lit('company "'), job["company"], F.lit('" is blacklisted'))),
        (F.size(blocked) > 0, F.concat(F.lit("mentions blocked stack: "), F.array_join(blocked, ", "))),
        (
            job["years"] > wish["max_years"],
            F.concat(F.lit("requires "), number(job["years"]), F.lit("+ years, candidate caps at "), number(wish["max_years"])),
        ),
        (
            (job["currency"] == "USD") & (job["salary_max"] < wish["salary"]),
            F.concat(F.lit("salary tops out at "), number(job["salary_max"]), F.lit(" "), job["currency"], F.lit(", below desired "), wish["salary"].cast("long").cast("string"), F.lit(" USD")),
        ),
        ((wish["formats"] == F.array(F.lit("remote"))) & ~F.coalesce(job["remote"], F.lit(False)), F.lit("candidate wants remote-only; job isn't remote")),
        (
            (F.size(wish["locations"]) > 0) & (F.size(job["places"]) > 0) & ~near,
            F.concat(F.lit("job restricted to "), listing(job["places"]), F.lit(", outside candidate's "), listing(wish["locations"])),
        ),
    )
    return F.array_compact(F.array(*(F.when(c, r) for c, r in rules)))


def blend(similarity: Column, relevance: Column, weight: float) -> Column:
    """0 to 100 with one decimal; without a relevance the similarity alone counts."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    mixed = F.when(relevance.isNull(), unit(similarity)).otherwise(weight * unit(relevance) + (1 - weight) * unit(similarity))
    return round_score(mixed * 100)


def band(score: Column, config: MatchConfig) -> Column:
    return F.when(score >= config.apply_threshold, "apply").when(score >= config.consider_threshold, "consider").otherwise("skip")


def match_pass(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """pairs: user_id, item_id, similarity, reasons, relevance. All rows stay; filtered ones score 0 and skip.

    Only the first `rerank_top_k` eligible by similarity use their relevance (0: all), and get a position by it.
    """
    eligible = F.size("reasons") == 0
    order = Window.partitionBy("user_id", "eligible").orderBy(F.desc("similarity"), "item_id")
    df = pairs.withColumn("eligible", eligible).withColumn("nth", F.row_number().over(order))
    inside = F.col("eligible") & ((F.col("nth") <= config.rerank_top_k) if config.rerank_top_k else F.lit(True))
    df = df.withColumn("used", F.when(inside, F.col("relevance")))
    position = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("used"), "item_id"))
    score = F.when(F.col("eligible"), blend(F.col("similarity"), F.col("used"), config.rerank_weight)).otherwise(0.0)
    df = df.withColumn("score", score).withColumn("rerank_position", F.when(F.col("used").isNotNull(), position))
    return df.withColumn("recommendation", F.when(F.col("eligible"), band(F.col("score"), config)).otherwise("skip"))


def quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """Half-open, may wrap midnight; equal ends mean never."""
    return F.when(start == end, False).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def reuse_relevance(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """pairs with relevance and `reused`: a stored score counts iff user, item, model and both hashes are the same.

    Both have (user_id, item_id, model, query_hash, doc_hash); a null hash on either side means pending.
    """
    keys = ["user_id", "item_id", "model", "query_hash", "doc_hash"]
    known = stored.where("relevance is not null").groupBy(*keys).agg(F.max("relevance").alias("relevance"))
    return pairs.join(known, keys, "left").withColumn("reused", F.col("relevance").isNotNull())


def token_overlap(query: Column, document: Column) -> Column:
    """Default relevance: share of the query's distinct words that the document has; null without any or without a document."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    q = words(query)
    return F.try_divide(F.size(F.array_intersect(q, words(document))).cast("double"), F.nullif(F.size(q), F.lit(0)).cast("double"))


def pass_summary(matches: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each user of (user_id, has_document): retrieved, eligible, filtered_out, reranked, reused, apply, consider, skip, skipped_reason."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = matches.groupBy("user_id").agg(
        F.count("*").alias("retrieved"), F.count_if(flag("eligible")).alias("eligible"), F.count_if(~flag("eligible")).alias("filtered_out"),
        F.count_if(F.col("rerank_position").isNotNull()).alias("reranked"), F.count_if(F.col("rerank_position").isNotNull() & flag("reused")).alias("reused"),
        *(F.count_if(F.col("recommendation") == b).alias(b) for b in ("apply", "consider", "skip")),
    )
    both = users.select("user_id", "has_document").join(counts, "user_id", "left")
    numbers = counts.columns[1:]
    reason = F.when(~F.col("has_document"), "no document").when(F.col("retrieved").isNull(), "nothing retrieved")
    return both.select("user_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), reason.alias("skipped_reason"))


def models_in_use(vectors: DataFrame, model: str, configured: str) -> DataFrame:
    """(document_type, model, rows, comparable): only vectors of the configured model can be compared, others are stale."""
    counts = vectors.groupBy("document_type", F.col(model).alias("model")).agg(F.count("*").alias("rows"))
    return counts.withColumn("comparable", F.col("model") == configured)


def best_label_per_span(entities: DataFrame) -> DataFrame:
    """One row for each exact span of a document, under its most confident label; of equal ones the first given (ord)."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "start_char", "end_char").orderBy(F.desc("confidence"), "ord"))
    return entities.withColumn("nth", nth).where("nth = 1").drop("nth")


def hidden_items(matches: DataFrame) -> DataFrame:
    """(user_id, item_id) that a user doesn't see by default: skipped, not eligible, or rejected."""
    hidden = (F.col("recommendation") == "skip") | ~F.col("eligible") | (F.col("decision") == "rejected")
    return matches.where(F.coalesce(hidden, F.lit(False))).select("user_id", "item_id").distinct()


def should_notify(enabled: Column, eligible: Column, score: Column, least: Column, hour: Column, start: Column, end: Column) -> Column:
    """Unset settings: enabled, from 70, quiet from 22 to 8."""
    d = F.coalesce
    return d(enabled, F.lit(True)) & d(eligible, F.lit(False)) & (score >= d(least, F.lit(70))) & ~quiet_hours(hour, d(start, F.lit(22)), d(end, F.lit(8)))
