"""The whole matching pass: retrieval, hard filters, relevance that is kept or made, blend and bands, in one function.

`streaming.matching` runs the same functions on what changed since the last trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.operators.matching import MatchConfig, cosine_topk, filter_reasons, match_pass, reuse_relevance, token_overlap

#: What is asked of a user and known of a posting.
USER = "user_id long, vector array<double>, query string, model string, blacklist array<string>, blocked array<string>, max_years double, desired_salary double, formats array<string>, locations array<string>"
POSTING = "item_id long, vector array<double>, document string, company string, years double, salary_max double, currency string, remote boolean, places array<string>"
COLUMNS = ("user_id", "item_id", "similarity", "eligible", "reasons", "model", "query_hash", "doc_hash", "relevance", "score", "rerank_position", "recommendation")


def retrieved(users: DataFrame, postings: DataFrame, config: MatchConfig) -> DataFrame:
    """(user_id, item_id, similarity): the `retrieval_limit` nearest postings of each user."""
    found = cosine_topk(users.select("user_id", "vector"), postings.select("item_id", "vector"), config.retrieval_limit)
    return found.select("user_id", "item_id", "similarity")


def decided(found: DataFrame, users: DataFrame, postings: DataFrame, stored: DataFrame, config: MatchConfig, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """COLUMNS of retrieved pairs. stored: (user_id, item_id, model, query_hash, doc_hash, relevance) of earlier passes.

    A stored relevance holds while model and both texts are the same; the scorer is asked for the other eligible
    pairs. A pair that a filter takes out has no relevance, scores 0 and stays as a row.
    """
    u = users.select("user_id", "query", "model", "blacklist", "blocked", "max_years", "desired_salary", "formats", "locations", F.sha2("query", 256).alias("query_hash"))
    p = postings.drop("vector").withColumn("doc_hash", F.sha2("document", 256))
    both = found.join(u, "user_id").join(p, "item_id")
    job = {"company": F.col("company"), "text": F.col("document"), "years": F.col("years"), "salary_max": F.col("salary_max"), "currency": F.col("currency"), "remote": F.col("remote"), "places": F.col("places")}
    wish = {"blacklist": F.col("blacklist"), "blocked": F.col("blocked"), "max_years": F.col("max_years"), "salary": F.col("desired_salary"), "formats": F.col("formats"), "locations": F.col("locations")}
    both = reuse_relevance(both.withColumn("reasons", filter_reasons(job, wish)), stored)
    made = F.when(F.size("reasons") == 0, F.coalesce("relevance", scorer(F.col("query"), F.col("document"))))
    return match_pass(both.withColumn("relevance", made), config).select(*COLUMNS)


def whole_pass(users: DataFrame, postings: DataFrame, stored: DataFrame, config: MatchConfig, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """COLUMNS of every user's pass over all postings; users (USER) and postings (POSTING) come once each."""
    return decided(retrieved(users, postings, config), users, postings, stored, config, scorer)


def with_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """matches with the last `decision` of (user_id, item_id, decision, at), pending without one; a pass never resets it."""
    last = decisions.groupBy("user_id", "item_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    return matches.join(last, ["user_id", "item_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each user's (user_id, item_id, similarity), each item once."""
    once = found.groupBy("user_id", "item_id").agg(F.max("similarity").alias("similarity"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), "item_id"))
    return once.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
