"""Near-identical postings of one company: pair similarity, leader clustering in order of arrival, links by source."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.functions.text import normalize_company, normalize_title

# Fixed values.
LEAST_TITLE, LEAST_DESCRIPTION = 0.86, 0.5


def similarity(left: str, right: str, least: float = 0.0) -> float:
    """Share of matching characters, 0 if either is empty. Cheap upper bounds are tried first: under `least` it is 0."""
    if not left or not right:
        return 0.0
    pair = SequenceMatcher(None, left, right)
    if least and (pair.real_quick_ratio() < least or pair.quick_ratio() < least):
        return 0.0
    found = pair.ratio()
    return found if found >= least else 0.0


#: Titles and short descriptions come again and again, also among companies: 16 384 pairs of at most 400 characters are kept.
_similarity = lru_cache(1 << 14)(similarity)


def _again(left: str, right: str, least: float) -> float:
    return (_similarity if len(left) + len(right) <= 400 else similarity)(left, right, least)


def pair_score(title: str, description: str, other_title: str, other_description: str) -> float:
    """Mean of both similarities, 0 if either is under its limit. Titles are normalized already."""
    first = _again(title, other_title, LEAST_TITLE)
    second = _again(description, other_description, LEAST_DESCRIPTION) if first else 0.0
    return (first + second) / 2 if second else 0.0


def leader_clusters(postings: DataFrame, key: str, order: str) -> DataFrame:
    """(key, cluster): each posting joins the best cluster of its company, or founds one named by its own key.

    postings: (key, order, company, title, description). Postings of a normalized company come in order (and by key) to
    one task and are compared with the first postings of its clusters only, the cluster seen last first, so of equal scores
    that one wins; a posting that joins a cluster makes it the one seen last. The task streams: it keeps these first postings, not the rest. Null texts count as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    named = postings.select(
        text(normalize_company(F.col("company"))).alias("company"), F.col(order).alias("seen"), F.col(key).alias("id"),
        text(normalize_title(F.col("title"))).alias("title"), text(F.col("description")).alias("description"),
    )
    kind = postings.schema[key].dataType.simpleString()

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, []
        for part in parts:
            out = []
            for company, id_, title, description in zip(part["company"], part["id"], part["title"], part["description"], strict=True):
                if company != now:
                    now, leaders = company, []
                best, home = 0.0, None
                for at in range(len(leaders) - 1, -1, -1):
                    score = pair_score(title, description, *leaders[at][1:])
                    if score > best:
                        best, home = score, at
                    if best == 1.0:  # nothing is better, and of equals the one seen last counts
                        break
                leaders.append((id_, title, description) if home is None else leaders.pop(home))
                out.append(leaders[-1][0])
            yield pd.DataFrame({"id": part["id"], "cluster": out})

    # Comparisons are dear and rows narrow: a number of parts of its own keeps Spark from putting them together again.
    n = 4 * postings.sparkSession.sparkContext.defaultParallelism
    dealt = named.repartition(n, "company").sortWithinPartitions("company", "seen", "id").mapInPandas(deal, f"id {kind}, cluster {kind}")
    return dealt.select(F.col("id").alias(key), "cluster")


def source_links(members: DataFrame) -> DataFrame:
    """(cluster, links): one (source, url) per source, that of the newest row, in order of sources; from (cluster, source, url, normalized_at)."""
    newest = members.groupBy("cluster", "source").agg(F.max_by("url", F.struct("normalized_at", "url")).alias("url"))
    return newest.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("source", "url"))).alias("links"))
