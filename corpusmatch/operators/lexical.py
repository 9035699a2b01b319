"""Lexical channel: an inverted index with term and length statistics, and exact top-k block by block; fusion of rankings.

A score is a sum over a query's distinct terms of idf times a saturated term frequency, in whole millionths, so it
doesn't depend on the order of adding and ties are real ties.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmatch.operators.storage import written


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.2
    b: float = 0.75
    #: Terms in at most this share of the documents are rare: they are added posting by posting, the others as matrices.
    rare_share: float = 0.05


def terms(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]++"), "")


@dataclass(frozen=True)
class LexicalIndex:
    """postings: (term, doc_id, tf, length); stats: (term, df); n documents with `total` terms together."""

    postings: DataFrame
    stats: DataFrame
    n: int
    total: int


def lexical_index(docs: DataFrame, key: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> LexicalIndex:
    """Index of docs by term, written once. Documents without terms count for n; rows of one key are one document each.

    asked: texts, if these are all that is ever asked. Then only their terms are indexed; lengths still count every term.
    """
    words = docs.select(F.col(key).alias("doc_id"), terms(F.col(text)).alias("w"))
    words = written(words.withColumn("length", F.size("w")), "words")
    n, total = words.agg(F.count("*"), F.sum("length")).first()
    each = words.select("doc_id", "length", F.explode("w").alias("term"))
    if asked is not None:
        # Written first, so that its size is known and texts needn't be shuffled to meet it.
        each = each.join(written(asked.select(F.explode(terms(F.col("text"))).alias("term")).distinct(), "asked"), "term", "left_semi")
    postings = written(each.groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf")), "postings")
    stats = written(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    return LexicalIndex(postings, stats, n, total or 0)


def _idf(index: LexicalIndex) -> Column:
    """In thousandths; over 0 for every term."""
    df = F.col("df").cast("double")
    return F.floor(F.log(1.0 + (float(index.n) - df + 0.5) / (df + 0.5)) * 1000.0 + 0.5).cast("long")


def _part(index: LexicalIndex, config: LexicalConfig) -> Column:
    """What a term adds to a document's score, in millionths; under idf * (k1 + 1) * 1000 always."""
    usual = float(index.total) / max(1, index.n)
    tf, length = F.col("tf").cast("double"), F.col("length").cast("double")
    share = tf * (config.k1 + 1.0) / (tf + config.k1 * (1.0 - config.b + config.b * length / usual))
    return F.floor(F.col("idf").cast("double") * share * 1000.0).cast("long")


def lexical_topk(queries: DataFrame, index: LexicalIndex, k: int, config: LexicalConfig = LexicalConfig(), docs_a_block: int = 4096, queries_a_block: int = 512) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each (query_id, text); ties go to the smaller doc_id, a null one comes last.

    Postings of the terms that are asked are dealt out by document, with what each adds to a score, and meet the queries' terms
    there, block by block. A document's score is whole inside its block, so only the k best of each query leave a block.

    A query without known terms gives no rows, and so does a document that has none of them.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    known = written(asked.select("term").distinct().join(index.stats, "term").withColumn("number", F.monotonically_increasing_id()), "known-terms")
    own = written(asked.join(known.select("term", "number"), "term").select("query_id", "number"), "query-terms")
    blocks, parts = max(1, -(-index.n // docs_a_block)), max(1, -(-own.select("query_id").distinct().count() // queries_a_block))
    common = (F.col("df") > max(1.0, config.rare_share * index.n)).alias("common")
    scores = index.postings.join(known.select("term", "number", common, _idf(index).alias("idf")), "term")
    scores = scores.select("doc_id", "number", "common", _part(index, config).alias("adds"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
    scores = scores.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = own.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = T.StructType([queries.schema["query_id"], index.postings.schema["doc_id"], T.StructField("score", T.LongType())])
    found = scores.groupBy("block", "part").cogroup(own.groupBy("block", "part")).applyInArrow(lambda left, right: _block_best(left, right, k), schema)
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of each value, null among them, and the values by number, in order; null is last."""
    values = column.unique()
    values = values.take(pc.sort_indices(values, null_placement="at_end"))
    return pc.index_in(column, value_set=values).to_numpy(), values


def _block_best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(query_id, doc_id, score): the k best of each query among the documents of left (doc_id, number, common, adds); right: (query_id, number)."""
    (doc, docs), (query, queries) = _coded(left.column("doc_id")), _coded(right.column("query_id"))
    numbers, asks = np.unique(right.column("number").to_numpy(), return_inverse=True)
    at = np.searchsorted(numbers, left.column("number").to_numpy())
    at[at == len(numbers)] = 0
    own = np.flatnonzero(numbers[at] == left.column("number").to_numpy()) if len(numbers) else np.zeros(0, np.int64)
    doc, term, common, adds = doc[own].astype(np.int64), at[own], left.column("common").to_numpy()[own], left.column("adds").to_numpy()[own]
    by = np.argsort(asks, kind="stable")
    askers, first = query[by].astype(np.int64), np.searchsorted(asks[by], np.arange(len(numbers) + 1))

    def added(values: np.ndarray) -> np.ndarray:
        """Sums by document and query; whole numbers below 2^53, so exact in any order."""
        out = np.zeros((len(docs), len(queries)))
        # Common terms as products of matrices, 512 terms at once.
        often = np.unique(term[common])
        for some in (often[i : i + 512] for i in range(0, len(often), 512)):
            rows = np.flatnonzero(common & (term >= some[0]) & (term <= some[-1]))
            cells = doc[rows] * len(some) + np.searchsorted(some, term[rows])
            has = np.bincount(cells, values[rows], len(docs) * len(some)).reshape(len(docs), len(some))
            wants = np.zeros((len(some), len(queries)))
            for t, number in enumerate(some.tolist()):
                wants[t, askers[first[number] : first[number + 1]]] = 1
            out += has @ wants
        # The others posting by posting, some two million pairs of a posting and a query at once.
        rare = np.flatnonzero(~common)
        times = first[term[rare] + 1] - first[term[rare]]
        bounds = np.unique(np.r_[np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), 1 << 21)), len(rare)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows, n = rare[a:b], times[a:b]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cells = np.repeat(doc[rows], n) * len(queries) + askers[np.repeat(first[term[rows]], n) + within]
            out += np.bincount(cells, np.repeat(values[rows], n), out.size).reshape(out.shape)
        return out

    scores = added(adds)
    # A term in nearly all documents may add 0; what has it is found all the same.
    seen = scores > 0 if (adds > 0).all() else added(np.ones(len(adds))) > 0
    which, best = [], []
    for q in range(len(queries)):
        rows = np.flatnonzero(seen[:, q])
        if len(rows) > k:
            rows = rows[scores[rows, q] >= np.partition(scores[rows, q], len(rows) - k)[len(rows) - k]]
        best.append(rows[np.lexsort((rows, -scores[rows, q]))[:k]])
        which.append(np.full(len(best[-1]), q))
    which, best = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (which, best))
    columns = [queries.take(pa.array(which)), docs.take(pa.array(best)), pa.array(scores[best, which].astype(np.int64))]
    return pa.table(columns, ["query_id", "doc_id", "score"])


def fused(channels: dict[str, tuple[DataFrame, float]], k: int = 60, limit: int | None = None) -> DataFrame:
    """(user_id, item_id, a rank for each channel, score, rank): sum of weight / (k + rank) over the channels that have the item.

    channels: name -> ((user_id, item_id, rank), weight). A channel without the item adds nothing and its rank is null;
    of repeated rows the best rank counts; ties go to the smaller item. Ranks start from 1.
    """
    both = None
    for name, (df, _) in channels.items():
        one = df.select("user_id", "item_id", F.lit(name).alias("channel"), F.col("rank").cast("int").alias("place"))
        both = one if both is None else both.unionByName(one)
    ranks = both.groupBy("user_id", "item_id").agg(*(F.min(F.when(F.col("channel") == name, F.col("place"))).alias(f"{name}_rank") for name in channels))
    score = F.lit(0.0)
    for name, (_, weight) in channels.items():
        score = score + F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(f"{name}_rank")), F.lit(0.0))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    out = ranks.withColumn("score", score).withColumn("rank", nth)
    return out if limit is None else out.where(F.col("rank") <= limit)
