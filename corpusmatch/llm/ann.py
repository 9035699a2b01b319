"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids, so k centroids a half make k * k cells. A query
visits cells by the sum of its halves' distances to their centroids, taken from a heap, until they hold a given
share of all entries; those entries are ranked by their true distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import materialize, sample_cut


@dataclass(frozen=True)
class Params:
    k: int = 10
    centroids: int = 64
    #: Vectors to fit the centroids on, those with the smallest hashes of their ids; every vector is indexed.
    sample: int = 20_000
    #: Cells are visited until they hold this share of the entries. Vectors without clusters need much for a recall
    #: of 0.9; those with clusters far less.
    share: float = 0.5
    rounds: int = 12
    block: int = 4096
    queries_a_block: int = 2048
    seed: int = 5


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, has no null or non-finite component and isn't zero, of the commonest dimension."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(ok, F.lit(False)))
    sizes = kept.groupBy(F.size("embedding").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").limit(1).select("d")
    return kept.join(F.broadcast(most), F.size("embedding") == F.col("d")).drop("d")


def _centroids(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Cells by the sum of the halves' distances until they hold `enough` entries, as a boolean matrix."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out = np.zeros(counts.shape, bool)
    heap, pushed, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        out[a[i], b[j]] = True
        held += counts[a[i], b[j]]
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in pushed:
                pushed.add(n)
                heapq.heappush(heap, (first[a[n[0]]] + second[b[n[1]]], *n))
    return out


def search(vectors: DataFrame, is_query: Column, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query among all other rows, by Euclidean distance.

    vectors: (vec_id, embedding, ...). Unusable vectors (see `usable`) take no part, neither as queries nor as
    candidates. Of rows with the very same vector the k + 1 with the smallest ids are indexed; with ties going to
    smaller ids the rest can't be among any k nearest. Repeated ids count as rows of their own, but none is a
    candidate of its own id. Fewer candidates than k: all of them. An empty table gives no rows.
    Queries meet the index block by block: a task holds `block` vectors and `queries_a_block` queries.
    """
    k, spark = params.k, vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    few = sample_cut(rows, F.col("vec_id"), params.sample).select("embedding").toPandas()
    if few.empty:
        return spark.createDataFrame([], schema)
    sample = np.stack(few["embedding"].map(np.asarray))
    half = sample.shape[1] // 2
    halves = (slice(0, half), slice(half, None))
    books = [_centroids(sample[:, h], params.centroids, params.rounds, params.seed) if half or h.stop is None else sample[:1, h] for h in halves]

    def distances(x: np.ndarray) -> list[np.ndarray]:
        return [((x[:, None, h] - c) ** 2).sum(2) if len(x) < 64 else ((x[:, h] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * x[:, h] @ c.T) for h, c in zip(halves, books, strict=True)]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column("embedding"))
                i, j = (d.argmin(1).astype(np.int32) for d in distances(x))
                raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(i), pa.array(j), raw], ["vec_id", "i", "j", "vec"])

    # Of equal vectors only those with the k + 1 smallest ids can be among a query's k nearest.
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth")
    index = materialize(indexed.mapInArrow(assign, "vec_id long, i int, j int, vec binary"), "index")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # a number per cell
        counts[r.i, r.j] = r["count"]
    enough = max(k + 1, int(np.ceil(params.share * counts.sum())))
    blocks = np.maximum(1, -(-counts.sum(1) // params.block))
    asked = rows.where(is_query).distinct()
    groups = max(1, -(-asked.count() // params.queries_a_block))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = matrix(part.column("embedding"))
                out = []
                for q, v, first, second in zip(part.column("vec_id").to_pylist(), x, *distances(x), strict=True):
                    seen = visit(first, second, counts, enough)
                    for i in np.flatnonzero(seen.any(1)):
                        cells = np.packbits(seen[i]).tobytes()
                        out += [(int(i), b, q % groups, q, v.tobytes(), cells) for b in range(blocks[i])]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["i", "block", "part", "query_id", "vec", "cells"])

    routed = asked.mapInArrow(route, "i int, block int, part long, query_id long, vec binary, cells binary")
    several = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("i") + 1)
    placed = index.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), several).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def nearest(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            x = np.stack([np.frombuffer(v) for v in entries["vec"]])
            ids, cell, squares = entries["vec_id"].to_numpy(), entries["j"].to_numpy(), (x**2).sum(1)
            for q, raw, cells in zip(queries["query_id"], queries["vec"], queries["cells"], strict=True):
                v = np.frombuffer(raw)
                own = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[cell].astype(bool) & (ids != q))
                if len(own) > k:  # rounding can't move an entry by the margin
                    rough = squares[own] - 2 * (x[own] @ v)
                    limit = np.partition(rough, k - 1)[k - 1]
                    own = own[rough <= limit + 1e-9 * (1 + abs(limit) + v @ v)]
                exact = np.sqrt(((x[own] - v) ** 2).sum(1))
                best = np.lexsort((ids[own], exact))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[own][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ("i", "block", "part")
    found = placed.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
