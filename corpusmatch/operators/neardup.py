"""Near-duplicate clusters by MinHash: banded signatures, and representatives in place of caps on buckets.

A bucket's members meet its representatives, the members with the smallest ids, and are checked by their exact shingle sets.
Those that aren't linked to one meet the next representatives among themselves, one at first and twice as many every round,
until no bucket has two left: a bucket of n takes log2 n rounds at most, and one of copies a comparison a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.operators.graph import components
from corpusmatch.operators.storage import written


@dataclass(frozen=True)
class MinHashConfig:
    words: int = 5
    #: Least Jaccard similarity of two linked texts.
    similarity: float = 0.8
    #: At a similarity of 0.8 a band of six agrees in 26 of 100 cases, so one of sixteen does in 99.
    bands: int = 16
    rows: int = 6
    seed: int = 11


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `words` words, lower-cased; of a shorter text, of all its words."""
    own = (text or "").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(own[k : k + words]).encode("utf-8", "surrogatepass")) for k in range(n)), np.uint64, n))


def band_hashes(own: np.ndarray, config: MinHashConfig) -> list[int]:
    """A hash for each band of the set's signature; sets of many elements go through in parts."""
    rng = np.random.default_rng(config.seed)
    n = config.bands * config.rows
    by, plus = rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 4096):
            mixed = own[at : at + 4096, None] * by[None] + plus[None]
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0))
    return [xxhash.xxh64_intdigest(part.tobytes(), seed=k) - (1 << 63) for k, part in enumerate(least.reshape(config.bands, config.rows))]


def _sets(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """(doc_id, class, n_shingles, shingles, bands) of texts with words; `class` tells sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                own = [shingles(t, config.words) for t in part.column("text").to_pylist()]
                keep = pa.array([len(s) > 0 for s in own])
                columns = [
                    part.column("doc_id"), pa.array([xxhash.xxh128_hexdigest(s.tobytes()) for s in own]), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()),
                    pa.array([band_hashes(s, config) if len(s) else [] for s in own], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "n_shingles", "shingles", "bands"]).filter(keep)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, class string, n_shingles long, shingles binary, bands array<long>")


def _linked(pairs: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, left, right) with `linked`: whether the sets are similar enough, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                part, out = whole.slice(at, 100), []
                for left, right in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    shared = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large else 0
                    out.append(shared >= similarity * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


def near_duplicate_clusters(docs: DataFrame, config: MinHashConfig = MinHashConfig(), most_rounds: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, itself included.

    Texts with equal sets are linked from the start. A null text, and one without words, has no shingles and is linked with
    nothing; rows with a null doc_id are left out; repeated rows give a row each id; an empty table gives no rows. The
    links checked are exact; those that no band brings together are missed.
    """
    ids = docs.where("doc_id is not null")
    sets = written(_sets(ids, config), "sets")
    first = sets.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("size"), F.min("shingles").alias("shingles"), F.min("bands").alias("bands"))
    classes = written(first, "classes")
    contents, sizes = classes.select("id", "shingles"), classes.select("id", "size")
    waiting = written(classes.select("id", F.posexplode("bands").alias("band", "bucket")), "buckets")
    nth = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("id"))
    # Sets whose sizes are too far apart can't be linked, and their elements aren't fetched.
    near = F.least("left_size", "right_size") >= config.similarity * F.greatest("left_size", "right_size").cast("double")
    links = None
    for k in range(most_rounds):
        heads = waiting.withColumn("nth", nth).where(F.col("nth") <= 2**k).select("band", "bucket", F.col("id").alias("head"))
        met = written(waiting.join(heads, ["band", "bucket"]).where("id > head"), "met")
        pairs = met.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
        if pairs.isEmpty():
            break
        for side, one in (("a", "left"), ("b", "right")):
            pairs = pairs.join(sizes.select(F.col("id").alias(side), F.col("size").alias(f"{one}_size")), side)
        both = pairs.where(near).select("a", "b")
        for side, one in (("a", "left"), ("b", "right")):
            both = both.join(contents.select(F.col("id").alias(side), F.col("shingles").alias(one)), side)
        found = written(_linked(both, config.similarity).where("linked").select("a", "b"), "judged")
        links = found if links is None else links.unionByName(found)
        gone = met.join(found.select(F.col("a").alias("id"), F.col("b").alias("head")), ["id", "head"], "left_semi").select("band", "bucket", "id")
        gone = gone.unionByName(heads.withColumnRenamed("head", "id"))
        waiting = written(waiting.join(gone, ["band", "bucket", "id"], "left_anti"), "buckets")
    else:
        raise RuntimeError("the buckets did not empty")
    own = sets.join(classes.select("class", F.col("id").alias("node")), "class").select("doc_id", "n_shingles", "node")
    if links is not None:
        own = own.join(components(links), "node", "left").withColumn("node", F.coalesce("component", "node"))
    found = own.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("node").alias("component_id"))
    return ids.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
