"""Toxicity scores: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all hashed into one
table, so an unseen misspelling shares most of its vector with the word it was made from. A text's vector is the
mean over its words. Training runs on a bounded sample of labelled documents; training and scoring read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.llm.common import free_name, least_hashes, materialize

_CACHED_WORDS = 700_000


@dataclass(frozen=True)
class Params:
    #: Labelled documents to learn from, those with the smallest hashes of their ids; half of each class, if it has so many.
    docs: int = 5000
    buckets: int = 1 << 17
    width: int = 8
    #: Buckets found in a smaller share of the sample (and in fewer than two documents) stay zero.
    least_share: float = 0.004
    shortest: int = 3
    longest: int = 5
    #: Words without a vector that each text counts besides its own, so that few words alone decide little.
    padding: int = 10
    #: Passes over the sample; more if it is so small that they make fewer than `least_steps` steps.
    epochs: int = 12
    least_steps: int = 900
    batch: int = 64
    rate: float = 2.0
    #: Class 1 weighs (rows of class 0 / rows of class 1 of all labels) to this power.
    balance: float = 0.3
    threshold: float = 0.7
    seed: int = 7


def subwords(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams and of the word, and the number of the word each belongs to.

    Words are lower-cased, and marks around them fall away, so `Idiot!` is `idiot`.
    """
    bare = [w.lower().strip("\"'`.,;:!?()[]{}<>|#*$%&-_~«»“”„…") for w in words]
    text = "".join(f"<{w}>\0" for w in bare)  # the last word is hashed like the others, so none depends on its neighbours
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in bare], np.int64)
    owner = np.repeat(np.arange(len(bare)), lengths + 1)[: len(points)]
    mult, found, whose = np.uint64(0x9E3779B97F4A7C15), [], []
    with np.errstate(over="ignore"):
        for n in range(params.shortest, params.longest + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : k + size]) * mult
                h ^= h >> np.uint64(32)
            inner = owner[:size] == owner[n - 1 :]
            inner &= points[n - 1 :] != 0
            found.append(h[inner])
            whose.append(owner[:size][inner])
        starts = np.cumsum(lengths + 1) - lengths - 1
        place = np.arange(len(points), dtype=np.uint64) - starts[owner].astype(np.uint64)
        mixed = (points + np.uint64(1)) * (place * np.uint64(2) + np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        whole = np.add.reduceat(mixed * mult, starts) * mult
        found.append(whole ^ (whole >> np.uint64(31)))
        whose.append(np.arange(len(bare)))
    order = np.argsort(np.concatenate(whose), kind="stable")
    return (np.concatenate(found) % np.uint64(params.buckets))[order].astype(np.int64), np.concatenate(whose)[order]


def text_bag(text: str, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, those of a mean over words and padding; empty for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    buckets, owner = subwords(words, params)
    weight = 1.0 / (np.bincount(owner)[owner] * (len(words) + params.padding))
    unique, index = np.unique(buckets, return_inverse=True)
    return unique, np.bincount(index, weight)


def least_docs(n: int, params: Params) -> int:
    """In how many of n documents a bucket must be."""
    return max(2, int(np.ceil(params.least_share * n)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, params: Params = Params(), over: float = 1.0) -> tuple[np.ndarray, float]:
    """Adagrad on the embeddings and the softmax together; returns each bucket's contribution to the logit of class 1, and the bias.

    over: how many times more frequent class 1 is against class 0 in the sample than in all labels; weights undo it.
    With two classes only the difference of their logits counts, so the table (buckets x width) times the
    difference of the class vectors is all that scoring needs.
    """
    ones = labels.sum()
    weight = (over * (len(labels) - ones) / ones) ** params.balance / over
    rng = np.random.default_rng(params.seed)
    count = np.zeros(params.buckets, np.int64)
    for b, _ in bags:
        count[b] += 1
    known = count >= least_docs(len(bags), params)
    bags = [(b[known[b]], w[known[b]]) for b, w in bags]
    table = rng.normal(0, 0.1, (params.buckets, params.width))
    head, bias = rng.normal(0, 0.5, (params.width, 2)), np.zeros(2)
    table_sq, head_sq, bias_sq = np.full(params.buckets, 1e-8), np.full_like(head, 1e-8), np.full(2, 1e-8)
    epochs = max(params.epochs, -(-params.least_steps * params.batch // len(bags)))
    for epoch in range(epochs):
        rate = params.rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), params.batch):
            own = [k for k in order[at : at + params.batch] if len(bags[k][0])]
            if not own:
                continue
            ids, weights = (np.concatenate([bags[k][i] for k in own]) for i in (0, 1))
            ends = np.r_[0, np.cumsum([len(bags[k][0]) for k in own])[:-1]]
            hidden = np.add.reduceat(table[ids] * weights[:, None], ends, axis=0)
            logits = hidden @ head + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= np.where(labels[own], weight, 1.0)[:, None] / len(own)
            back = np.repeat(p @ head.T, np.diff(np.r_[ends, len(ids)]), axis=0) * weights[:, None]
            d_head, d_bias = hidden.T @ p, p.sum(0)
            unique, index = np.unique(ids, return_inverse=True)
            d_table = np.stack([np.bincount(index, back[:, j]) for j in range(params.width)], 1)
            table_sq[unique] += (d_table**2).mean(1)
            table[unique] -= rate * d_table / np.sqrt(table_sq[unique])[:, None]
            head_sq += d_head**2
            head -= rate * d_head / np.sqrt(head_sq)
            bias_sq += d_bias**2
            bias -= rate * d_bias / np.sqrt(bias_sq)
    return np.where(known, table @ (head[:, 1] - head[:, 0]), 0.0), float(bias[1] - bias[0])


@dataclass(frozen=True)
class Model:
    logit: np.ndarray
    bias: float
    params: Params


def _sample(rows: DataFrame, params: Params) -> tuple[DataFrame, dict[int, int]]:
    """Rows to learn from, and the number of all rows by class. What one class leaves free of its half, the other gets."""
    cut = F.xxhash64("doc_id")
    cuts = materialize(rows.select("toxic", cut.alias("cut")), "cuts")
    total = {0: 0, 1: 0, **{r.toxic: r["count"] for r in cuts.groupBy("toxic").count().collect()}}
    ones = min(total[1], max(params.docs // 2, params.docs - total[0]))
    first = least_hashes(cuts, "toxic", "cut", params.docs).where(F.col("nth") <= F.when(F.col("toxic") == 1, ones).otherwise(params.docs - ones))
    last = {r.toxic: r.cut for r in first.groupBy("toxic").agg(F.max("cut").alias("cut")).collect()}
    if not last:
        return rows.where("false"), total
    # The first condition is on doc_id alone, so texts of rows that can't be chosen stay out of a join before this.
    chosen = rows.where(cut <= max(last.values()))
    return chosen.where(F.when(F.col("toxic") == 1, cut <= last.get(1)).otherwise(cut <= last.get(0))), total


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Model from (doc_id, text, toxic), learned from a bounded sample; null labels are passed over.

    Without rows of both classes every text scores the share of toxic labels (0.5 without any).
    """
    rows = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    chosen, total = _sample(rows, params)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bags = [text_bag(t or "", params) for t in part.column("text").to_pylist()]
                columns = [
                    part.column("doc_id"),
                    part.column("toxic"),
                    pa.array([b.astype("<i4").tobytes() for b, _ in bags], pa.binary()),
                    pa.array([w.astype("<f4").tobytes() for _, w in bags], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "ids", "weights"])

    bagged = materialize(chosen.mapInArrow(bag, "doc_id long, toxic int, ids binary, weights binary"), "bags")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                seen[np.frombuffer(ids, "<i4")] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    at_least = least_docs(bagged.count(), params)
    often = bagged.select("ids").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    known = np.zeros(params.buckets, bool)
    known[often.where(F.col("n") >= at_least).select("bucket").toPandas()["bucket"].to_numpy(np.int64)] = True

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(v, "<i4") for v in batch.column("ids").to_pylist()]
            weights = [np.frombuffer(v, "<f4") for v in batch.column("weights").to_pylist()]
            columns = [
                batch.column("doc_id"),
                batch.column("toxic"),
                pa.array([b[known[b]].tobytes() for b in ids], pa.binary()),
                pa.array([w[known[b]].tobytes() for b, w in zip(ids, weights, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "ids", "weights"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels = [], []
        for batch in batches:
            labels += batch.column("toxic").to_pylist()
            ids, weights = (batch.column(c).to_pylist() for c in ("ids", "weights"))
            bags += [(np.frombuffer(b, "<i4"), np.frombuffer(w, "<f4")) for b, w in zip(ids, weights, strict=True)]
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
            logit, bias = np.zeros(params.buckets), float(np.log(share / (1 - share)))
        else:
            logit, bias = train(bags, y, params, y.sum() / (len(y) - y.sum()) * total[0] / total[1])
        yield pa.RecordBatch.from_arrays([pa.array([logit.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["logit", "bias"])

    # The sample is bounded, so one task learns from it; its rows come in a fixed order, so a task that is run again finds the same.
    schema = "doc_id long, toxic int, ids binary, weights binary"
    ordered = bagged.mapInArrow(trim, schema).repartition(1).sortWithinPartitions("doc_id", "toxic", "ids")
    found = ordered.mapInArrow(learn, "logit binary, bias double").first()
    if found is None:
        return Model(np.zeros(params.buckets), 0.0, params)
    return Model(np.frombuffer(found.logit, "<f8"), found.bias, params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text, from 0 to 1, and 1 where it reaches the threshold; one pass, no shuffle.

    A null text, and one without words, scores what the bias alone gives. Repeated rows each give a row; other
    columns are not looked at; an empty table gives no rows.
    """
    scored = _scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "score", (F.col("score") >= model.params.threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, with all their columns, whatever these are named, whose score is under the threshold.

    Null and empty texts score what the bias gives; an empty table gives no rows.
    """
    return _scored(docs, model).where(F.col(free_name(docs, "score")) < model.params.threshold).select(*docs.columns)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    name = free_name(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                split = [(t or "").split() for t in part.column("text").to_pylist()]
                if len(known) > _CACHED_WORDS:
                    known.clear()
                new = list(set().union(*split).difference(known))
                if new:
                    buckets, owner = subwords(new, own.params)
                    total = np.bincount(owner, own.logit[buckets], len(new)) / np.bincount(owner, minlength=len(new))
                    known.update(zip(new, total.tolist(), strict=True))
                get = known.__getitem__
                z = np.array([sum(map(get, s)) / (len(s) + own.params.padding) for s in split]) + own.bias
                found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{schema}, {name} double")
