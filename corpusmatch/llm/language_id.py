"""Language identification by n-gram filters whose slots hold a bitmask of languages.

A Bloom filter per language would need one look-up per language and n-gram. Here the filters of all languages
are kept side by side: a slot is a word with one bit per language, so the AND of an n-gram's slots gives all
languages that may contain it. Counting bits per language over a text, less the share that false positives
explain, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.llm.common import sample_cut

SCHEMA = "doc_id long, lang_pred string, score double"
ORDERS = (3, 4)
_SLICE = 64  # languages a slot word holds; more languages take more words
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Params:
    #: Documents of each language to learn from; at most so many are read into the filters.
    docs_per_language: int = 2000
    #: An n-gram belongs to a language if it makes at least this share of the language's n-grams.
    least_share: float = 1e-5
    slots_per_gram: int = 16
    hashes: int = 3


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram. Words are runs of letters, lower-cased, with a mark on either side."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    chars = _letters()[points]
    # A run of non-letters counts as one mark, also before the first letter of each text.
    keep = (chars > 0) | (np.r_[np.uint32(1), chars[:-1]] > 0) | (np.r_[-1, owner[:-1]] != owner)
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    found, whose = [], []
    for n in ORDERS:
        size = len(chars) - n + 1
        if size <= 0:
            continue
        hashed = np.full(size, n, np.uint64)
        inner = np.ones(size, bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                part = chars[k : k + size]
                hashed = (hashed ^ part) * np.uint64(_MIX[0])
                hashed ^= hashed >> np.uint64(32)
                if 0 < k < n - 1:
                    inner &= part > 0
        inner &= owner[:size] == owner[n - 1 :]
        if n == 3:  # the middle letter alone tells nothing of a one-letter word's neighbours, but it is a word
            inner &= chars[1 : 1 + size] > 0
        found.append(hashed[inner])
        whose.append(owner[:size][inner])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def _slots(hashed: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for k in range(hashes):
            mixed = (hashed + np.uint64(k)) * np.uint64(_MIX[1])
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_MIX[2])
            out.append((mixed >> np.uint64(20)) & np.uint64(size - 1))
    return out


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    slots: np.ndarray  # (languages / 64 rounded up, slots)
    false_rate: np.ndarray  # per language
    hashes: int

    def hits(self, hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For each of n texts and each language, how many n-grams its filter holds."""
        at = _slots(hashed, self.hashes, self.slots.shape[1])
        out = np.zeros((n, len(self.languages)))
        for s, words in enumerate(self.slots):
            mask = words[at[0]]
            for a in at[1:]:
                mask = mask & words[a]
            for i in range(s * _SLICE, min(len(self.languages), (s + 1) * _SLICE)):
                bit = (mask >> np.uint64(i - s * _SLICE)) & np.uint64(1)
                out[:, i] = np.bincount(owner[bit > 0], minlength=n)
        return out


def fit(labelled: DataFrame, params: Params = Params()) -> Filters:
    """Filters from (doc_id, text, lang). Rows without text or language are passed over.

    The n-grams of a bounded sample of each language are counted on the executors. Those over the least share come
    to the driver: at most one over that share for each language and order.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    chosen = sample_cut(rows, F.col("doc_id"), params.docs_per_language, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, index = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                hashed, owner = grams(part.column("text").to_pylist())
                for i, lang in enumerate(langs):
                    values, n = np.unique(hashed[index[owner] == i], return_counts=True)
                    columns = [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counts = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * params.least_share))
    found = kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).orderBy("lang").collect()
    languages = [r.lang for r in found]
    most = max([1, *(len(r.grams) for r in found)])
    size = 1 << max(10, (params.slots_per_gram * most - 1).bit_length())
    slots = np.zeros((max(1, -(-len(languages) // _SLICE)), size), np.uint64)
    for i, r in enumerate(found):
        for a in _slots(np.array(r.grams, np.int64).view(np.uint64), params.hashes, size):
            slots[i // _SLICE, a.astype(np.int64)] |= np.uint64(1) << np.uint64(i % _SLICE)
    share = [((slots[i // _SLICE] >> np.uint64(i % _SLICE)) & np.uint64(1)).mean() for i in range(len(languages))]
    return Filters(languages, slots, np.array(share) ** params.hashes, params.hashes)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Language and score of every whole text; one pass, no shuffle.

    The score is the corrected share of the text's n-grams that the language holds, from 0 to 1; equal shares go to
    the first language by name. `und` with score 0: a null text, a text without a letter, or no language learned.
    Repeated rows each give a row; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                hashed, owner = grams(texts)
                n = np.bincount(owner, minlength=len(texts))
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                if own.languages:
                    share = own.hits(hashed, owner, len(texts)) / np.maximum(n, 1)[:, None]
                    share = np.clip((share - own.false_rate) / np.maximum(1e-9, 1 - own.false_rate), 0, 1)
                    best = np.where(n > 0, share.argmax(1), -1)
                    score = np.where(n > 0, share.max(1), 0.0)
                columns = [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
