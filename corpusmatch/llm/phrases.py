"""Phrase collocations by top-order marginalisation: only longest windows are counted, ROLLUP sums their prefixes.

The window of a word is the word and the words that lead on from it, at most five, padded where its piece ends. A phrase
of k words occurs as often as windows begin with it, so one count of windows holds all shorter phrases, and Spark's
ROLLUP over the window's columns sums it for each prefix; no n-gram of another length is ever made. Windows of one word
are left out, as words are counted anyhow.

A frequent phrase holds frequent words, neighbours and triples only. So windows end where one of these isn't frequent in
its language. Which ones may be, three counts before find out: of words, and of hashes of neighbours and of triples. They
go out as bitmaps of a bounded size that may let a few others through; the final counts of frequent phrases are exact
whatever passes, as an infrequent phrase only ever loses. Each has several bits: with one, the share of infrequent pairs
let through outnumbers the frequent ones, more so the larger the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import Bitmap, materialize
from corpusmatch.llm.tokens import LOWER, Words, added_up, byte_class, bytes_of, cut, groups_of, steps

_WORD = ~byte_class(b" \t.,;:!?\n\x0b\x0c\r")
_BREAK = byte_class(b".,;:!?\n\x0b\x0c\r")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    longest: int = 5
    #: Occurrences that a phrase needs.
    least: int = 100
    #: A phrase inside a longer one that occurs at least so many percent as often is dropped.
    covered: int = 100
    #: Phrases returned of each language.
    top: int = 2000


def _words(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, list[str], pa.Array]:
    """Words of a part; of each (language, word) that it has: its number for each word, and by number language, word; languages; words."""
    data, begins = bytes_of(part.column("text"))
    words = cut(LOWER[data], begins, _WORD, _BREAK)
    ids, distinct = words.encoded()
    lang, langs = groups_of(part.column("lang"))
    n = max(1, len(distinct))
    codes, code = np.unique(lang[words.text] * n + ids, return_inverse=True)
    return words, code, codes // n, codes % n, [v[0] for v in langs], distinct


def _hashes(lang: np.ndarray, word: np.ndarray, langs: list[str], distinct: pa.Array) -> np.ndarray:
    seeds = [xxhash.xxh64_intdigest(x) for x in langs]
    own = distinct.take(pa.array(word)).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) for x, w in zip(lang.tolist(), own, strict=True)), np.uint64, len(lang))


def _text(distinct: pa.Array, word: np.ndarray) -> pa.Array:
    return distinct.take(pa.array(word)).cast(pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n): occurrences of every word of every language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            _, code, lang, word, langs, distinct = _words(part)
            hashes = _hashes(lang, word, langs, distinct).view(np.int64)
            columns = [pa.array(langs, pa.string()).take(pa.array(lang)), _text(distinct, word), pa.array(hashes), pa.array(np.bincount(code, minlength=len(lang)))]
            yield pa.table(columns, ["lang", "word", "hash", "n"])

    return docs.mapInArrow(lambda batches: added_up(count(batches)), "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _bitmap(df: DataFrame) -> Bitmap:
    """Of a column `hash`, with some 32 bits a row, 2^28 (32 MB) at most, and four of them set."""
    return Bitmap.of(df, F.col("hash"), bits=int(min(28, max(20, np.ceil(np.log2(32 * df.count() + 1))))), probes=4)


def _pairs(words: Words, code: np.ndarray, lang: np.ndarray, word: np.ndarray, langs: list[str], distinct: pa.Array, often: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """At which words a pair of words begins that may be frequent; the hash of each pair."""
    hashes = _hashes(lang, word, langs, distinct)
    fine = often.has(hashes.view(np.int64))[code]
    both = np.zeros(len(code), bool)
    both[:-1] = fine[:-1] & fine[1:] & (words.piece[:-1] == words.piece[1:])
    at = np.flatnonzero(both)
    with np.errstate(over="ignore"):
        mixed = (hashes[code[at]] * _MIX) ^ hashes[code[at + 1]]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return at, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def pair_counts(docs: DataFrame, often: Bitmap) -> DataFrame:
    """(hash, n): how often neighbours with this hash occur. Two pairs with one hash only let more through."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            found, n = np.unique(_pairs(*_words(part), shared.value)[1], return_counts=True)
            yield pa.table([pa.array(found), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.mapInArrow(lambda batches: added_up(count(batches)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _triples(words: Words, code: np.ndarray, pairs: Bitmap, lang: np.ndarray, word: np.ndarray, langs: list[str], distinct: pa.Array, often: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At which words a pair that may be frequent begins (as marks); where a triple of two such pairs begins, and its hash."""
    at, hashes = _pairs(words, code, lang, word, langs, distinct, often)
    leads = np.zeros(len(code) + 2, bool)
    fine = pairs.has(hashes)
    leads[at[fine]] = True
    whole = np.zeros(len(code) + 2, np.uint64)
    whole[at[fine]] = hashes[fine].view(np.uint64)
    both = np.flatnonzero(leads[:-1] & leads[1:])
    with np.errstate(over="ignore"):
        mixed = (whole[both] * _MIX) ^ (whole[both + 1] >> np.uint64(7))
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX
    return leads[:-2], both, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def triple_counts(docs: DataFrame, often: Bitmap, pairs: Bitmap) -> DataFrame:
    """(hash, n): how often triples with this hash occur, of those whose words and neighbours may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast((often, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            own, code, lang, word, langs, distinct = _words(part)
            found, n = np.unique(_triples(own, code, shared.value[1], lang, word, langs, distinct, shared.value[0])[2], return_counts=True)
            yield pa.table([pa.array(found), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.mapInArrow(lambda batches: added_up(count(batches)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def windows(docs: DataFrame, often: Bitmap, pairs: Bitmap, threes: Bitmap, longest: int) -> DataFrame:
    """(lang, w1, w2, ..., n): how often each window of two words or more occurs; a column past the window's end holds ''.

    Each task has a row for every frequent phrase that it meets, so there are no more tasks than cores, whatever the input:
    else both would grow with it, and the rows with their product.
    """
    shared = docs.sparkSession.sparkContext.broadcast((often, pairs, threes))
    names = [f"w{k + 1}" for k in range(longest)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            words, code, lang, word, langs, distinct = _words(part)
            leads, at, hashes = _triples(words, code, shared.value[1], lang, word, langs, distinct, shared.value[0])
            goes_on = np.zeros(len(code) + longest, bool)
            goes_on[at[shared.value[2].has(hashes)]] = True
            start = np.flatnonzero(leads)
            columns, on = [code[start]], np.ones(len(start), bool)
            for k in range(1, longest):
                on = on & (leads[start] if k == 1 else goes_on[start + k - 2])
                columns.append(np.where(on, code[np.minimum(start + k, len(code) - 1)], -1))
            order = np.lexsort(columns[::-1])
            rows = np.stack(columns, 1)[order]
            new = np.r_[True, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
            firsts = np.flatnonzero(new)
            rows, n = rows[firsts], np.diff(np.r_[firsts, len(order)]).astype(np.int64)
            own = [pa.array(langs, pa.string()).take(pa.array(lang[rows[:, 0]]))]
            for k in range(longest):
                picked = _text(distinct, np.where(rows[:, k] < 0, 0, word[rows[:, k]])) if len(rows) else pa.array([], pa.string())
                own.append(pa.compute.if_else(pa.array(rows[:, k] >= 0), picked, pa.scalar("")))
            yield pa.table([*own, pa.array(n)], ["lang", *names, "n"])

    schema = f"lang string, {', '.join(f'{c} string' for c in names)}, n long"
    few = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(lambda batches: added_up(count(batches), 600_000), schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of every phrase of 1 to `longest` words that occurs `least` times, and (lang, n) of all words."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = materialize(word_counts(own), "words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    enough = F.col("n") >= params.least
    often = _bitmap(counted.where(enough))
    pairs = _bitmap(materialize(pair_counts(own, often).where(enough), "pairs"))
    threes = _bitmap(materialize(triple_counts(own, often, pairs).where(enough), "triples"))
    names = [f"w{k + 1}" for k in range(params.longest)]
    summed = windows(own, often, pairs, threes, params.longest).rollup("lang", *names).agg(F.sum("n").alias("f")).where(F.col("f") >= params.least)
    # ROLLUP leaves null in the columns it has summed over, so the last that is there ends the prefix; '' there is padding.
    filled = F.array_compact(F.array(*names))
    found = summed.where("lang is not null and w1 is not null").select("lang", filled.alias("words"), "f").where("size(words) > 1 and element_at(words, -1) <> ''")
    single = counted.where(enough).select("lang", F.array("word").alias("words"), F.col("n").alias("f"))
    return materialize(found.unionByName(single), "phrases"), total


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(found: DataFrame, total: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) with their lowest-scoring cut: (lang, words, a, l, r, n, score)."""
    cuts = found.where(F.size("words") > 1).withColumnRenamed("f", "a").withColumn("cut", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cuts = cuts.withColumn("left", F.expr("slice(words, 1, cut)")).withColumn("right", F.expr("slice(words, cut + 1, size(words) - cut)"))
    part = found.select("lang", F.col("words").alias("part"), F.col("f"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(total, "lang")
    over, under = F.lit(1000).cast("decimal(4,0)") * (_wide("a") * _wide("n")).cast("decimal(34,0)"), _wide("l") * _wide("r")
    cuts = cuts.select("lang", "words", "a", "n", F.struct(_div(over, under).alias("score"), "cut", "l", "r").alias("cut"))
    return cuts.groupBy("lang", "words", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _div(over: Column, under: Column) -> Column:
    return F.call_function("div", over, under)


def covered(found: DataFrame) -> DataFrame:
    """(lang, words, most): each phrase of two words or more inside a longer candidate, and the greatest count of such a one."""
    inner = "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))"
    longer = found.where(F.size("words") > 2).select("lang", "f", F.explode(F.array_distinct(F.expr(inner))).alias("words"))
    return longer.groupBy("lang", "words").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The `top` collocations of every language: (lang, rank, phrase, a, l, r, n, score).

    Words are what lies between spaces and tabs inside pieces, which end at `. , ; : ! ?` and line ends; A-Z are lower-cased.
    score is floor(1000 * a * n / (l * r)) of the cut where that is lowest (of equals, the first), in exact decimals.
    A null text is empty, a null lang is `und`; a language without candidates gives no row; repeated rows count as
    often as they are there; an empty table gives no rows; other columns are not looked at.
    """
    found, total = phrase_counts(docs, params)
    longer = covered(found)
    own = scored(found, total).join(longer, ["lang", "words"], "left").where(F.coalesce(100 * F.col("most") < params.covered * F.col("a"), F.lit(True)))
    own = own.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "l", "r", "n", "score")
    # The best of each part of a language first, so no task sorts all candidates of a language.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = own.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= params.top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= params.top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
