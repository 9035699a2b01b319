"""Source divergence audit: how far the sources of a language differ in their use of its common terms.

Which terms are common is found by iceberg prefix refinement: in each pass over the documents, prefixes of twice as many
bytes are counted, each once a document, but only those that extend a prefix kept by the pass before. A prefix in too
few documents takes all terms it begins along, so the long tail of rare terms is never counted. A term is complete
in the pass whose prefixes are long enough for it, and is kept if enough documents have it. What a pass has kept goes
to the next one as a bitmap of a bounded size; that it may let others through costs counts, not results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import Bitmap, materialize
from corpusmatch.llm.tokens import LOWER, added_up, bytes_of, cut, distinct, groups_of, steps

_TERM = np.ones(256, bool)
_TERM[:65] = _TERM[91:97] = _TERM[123:128] = False
_PARTS = 64


@dataclass(frozen=True)
class Params:
    #: Documents of its language that a term needs.
    least_docs: int = 30
    #: Bytes of the prefixes of the first pass; each further pass takes twice as many.
    first: int = 6
    #: Terms listed of each group.
    top: int = 50
    #: p is in parts of so much, after `smoothing` is added to every count.
    scale: int = 1_000_000_000
    smoothing: int = 5


def _terms(part: pa.RecordBatch, over: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each text and each of its terms of more than `over` bytes, in order of the terms' bytes: text, number of the term, occurrences; and the terms, sorted."""
    data, begins = bytes_of(part.column("text"))
    words = cut(LOWER[data], begins, _TERM)
    if over:
        words = words.where(words.lengths() > over)
    ids, found = words.encoded()
    order = pc.sort_indices(found).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = max(1, len(order))
    pairs, times = np.unique(words.text * n + place[ids], return_counts=True)
    return pairs // n, pairs % n, times.astype(np.int64), found.take(pa.array(order))


def _hashes(values: list[bytes], seeds: list[int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v, s) for v, s in zip(values, seeds, strict=True)), np.uint64, len(values)).view(np.int64)


def _runs(keys: pa.Array, more: np.ndarray | None = None) -> np.ndarray:
    """Numbers that grow by one wherever a sorted key differs from the one before it."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    new = np.r_[False, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]
    if more is not None:
        new |= np.r_[False, more[1:] != more[:-1]]
    return np.cumsum(new)


def _marks(codes: np.ndarray, most: int) -> np.ndarray:
    out = np.zeros(most, bool)
    out[codes] = True
    return out


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def prefix_counts(docs: DataFrame, before: int, size: int, kept: Bitmap | None) -> DataFrame:
    """(lang, prefix, whole, n): documents with a term of more than `before` bytes that begins so.

    A prefix has `size` bytes, or is a whole term of at most so many. With `kept`, of prefixes of `before` bytes, others than
    their extensions are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            lang, langs = groups_of(part.column("lang"))
            text, term, _, terms = _terms(part, before)
            if not len(terms):
                continue
            lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
            fine = np.ones(len(term), bool)
            if shared.value is not None:
                parents = pc.binary_slice(terms, 0, before)
                parent = _runs(parents)[term]
                first = np.flatnonzero(np.r_[True, np.diff(_runs(parents)) > 0])
                n = int(parent.max(initial=0)) + 1
                code = lang[text] * n + parent
                codes, _ = distinct(code, len(langs) * n)
                seeds = [xxhash.xxh64_intdigest(x) for (x,) in langs]
                may = shared.value.has(_hashes(parents.take(pa.array(first[codes % n])).to_pylist(), [seeds[k] for k in (codes // n).tolist()]))
                fine &= np.isin(code, codes[may]) if len(langs) * n > len(code) * 8 + (1 << 20) else _marks(codes[may], len(langs) * n)[code]
            keys, whole = pc.binary_slice(terms, 0, size), lengths <= size
            runs = _runs(keys, whole)
            first, n = np.flatnonzero(np.r_[True, np.diff(runs) > 0]), int(runs[-1]) + 1
            run = runs[term]
            once = np.r_[True, (run[1:] != run[:-1]) | (text[1:] != text[:-1])] & fine
            codes, found = distinct(lang[text[once]] * n + run[once], len(langs) * n)
            at = first[codes % n]
            columns = [pa.array([x for (x,) in langs], pa.string()).take(pa.array(codes // n)), keys.take(pa.array(at)).cast(pa.binary()), pa.array(whole[at]), pa.array(found.astype(np.int64))]
            yield pa.table(columns, ["lang", "prefix", "whole", "n"])

    counted = docs.select("lang", "text").mapInArrow(lambda batches: added_up(count(batches)), "lang string, prefix binary, whole boolean, n long")
    return counted.groupBy("lang", "prefix", "whole").agg(F.sum("n").alias("n"))


def _bitmap(df: DataFrame, n: int, column: str) -> Bitmap:
    """Of (lang, column), with some 16 bits a row, 2^28 (32 MB) at most. Hashed as the tasks hash."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [xxhash.xxh64_intdigest(x) for x in batch.column("lang").to_pylist()]
            hashes = _hashes(batch.column(column).cast(pa.binary()).to_pylist(), seeds)
            yield pa.RecordBatch.from_arrays([pa.array(hashes)], ["hash"])

    return Bitmap.of(df.select("lang", column).mapInArrow(mark, "hash long"), F.col("hash"), bits=int(min(28, max(20, np.ceil(np.log2(16 * n + 1))))))


def common_terms(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, term): the terms in at least `least_docs` of the language's documents; every row is a document."""
    whole, kept, before, size = [], None, 0, params.first
    while True:
        counted = materialize(prefix_counts(docs, before, size, kept).where(F.col("n") >= params.least_docs), "prefixes")
        whole.append(counted.where("whole"))
        open_ = counted.where("not whole")
        n = open_.count()
        if not n:
            break
        kept, before, size = _bitmap(open_, n, "prefix"), size, 2 * size
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return materialize(found.select("lang", F.decode("prefix", "utf-8").alias("term")), "terms")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of each common term in each group that has it."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms, terms.count(), "term"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for part in steps(batches):
            group, groups = groups_of(part.column("lang"), part.column("source"))
            langs = sorted({x for x, _ in groups})
            lang = np.array([langs.index(x) for x, _ in groups], np.int64)
            text, term, times, terms_ = _terms(part)
            n = len(terms_)
            if not n:
                continue
            # Terms that aren't common in their language go before they are dealt to sources.
            code = lang[group[text]] * n + term
            codes, _ = distinct(code, len(langs) * n)
            seeds = [xxhash.xxh64_intdigest(x) for x in langs]
            may = shared.value.has(_hashes(terms_.take(pa.array(codes % n)).to_pylist(), [seeds[k] for k in (codes // n).tolist()]))
            fine = np.isin(code, codes[may]) if len(langs) * n > len(code) * 8 + (1 << 20) else _marks(codes[may], len(langs) * n)[code]
            codes, place = np.unique(group[text[fine]] * n + term[fine], return_inverse=True)
            found = pa.array(codes // n)
            columns = [pa.array([g[k] for g in groups], pa.string()).take(found) for k in (0, 1)]
            columns += [terms_.take(pa.array(codes % n)).cast(pa.binary()).cast(pa.string()), pa.array(np.bincount(place, times[fine], len(codes)).astype(np.int64))]
            yield pa.table(columns, ["lang", "source", "term", "n"])

    counted = docs.mapInArrow(lambda batches: added_up(count(batches)), "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counted.join(terms, ["lang", "term"], "left_semi")


def _share(n: Column, total: Column, terms: Column, params: Params) -> Column:
    over = F.lit(params.scale).cast("decimal(10,0)") * (n + params.smoothing).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, (total + params.smoothing * terms).cast("decimal(20,0)"))


def _distances(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value): sums of |p - q| over the rows (lang, ps), of all pairs of places in ps; each task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            group, langs = groups_of(batch.column("lang"))
            for g, (lang,) in enumerate(langs):
                own = batch.column("ps").filter(pa.array(group == g))
                table = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                total = sums.setdefault(lang, np.zeros((table.shape[1], table.shape[1]), np.int64))
                for k in range(table.shape[1]):
                    total[k] += np.abs(table - table[:, [k]]).sum(0)
        for lang, total in sums.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            columns = [pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "i", "j", "value"])

    summed = rows.select("lang", "ps").mapInArrow(add, "lang string, i int, j int, value long")
    return summed.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Distances of every (lang, source) group to the other sources of its language, and the terms it favours.

    p and q are shares of a term in a group and in another source (part `pair`) or in the whole language (part `term`), in
    billionths, exact. (lang, source, part, item, value, rank). Null lang, source and text read as ''; a group without
    terms still has its rows; a language without common terms has pairs of value 0; every row counts as a document, also
    a repeated one; an empty table gives no rows; other columns are not looked at.
    """
    docs = _filled(docs)
    terms = common_terms(docs, params)
    counts = materialize(term_counts(docs, terms), "term-counts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().withColumn("place", place)
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    n_terms = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(total, ["lang", "source"], "left").join(of_lang, "lang", "left").join(n_terms, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "lang_total", "terms"]), "groups")

    # Every group gets a row for each common term; parts of the terms spread a language over tasks.
    spread = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    parts = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(_PARTS)).cast("int"))
    grid = spread.join(parts, ["lang", "part"]).join(counts, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    grid = grid.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"), params))
    own = F.sort_array(F.collect_list(F.struct("place", "source", "n", "p")))
    rows = grid.groupBy("lang", "term", "lang_total", "terms").agg(own.alias("own"), F.sum("n").alias("n"))
    rows = rows.select("lang", "term", "own", _share(F.col("n"), F.col("lang_total"), F.col("terms"), params).alias("q"))
    rows = materialize(rows, "shares")

    favoured = rows.select("lang", "term", "q", F.explode("own").alias("g")).where("g.n > 0 and g.p > q")
    favoured = favoured.select("lang", "g.source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("g.p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    favoured = favoured.withColumn("rank", rank).where(F.col("rank") <= params.top)

    distances = _distances(rows.select("lang", F.col("own.p").alias("ps")))
    ends = groups.select("lang", "source", F.col("place").alias("i"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    pairs = ends.join(others, "lang").where("i <> j").join(distances, ["lang", "i", "j"], "left").na.fill(0, ["value"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(favoured)
