"""Remove every byte that is covered by a long string found elsewhere in the corpus, by suffix arrays over candidates.

A suffix array of everything can't be built in bounded memory, and only places that repeat matter. Any two equal
strings of `length` bytes select the same anchor, the inner string of half the length with the least hash, so strings
can only be equal where anchors are. The windows of a text fall into stretches with the same anchor.

1. Anchors that occur once in the corpus drop out (hashes only are shuffled).
2. Stretches that are equal as a whole are collapsed to one; all their windows repeat.
3. What is left of an anchor's distinct stretches goes into blocks of about a megabyte. Each gets a suffix array by
   two-stage sorting: suffixes smaller than their successors are sorted directly, the rest is induced from them by
   scans over the buckets. A window repeats if it has `length` bytes in common with a neighbour in the array.
4. Anchors with more distinct stretches than a block holds have their windows counted by 128-bit hashes instead.

Windows are turned into byte ranges per text, and the texts that have some are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.llm.common import Bitmap, materialize

_CHUNK = 1 << 18  # positions in a chunk of texts that is hashed at once; 18 bits, as some twenty numbers a position are held
_POS = np.uint64(_CHUNK - 1)
_ODD = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass(frozen=True)
class Params:
    length: int = 400
    block: int = 1 << 20
    #: Distinct stretches of one anchor that a block may hold; anchors with more are counted window by window.
    most_stretches: int = 1500


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, and powers of an odd base modulo 2^64 and of its inverse."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63)) | 5
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(_CHUNK + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of a chunk of bytes."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        values, power, self.inverse = _powers(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.r_[values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, first and last window, anchor hash and hash of the whole of each stretch, in order.

    A text longer than a chunk is hashed in overlapping parts; no window is lost.
    """
    parts, out, size, batch = [], [], 0, []
    step = _CHUNK - length + 1
    for k, t in enumerate(texts):
        if len(t) >= length:
            parts += [(k, s, t[s : s + _CHUNK]) for s in range(0, len(t) - length + 1, step)]
    for part in [*parts, None]:
        if batch and (part is None or size + len(part[2]) > _CHUNK):
            out.append(_stretches(batch, length))
            batch, size = [], 0
        if part:
            batch.append(part)
            size += len(part[2])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _stretches(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    inner = length // 2
    rolling = Rolling(data)
    hashed = rolling.windows(inner)
    order = (hashed & ~_POS) | np.arange(len(hashed), dtype=np.uint64)
    least = (_sliding_min(order, length - inner + 1) & _POS).astype(np.int64)  # of the window from each position
    starts = np.cumsum([0, *(len(p[2]) for p in parts)])[:-1]
    sizes = np.array([len(p[2]) - length + 1 for p in parts])
    windows = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    owner = np.repeat(np.arange(len(parts)), sizes)
    anchor = least[windows]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:] - 1, len(windows) - 1]
    whole = rolling.hashes(windows[first], windows[last] + length)
    shift = (np.array([p[1] for p in parts]) - starts)[owner[first]]
    text = np.array([p[0] for p in parts])[owner[first]]
    return text, windows[first] + shift, windows[last] + shift, hashed[anchor[first]].view(np.int64), whole.view(np.int64)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by two-stage sorting. symbols: bytes from 1; 0 ends a part."""
    n = len(symbols)
    text = np.r_[symbols, np.zeros(depth + 8, np.uint8)]
    word = np.zeros(n + depth, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | text[k : k + n + depth]
    # Stage 1: a suffix smaller than its successor is of the direct kind; equal symbols follow their right neighbour.
    step = np.sign(np.diff(text[: n + 1].astype(np.int16)))
    step[-1:] = 1
    change = np.flatnonzero(step)
    direct = np.repeat(step[change] > 0, np.diff(change, prepend=-1))[:n]
    sorted_ = _direct_sort(np.flatnonzero(direct).astype(np.int32), word, depth)
    del word
    rank = np.full(n + 1, -1, np.int32)
    out: list[np.ndarray] = []
    # Stage 2: buckets by first symbol, upwards. Those induced come first in theirs: they are smaller than any direct
    # suffix with the same symbol. A suffix is placed once its successor is, so runs of one symbol take turns.
    first = text[sorted_]
    bounds = np.searchsorted(first, np.arange(257))
    induced = np.flatnonzero(~direct).astype(np.int32)
    by_symbol = induced[np.argsort(text[induced], kind="stable")]
    cut = np.searchsorted(text[by_symbol], np.arange(257))
    placed = 0
    for c in np.unique(text[:n]).tolist():
        waiting = by_symbol[cut[c] : cut[c + 1]]
        while waiting.size:
            ready = rank[waiting + 1] >= 0
            now = waiting[ready]
            now = now[np.argsort(rank[now + 1], kind="stable")]
            rank[now] = placed + np.arange(len(now))
            placed += len(now)
            out.append(now)
            waiting = waiting[~ready]
        own = sorted_[bounds[c] : bounds[c + 1]]
        rank[own] = placed + np.arange(len(own))
        placed += len(own)
        out.append(own)
    return np.concatenate(out)


def _direct_sort(where: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their first `depth` symbols, eight at a time; only ties go on."""
    order = where[np.argsort(word[where], kind="stable")]
    key = word[order]
    tied = np.r_[False, key[1:] == key[:-1]]
    group = np.cumsum(~tied)
    for at in range(8, depth, 8):
        active = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not active.size:
            break
        own, g = order[active], group[active]
        key = word[own + at]
        by = np.lexsort((key, g))
        order[active] = own[by]
        key, g = key[by], g[by]
        tied[active] = np.r_[False, (key[1:] == key[:-1]) & (g[1:] == g[:-1])]
        # A group that splits gets new numbers; those of others stay apart.
        group = np.cumsum(~tied)
    return order


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each distinct part, the windows of `length` bytes that occur more than once in all parts."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    used = np.zeros(256, bool)
    used[data] = True
    code = (np.cumsum(used)).astype(np.uint8)  # UTF-8 leaves bytes unused, so 0 stays free
    ends = np.cumsum([len(p) + 1 for p in parts])
    symbols = np.zeros(int(ends[-1]), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = code[data]
    left = np.repeat((ends - 1).astype(np.int32), [len(p) + 1 for p in parts]) - np.arange(len(symbols), dtype=np.int32)
    order = suffix_array(symbols, length)
    order = order[left[order] >= length]
    text = np.r_[symbols, np.zeros(8, np.uint8)]
    a, b = order[:-1], order[1:]
    same = np.arange(len(a), dtype=np.int32)
    word = np.zeros(len(symbols), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | text[k : k + len(symbols)]
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[word[a[same] + at] == word[b[same] + at]]
    hit = np.zeros(len(symbols), bool)
    hit[a[same]] = hit[b[same]] = True
    return [np.flatnonzero(hit[e - len(p) - 1 : e - 1]) for e, p in zip(ends.tolist(), parts, strict=True)]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 300) -> Iterator[pa.RecordBatch]:
    """Parts of so many rows, so few are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    if not places.size:
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist(), strict=True))


def _candidates(docs: DataFrame, params: Params) -> DataFrame:
    """Stretches whose anchor's hash may occur elsewhere: doc_id, class (md5 of the text), first, last, anchor, whole."""
    length = params.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                text, *found = stretches(texts, length)
                ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
                lists = [pa.ListArray.from_arrays(ends, pa.array(f).cast(k)) for f, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("class"), *lists], names)

    names = ["doc_id", "class", "first", "last", "anchor", "whole"]
    schema = "doc_id long, class string, first array<int>, last array<int>, anchor array<long>, whole array<long>"
    all_ = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("class"))
    all_ = materialize(all_.mapInArrow(cut, schema), "stretches")
    several = all_.select(F.explode("anchor").alias("anchor")).groupBy("anchor").count().where("count > 1")
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(several, F.col("anchor")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("anchor")
            hit = np.flatnonzero(shared.value.has(lists.flatten().to_numpy()))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[hit]
            flat = [batch.column(c).flatten().take(pa.array(hit)) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in names[:2]] + flat, names)

    flat = "doc_id long, class string, first int, last int, anchor long, whole long"
    return materialize(all_.mapInArrow(keep, flat), "candidates")


def _texts_of(stretches_: DataFrame, docs: DataFrame, params: Params) -> DataFrame:
    """The stretches with their bytes; texts are read again, only those that have some are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(stretches_, F.xxhash64("class")))
    length = params.length

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column("h").to_numpy()))).select(["class", "text"])

    hashed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("class"), "text").withColumn("h", F.xxhash64("class"))
    texts = hashed.mapInArrow(pick, "class string, text string")
    wanted = stretches_.groupBy("class").agg(F.collect_list(F.struct("first", "last", "anchor", "whole")).alias("s"))

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out = []
            for name, text, found in zip(*(batch.column(c).to_pylist() for c in ("class", "text", "s")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(name, s["first"], s["anchor"], s["whole"], data[s["first"] : s["last"] + length]) for s in found]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 5
            fields = ["class", "first", "anchor", "whole", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

    schema = "class string, first int, anchor long, whole long, data binary"
    return texts.dropDuplicates(["class"]).join(wanted, "class").mapInArrow(slice_, schema)


def _sorted_windows(parts: DataFrame, params: Params) -> DataFrame:
    """Ranges of windows (class, first, last) that repeat, by suffix arrays over blocks of whole anchor groups."""
    length, most = params.length, params.block

    def solve(block: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        out = [
            (name, first + a, first + b)
            for (name, first, _), places in zip(block, repeated_windows([d for *_, d in block], length), strict=True)
            for a, b in _ranges(places)
        ]
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["class", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, anchor = [], 0, None
        for batch in _parts(batches, 2000):
            for name, first, key, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != anchor and size >= most:
                    yield solve(block)
                    block, size = [], 0
                anchor = key
                block.append((name, first, data))
                size += len(data)
        if block:
            yield solve(block)

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "class string, first int, last int")


def _counted_windows(parts: DataFrame, params: Params) -> DataFrame:
    """The same for anchors with too many distinct stretches: every window by a 128-bit hash, counted map-side first."""
    length = params.length

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, data in zip(*(batch.column(c).to_pylist() for c in ("class", "first", "data")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                h = [pa.array(Rolling(raw, seed).windows(length).view(np.int64)) for seed in (2, 3)]
                at = pa.array(first + np.arange(len(h[0]), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*h, pa.array([name] * len(at), pa.string()), at], ["x", "y", "class", "first"])

    each = parts.mapInArrow(hashes, "x long, y long, class string, first int")
    several = each.groupBy("x", "y").count().where("count > 1").select("x", "y")
    return each.join(several, ["x", "y"]).select("class", "first", F.col("first").alias("last"))


def remove_repeats(docs: DataFrame, params: Params = Params(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and the bytes kept, if asked for).

    Strings are judged on the input: all copies of a repeated string go, the first included. A null text counts as
    empty; texts shorter than the length keep all; repeated rows are copies of each other. Other columns are ignored;
    an empty table gives no rows.
    """
    found = _candidates(docs, params)
    kinds = found.groupBy("anchor", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("class", "first", "last")).alias("one")
    )
    kinds = materialize(kinds, "kinds")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    alone = kinds.join(groups, "anchor").select("anchor", "whole", "kinds", "n", "one.*")
    parts = materialize(_texts_of(alone, docs, params).join(alone.select("anchor", "whole", "kinds", "n"), ["anchor", "whole"]), "parts")
    columns = ("class", "first", "anchor", "whole", "data")
    ranges = _sorted_windows(parts.where(F.col("kinds") <= params.most_stretches).select(*columns), params)
    ranges = ranges.unionByName(_counted_windows(parts.where(F.col("kinds") > params.most_stretches).select(*columns), params))
    whole = found.join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("class", "first", "last")
    ranges = whole.unionByName(ranges).groupBy("class", "first").agg(F.max("last").alias("last"))
    ranges = materialize(ranges.groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")

    hashed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("class"))
    hashed = hashed.withColumn("h", F.xxhash64("class"))
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(ranges, F.xxhash64("class")))
    length = params.length
    schema = SCHEMA + ", kept binary" * with_text

    def row(doc: int | None, data: bytes, own: list[dict] | None) -> tuple:
        cut, kept, removed = [], [], 0
        for r in sorted((r["first"], r["last"] + length) for r in own or ()):
            if cut and r[0] <= cut[-1][1]:
                cut[-1][1] = max(cut[-1][1], r[1])
            else:
                cut.append([*r])
        at = 0
        for a, b in cut:
            kept.append(data[at:a])
            removed += b - a
            at = b
        left = b"".join([*kept, data[at:]])
        return (doc, len(data), removed, len(cut), hashlib.sha256(left).hexdigest(), left)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in _parts(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            own = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * len(texts)
            out = [row(*x) for x in zip(batch.column("doc_id").to_pylist(), texts, own, strict=True)]
            lists = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(lists, kinds_, strict=False)], names)

    def picked(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared.value.has(batch.column("h").to_numpy()) == want
            yield batch.filter(pa.array(hit)).select(["doc_id", "text", "class"])

    # One Python step each, as every step of a stage has a worker and buffers of its own for each task.
    untouched = hashed.mapInArrow(lambda batches: finish(picked(batches, False)), schema)
    touched = hashed.mapInArrow(lambda batches: picked(batches, True), "doc_id long, text string, class string")
    return untouched.unionByName(touched.join(ranges, "class", "left").mapInArrow(finish, schema))
