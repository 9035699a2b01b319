"""N-gram Jaccard join: exact links between documents by a prefix-tree join over globally ordered shingle sets.

A document is the set of hashes of its word n-grams, in the order of the hashes, which is the same for all. Equal
sets are one class from the start. Candidates meet in three kinds of rounds:

1. stars: classes that share one of their first few shingles are compared with one pivot each. This joins groups of
   near copies, of any size, with a few comparisons a class.
2. nearest: each class looks up its rarest shared shingle and is compared with one class of another component there,
   the one whose signature is nearest. Two such rounds join most of what is linked, with a pair a class at most.
3. the rest: of two linked classes, the smaller must find at least a known number of its leading shingles in the
   larger, among so many leading shingles as make that number sure (`posted`). Shingles that only one component has
   are out; a class left with fewer than that number can't be the one; the others look up as many of their rarest
   shingles as make missing a link impossible. Classes that hold a shingle meet in one task, in blocks; only pairs
   that may link leave it.

A pair may link unless its parity signatures rule it out. A signature has a bit for every value of the low bits of a
hash: whether an odd number of the set's hashes has it. Two signatures differ in no more bits than the sets differ in
shingles, so no link is lost.

Candidates of a probe come in the order of their sets, which is a depth-first walk of the prefix tree (trie) of those
sets: what a path shares with the one before is not counted again, and a subtree is left where the overlap so far
and what remains can't reach the threshold. Links between classes already joined are not looked for, as they change
no component. Nothing is gathered per group: a task holds the probe's set and the current path.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import Bitmap, components, materialize

_CACHED_WORDS = 150_000
_SEEN_PAIRS = 500_000


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: Linked if percent * union <= 100 * intersection.
    percent: int = 80
    #: Leading shingles by which round 1 looks for pivots.
    stars: int = 4
    #: Candidates of a probe in one block; more blocks are walked in parallel.
    block: int = 512
    #: Classes with one shingle that are compared with others in one block.
    meeting: int = 4096


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence, if it is shorter; none without words.

    Only A-Z are lower-cased; words are split at space and \\t \\n \\v \\f \\r.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(_hashes.__getitem__, split), np.uint64, len(split))
    n = min(words, len(values))
    size = len(values) - n + 1
    out = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ values[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def _class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def size_band(n: int, percent: int) -> int:
    """Linked sets are of the same band of sizes or of neighbouring ones."""
    return math.floor(math.log(n) / math.log(100 / percent + 1e-9))


def signature(hashes: np.ndarray, percent: int) -> bytes:
    """Parity of the set's hashes by their low bits; 256 to 4096 bits, the same number throughout a band of sizes."""
    most = (100 / percent + 1e-9) ** (size_band(len(hashes), percent) + 1)
    bits = min(4096, max(256, 1 << math.ceil(math.log2(2 * most))))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(signatures: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as they are with fewer low bits."""
    while signatures.shape[1] > width:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


@lru_cache(maxsize=100_000)
def posted(m: int, percent: int) -> int:
    """Leading shingles of a set of m that hold as many of any smaller linked set's leading ones as `_other_pairs` needs.

    Of an overlap o, the first `need` shingles are followed by o - need others, so they are among the first
    m - o + need. A set's own lead, which a linked set can't miss whole, is never longer.
    """
    n = np.arange(-(-percent * m // 100), m + 1)
    need = np.maximum(1, -(-2 * percent * n // (100 + percent)) + (-percent * n // 100) + 1)
    return int(max((m - -(-percent * (n + m) // (100 + percent)) + need).max(), m - -(-percent * m // 100) + 1))


def _sets(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, n_shingles, class (null if none), band and signature of the set, lead: its shingles that are posted."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                sets = [shingle_set(t, params.words) for t in part.column("text").to_pylist()]
                leads = [s[: posted(len(s), params.percent)].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, leads)]).astype(np.int32)
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([size_band(len(s), params.percent) if len(s) else None for s in sets], pa.int32()),
                    pa.array([signature(s, params.percent) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(leads))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "band", "signature", "lead"])

    made = "doc_id long, n_shingles long, class long, band int, signature binary, lead array<long>"
    return docs.select("doc_id", "text").mapInArrow(make, made)


def _full_sets(docs: DataFrame, needed: DataFrame, params: Params) -> DataFrame:
    """(class, n, hashes) of the needed (class, id), id being a document that has the class. Hashes are big-endian."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(needed, F.xxhash64("id")))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where("doc_id is not null")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(shared.value.has(batch.column("h").to_numpy())))
            for at in range(0, rows.num_rows, 100):
                part = rows.slice(at, 100)
                sets = [shingle_set(t, params.words) for t in part.column("text").to_pylist()]
                columns = [
                    part.column("doc_id"),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.astype(">u8").tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "class", "n", "hashes"])

    made = hashed.mapInArrow(make, "id long, class long, n long, hashes binary")
    return made.join(needed, ["class", "id"], "left_semi").dropDuplicates(["class"]).drop("id")


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection of sets of n and m that links them."""
    return -(-percent * (n + m) // (100 + percent))


class _Walk:
    """Depth-first walk of a probe's candidates, given in the order of their sets."""

    def __init__(self, probe: np.ndarray, percent: int) -> None:
        self.probe, self.percent = probe, percent
        self.path = np.zeros(0, np.uint64)
        self.overlap = np.zeros(0, np.int64)  # with the probe, up to each place of the path that was counted

    def linked(self, found: np.ndarray) -> bool:
        need = least_overlap(len(self.probe), len(found), self.percent)
        size = min(len(self.path), len(found))
        differ = np.flatnonzero(self.path[:size] != found[:size])
        shared = min(int(differ[0]) if differ.size else size, len(self.overlap))
        base = int(self.overlap[shared - 1]) if shared else 0
        self.path, self.overlap = found, self.overlap[:shared]
        passed = int(np.searchsorted(self.probe, found[shared - 1], side="right")) if shared else 0
        if base + min(len(self.probe) - passed, len(found) - shared) < need:
            return False
        rest = found[shared:]
        at = np.searchsorted(self.probe, rest)
        hit = self.probe[np.minimum(at, len(self.probe) - 1)] == rest
        counted = base + np.cumsum(hit)
        bound = counted + np.minimum(len(self.probe) - at - hit, len(rest) - 1 - np.arange(len(rest)))
        dead = np.flatnonzero(bound < need)
        self.overlap = np.r_[self.overlap, counted[: int(dead[0]) + 1] if dead.size else counted]
        return not dead.size


def _verify(pairs: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """The linked ones of distinct (a, b) class pairs, found by walking the trie of each a's candidates."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / params.block).alias("blocks"))
    placed = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("blocks")))
    probes = placed.select("a", "part").distinct().join(sets, F.col("a") == F.col("class"))
    rows = probes.select("a", "part", F.lit(None).cast("long").alias("b"), "hashes").unionByName(
        placed.join(sets, F.col("b") == F.col("class")).select("a", "part", "b", "hashes")
    )
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull(), "hashes")
    percent = params.percent

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, None
        for batch in batches:
            out = []
            for a, part, b, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(hashes, ">u8").astype(np.uint64)
                if b is None:
                    key, one = (a, part), _Walk(found, percent)
                elif key == (a, part) and one.linked(found):
                    out.append((a, b))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return ordered.mapInArrow(walk, "a long, b long")


def _star_pairs(posts: DataFrame, signatures: DataFrame, params: Params) -> DataFrame:
    """(pivot, class) that may link, for each class and each of its first shingles that another has at the front, too."""
    front = posts.where(F.col("pos") < params.stars)
    pivots = front.groupBy("token").agg(F.min("class").alias("a"))
    both = front.join(pivots, "token").where(F.col("class") != F.col("a"))
    pairs = both.select("a", F.col("class").alias("b")).distinct()
    for side in "ab":
        own = signatures.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}"))
        pairs = pairs.join(own, side)
    percent = params.percent

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, s, t in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                x, y = (np.frombuffer(v, np.uint64)[None] for v in (s, t))
                width = min(x.shape[1], y.shape[1])
                differ = int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())
                keep.append(differ <= n + m - 2 * least_overlap(n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fits = "na * {0} <= nb * 100 and nb * {0} <= na * 100".format(percent)
    return pairs.where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(close, "a long, b long")


def _may_link(probes: dict[str, np.ndarray], members: dict[str, np.ndarray], percent: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes (a, b) of probes and members of other components that signatures don't tell apart, a being the smaller; of each a only the nearest b, if asked for."""
    width = probes["signature"].shape[1]
    own = _fold(members["signature"], width)
    b, m, component = members["class"][None], members["n"][None], members["component"][None]
    step = max(1, 1_000_000 // own.size)
    for at in range(0, len(probes["class"]), step):
        part = {k: v[at : at + step] for k, v in probes.items()}
        a, n = part["class"][:, None], part["n"][:, None]
        fits = (part["component"][:, None] != component) & ((n < m) | ((n == m) & (a < b))) & (m * percent <= n * 100)
        i, j = np.nonzero(fits)
        most = n[i, 0] + m[0, j] - 2 * (-(-percent * (n[i, 0] + m[0, j]) // (100 + percent)))
        differ = np.bitwise_count(part["signature"][i] ^ own[j]).sum(axis=1, dtype=np.int64)
        close = np.flatnonzero(differ <= most)
        if nearest and close.size:
            close = close[np.lexsort((differ[close], i[close]))]
            close = close[np.r_[True, np.diff(i[close]) > 0]]
        yield a[i[close], 0], b[0, j[close]]


def _other_pairs(posts: DataFrame, signatures: DataFrame, joined: DataFrame, params: Params, nearest: bool) -> DataFrame:
    """Pairs between components that may link, the smaller class first; or, for each class, one of those at its rarest shingle."""
    percent = params.percent
    known = posts.join(joined.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("component", F.coalesce("component", "class"))
    size = F.struct("n", "class")
    several = known.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("df"), F.min(F.when(F.col("own"), size)).alias("low"), F.max(size).alias("high")
    )
    # Null where no class has the token in its own lead, so that nobody looks it up.
    left = known.join(several.where("x <> y and low is not null").drop("x", "y"), "token")
    # No class that looks a token up is smaller than the lowest; the largest class with it is nobody's smaller one.
    left = left.select("token", "class", "n", "own", "component", "df", (size <= F.col("low")).alias("lowest"), (size == F.col("high")).alias("highest"), F.col("high.n").alias("most"))
    left = materialize(left.where("own or not lowest"), "posts")
    # need: shingles of the own lead that a partner of the same size or larger must have posted, too.
    need = F.greatest(F.lit(1), F.ceil(2 * F.col("n") * percent / (100 + percent)) - F.ceil(F.col("n") * percent / 100) + 1)
    each = Window.partitionBy("class")
    small = left.where("own and not highest").withColumns({"has": F.count("*").over(each), "need": need})
    small = small.where("has >= need").withColumn("nth", F.row_number().over(each.orderBy("df", "token")))
    small = small.where("nth = 1" if nearest else "nth <= has - need + 1")
    own = signatures.select("class", "band", "signature")
    blocks = F.ceil(F.col("df") / params.meeting).cast("int")
    columns = ["token", "band", "block", "probe", "class", "n", "component", "signature"]
    members = left.where("not lowest")
    if nearest:
        members = members.join(small.select("token").distinct(), "token", "left_semi")
    members = members.join(own, "class").withColumns({"block": F.pmod(F.xxhash64("class"), blocks).cast("int"), "probe": F.lit(0)})
    probes = small.join(own, "class")
    # The next band, only if the largest class with the token may be in it.
    reach = F.pow(F.lit(100 / percent + 1e-9), F.col("band") + 1) <= F.col("most") + 1
    probes = probes.withColumn("band", F.explode(F.when(reach, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))))
    # Bands of one width of signature follow each other, so a group's probes come in runs of the same width.
    probes = probes.withColumns({"block": F.explode(F.sequence(F.lit(0), blocks - 1)), "probe": F.octet_length("signature")})
    met = members.select(columns).unionByName(probes.select(columns)).repartition("token", "band", "block")
    met = met.sortWithinPartitions("token", "band", "block", "probe")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        seen: set[tuple[int, int]] = set()  # a pair that meets at several shingles of a task leaves it once, mostly
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in columns[:-1]}
            binary = batch.column("signature")
            ends = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]
            data = np.frombuffer(binary.buffers()[2], np.uint8)
            changed = np.any([np.diff(rows[c]) != 0 for c in columns[:4]], axis=0)
            starts = [0, *(np.flatnonzero(changed) + 1), len(binary)]
            out = [(np.zeros(0, np.int64),) * 2]
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                run = {c: rows[c][i:j] for c in ("class", "n", "component")}
                run["signature"] = np.ascontiguousarray(data[ends[i] : ends[j]]).view(np.uint64).reshape(j - i, -1)
                now = tuple(rows[c][i] for c in columns[:3])
                if key != now:
                    key, members = now, []
                if rows["probe"][i] == 0:
                    members.append({c: v.copy() for c, v in run.items()})
                elif members:
                    if len(members) > 1:
                        members = [{c: np.concatenate([m[c] for m in members]) for c in run}]
                    out.extend(_may_link(run, members[0], percent, nearest))
            fresh = set(zip(*(np.concatenate(c).tolist() for c in zip(*out, strict=True)), strict=True)) - seen
            if len(seen) > _SEEN_PAIRS:
                seen.clear()
            seen |= fresh
            both = list(zip(*fresh, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in both], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; near copies share the smallest doc_id they reach.

    A document without words, or with a null text, has no shingles and is its own component. Repeated rows and equal
    sets are linked. A row with a null doc_id is linked with equal sets only, and is null's own component without one. Other columns are ignored; an empty table gives no rows.
    """
    all_ = materialize(_sets(docs, params), "shingles")
    classes = all_.where("class is not null").groupBy("class").agg(
        F.first("n_shingles").alias("n"), F.first("lead").alias("lead")
    )
    posts = classes.select("class", "n", F.posexplode("lead").alias("pos", "token"))
    own = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * params.percent / 100)
    posts = posts.withColumn("own", own)
    shared = posts.groupBy("token").agg(F.count("*").alias("df"), F.max("own").alias("own")).where("df > 1 and own").select("token")
    posts = materialize(posts.join(shared, "token"), "shared")
    ids = all_.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("id"))
    meeting = posts.select("class").distinct()
    signatures = all_.join(meeting, "class", "left_semi").groupBy("class").agg(
        F.first("n_shingles").alias("n"), F.first("band").alias("band"), F.first("signature").alias("signature")
    )
    signatures = materialize(signatures, "signatures")
    stars = materialize(_star_pairs(posts, signatures, params), "stars")

    def full(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        return materialize(_full_sets(docs, materialize(used.join(ids, "class"), "needed"), params), "sets")

    links = materialize(_verify(stars, full(stars), params), "links")
    joined = components(links)
    for nearest in (True, True, False):
        others = materialize(_other_pairs(posts, signatures, joined, params, nearest), "others")
        if others.isEmpty():
            continue
        more = materialize(_verify(others, full(others), params), "links")
        if not more.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = ids.join(joined.withColumnRenamed("node", "class"), "class").groupBy("component").agg(F.min("id").alias("least"))
    of_class = joined.join(named, "component").select(F.col("node").alias("class"), "least")
    own = ids.join(of_class, "class", "left").select("class", F.coalesce("least", "id").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "class").join(own, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
