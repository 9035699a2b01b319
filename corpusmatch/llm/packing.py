"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Lengths are integers up to the capacity, so the whole instance is a histogram with at most `capacity` bars,
whatever the size of the corpus. The plan is made on that histogram: sets that provably dominate every other
set with their largest member are fixed for good (Martello-Toth), the rest is packed best-fit decreasing.
The plan is a short list of slot ranges per length; documents get a rank among those of equal length, and with
it their sequence and offset. No task ever holds more than a slice of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.llm.common import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RANK_BITS = 48
_CACHED_WORDS = 700_000
_JOINED_WORDS = 500
_MARKS = ".,!?;:#*$%&"


class _Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes; ids of space-separated chunks are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.asarray(f.ids, "<u4").tobytes() for f in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks of letters, encoded as one text and cut where words end; one by one if a chunk isn't one word."""
        ids = np.frombuffer(self._each([" ".join(words)])[0], "<u4")
        stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(stops) != len(words):
            return self._each(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _learn(self, chunks: set[str]) -> None:
        words = [c for c in chunks if c.isalpha()]
        for at in range(0, len(words), _JOINED_WORDS):
            some = words[at : at + _JOINED_WORDS]
            self.known.update(zip(some, self._words(some), strict=True))
        other = [c for c in chunks if not c.isalpha()]
        if other:
            self.known.update(zip(other, self._each(other), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        # White space is dropped by this tokenizer and no token spans it, so chunks between blanks are independent.
        # Texts with the start of a special token go whole, as lower-casing could make one.
        split = [
            None if "<|" in t else (t if "Σ" in t else t.lower()).replace("\n", " ").split(" ") for t in texts
        ]
        if len(self.known) > _CACHED_WORDS:
            self.known = {"": b""}
        new = set().union(*(s for s in split if s is not None)).difference(self.known)
        # A run of marks after a letter is a word of its own, so `word,` is `word` and `,`.
        marked = {}
        for c in new:
            if c[-1] in _MARKS:
                head = c.rstrip(_MARKS)
                if head[-1:].isalpha():
                    marked[c] = head, c[len(head) :]
        plain = new.difference(marked).union(*marked.values()).difference(self.known)
        if plain:
            self._learn(plain)
        self.known.update((c, self.known[head] + self.known[tail]) for c, (head, tail) in marked.items())
        get = self.known.__getitem__
        return [
            self._each([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)
        ]


_encoders: dict[str, _Encoder] = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` ids of every document; a null text counts as empty and has the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encode = _encoders[tokenizer]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                ids = part.column("doc_id").to_pylist()
                for doc, data in zip(ids, encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    data += end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        one = data[start : start + 4 * capacity]
                        out.append((doc, k, start // 4, len(one) // 4, zlib.crc32(one)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


Group = tuple[int, list[tuple[int, int]]]  # number of alike sequences, and what each holds: (length, how many)


def reduce_dominated(count: np.ndarray, capacity: int) -> list[Group]:
    """Fix every set that dominates all feasible sets with the same largest member; `count` loses its members.

    A set dominates another if the other's members can be dealt to its own so that none is exceeded. With j the
    largest length left and w the largest that fits beside it, the sets fixed are
    - {j}, if nothing fits beside j;
    - {j, w}, if j + w fills the sequence: whatever else goes with j, its sum is at most w;
    - {j, w}, if no two lengths fit beside j, or at most two do and no two of them sum to more than w;
    - {j, w, b} with b the largest beside both, if at most two fit beside j and every pair with both members
      over b sums to w at most.
    Members only leave, so a proof holds for as many copies as there are.
    """
    fixed: list[Group] = []

    def take(*members: int) -> None:
        need = {m: members.count(m) for m in members}
        times = min(int(count[m]) // n for m, n in need.items())
        for m, n in need.items():
            count[m] -= times * n
        fixed.append((times, sorted(need.items(), reverse=True)))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                set_ = _dominating(count, capacity, j)
                if not set_:
                    break
                take(*set_)
                changed = True
    return fixed


def _dominating(count: np.ndarray, capacity: int, j: int) -> tuple[int, ...]:
    rest, room = count.copy(), capacity - j
    rest[j] -= 1
    lengths = np.flatnonzero(rest[: room + 1])
    if not lengths.size:
        return (j,)
    w = int(lengths[-1])
    if w == room:
        return (j, w)
    small: list[int] = []
    for x in lengths[:3]:
        small += [int(x)] * int(min(rest[x], 3))
    small = sorted(small)[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (j, w)
    if len(small) == 3 and sum(small) <= room:
        return ()

    def best_pair(over: int) -> int:
        """Largest sum within the room of two lengths that are both above `over`; 0 if there is none."""
        best, own = 0, lengths[lengths > over]
        for s in own:
            at = int(np.searchsorted(own, room - s, side="right")) - 1
            if at >= 0 and own[at] == s and rest[s] < 2:
                at -= 1
            if at >= 0 and own[at] >= s:
                best = max(best, int(s + own[at]))
        return best

    if w >= best_pair(0):
        return (j, w)
    beside = rest.copy()
    beside[w] -= 1
    third = np.flatnonzero(beside[: room - w + 1])
    if third.size and best_pair(int(third[-1])) <= w:
        return (j, w, int(third[-1]))
    return ()


def best_fit(count: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing of the lengths counted, all sequences that look alike at a time.

    A length goes to the open sequence with the least room for it. That sequence stays the best one for the next
    of the same length, so each takes as many as fit, which allows whole groups to be filled at once.
    """
    groups: list[list] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(count[length])
        if not left:
            continue
        for room in range(length, capacity):
            each = room // length
            while left and with_room[room]:
                g = with_room[room].pop()
                times, held = groups[g]
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                left -= full * each + rest
                parts = [(full, each), (int(rest > 0), rest), (times - full - (rest > 0), 0)]
                for n, new in parts:
                    if n:
                        groups.append([n, held + [(length, new)] if new else held])
                        with_room[room - new * length].append(len(groups) - 1)
                groups[g] = [0, []]
            if not left:
                break
        each = capacity // length
        for n, new in ((left // each, each), (int(left % each > 0), left % each)):
            if n:
                groups.append([n, [(length, new)]])
                with_room[capacity - new * length].append(len(groups) - 1)
    return [(n, held) for n, held in groups if n]


def packing_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first slot, first sequence, slots a sequence, offset), sorted by length and first slot."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    groups = reduce_dominated(count, capacity) + best_fit(count, capacity)
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for times, held in groups:
        offset = 0
        for length, each in held:
            rows.append((length, int(used[length]), sequence, each, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, rows_a_rank: int = 200_000
) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and its offset in it.

    docs: (doc_id, text, ...); other columns are ignored. Empty and null texts take one place (the end id); repeated
    rows are packed each for itself; an empty table gives no rows. Only documents longer than the capacity are cut.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only the histogram (at most `capacity`
    rows) reaches the driver, and the plan made from it (a few rows a length) goes back to the executors.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(packing_plan(histogram, capacity))
    # Few rows need few parts; a length that most pieces have is ranked in up to 64 parts, beyond that by its rows.
    n = sum(histogram.values())
    salts = max(1, min(64, n // 2000), n // rows_a_rank)
    row = ("doc_id", "piece", "ids_crc32", "start")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*row), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy(*row)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(starts, ["length", "salt"])
    ranked = ranked.select(*PIECES.replace(",", "").split()[::2], (F.col("rank") - 1 + F.col("before")).alias("slot"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, offset = plan.value.T
        keys = (length << _RANK_BITS) | first
        for batch in batches:
            own, slot = (batch.column(c).to_numpy() for c in ("length", "slot"))
            at = np.searchsorted(keys, (own << _RANK_BITS) | slot, side="right") - 1
            index = slot - first[at]
            columns = [*batch.columns[:-1], pa.array(sequence[at] + index // each[at])]
            columns.append(pa.array(offset[at] + index % each[at] * own))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
