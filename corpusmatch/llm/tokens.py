"""Words of many texts at once: byte classes over the Arrow buffer of a batch, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step looks at; a longer text is a step of its own.
STEP = 4 << 20
#: A-Z to a-z, all other bytes as they are, so bytes of longer characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members: bytes) -> np.ndarray:
    """Which of the 256 bytes are members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


@dataclass(frozen=True)
class Words:
    """Words of the texts, in order. text: the number of the text a word stands in; piece: changes where a break lies between two words."""

    words: pa.LargeBinaryArray
    text: np.ndarray
    piece: np.ndarray

    def lengths(self) -> np.ndarray:
        """Bytes of each word."""
        ends = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        return np.diff(ends)

    def where(self, keep: np.ndarray) -> Words:
        """The words that are marked."""
        return Words(self.words.filter(pa.array(keep)), self.text[keep], self.piece[keep])

    def encoded(self) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """The number of each word in the list of distinct words, and that list."""
        found = self.words.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and where each begins, with the end of the last. A null is an empty text."""
    plain = texts.cast(pa.large_string())
    if plain.null_count:
        plain = plain.fill_null("")
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def cut(data: np.ndarray, begins: np.ndarray, in_word: np.ndarray, is_break: np.ndarray | None = None) -> Words:
    """Longest runs of bytes of `in_word`; none crosses the end of a text."""
    inside = in_word[data]
    follows = np.zeros(len(data) + 1, bool)  # bytes that go on with the word of the byte before
    follows[1:-1] = inside[1:] & inside[:-1]
    follows[begins] = False
    starts = np.flatnonzero(inside & ~follows[:-1])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(inside & ~follows[1:]) - starts + 1, out=offsets[1:])
    kept = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    text = np.repeat(np.arange(len(begins) - 1), np.diff(np.searchsorted(starts, begins)))
    piece = text if is_break is None else np.cumsum(is_break[data], dtype=np.int32)[starts] + text
    return Words(words, text, piece)


def distinct(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes under `most`, in order, and how often each is there; without sorting, if `most` isn't far over their number."""
    if most <= 8 * len(codes) + (1 << 20):
        n = np.bincount(codes, minlength=most)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(codes, return_counts=True)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches with some STEP bytes of text each, so memory is bounded whatever a batch holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, begins = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + STEP, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def added_up(tables: Iterator[pa.Table], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Rows of all tables with equal values in all columns but the last, `n`, as one row with their sum; a task's rows together,
    but for `most` of them at once. What several tasks have of a row is left to be added."""
    waiting: list[pa.Table] = []
    for table in tables:
        waiting.append(table)
        if sum(map(len, waiting)) > most:
            waiting = [_summed(waiting)]
            if len(waiting[0]) > most // 2:
                yield from waiting.pop().to_batches(max_chunksize=50_000)
    if waiting:
        yield from _summed(waiting).to_batches(max_chunksize=50_000)


def _summed(tables: list[pa.Table]) -> pa.Table:
    names = tables[0].column_names
    if len(tables) == 1:
        return tables[0]
    return pa.concat_tables(tables).group_by(names[:-1]).aggregate([("n", "sum")]).rename_columns(names)


def groups_of(*columns: pa.Array) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's group of equal values, and the values of each group."""
    number, values = np.zeros(len(columns[0]), np.int64), [()]
    for column in columns:
        found = column.dictionary_encode(null_encoding="encode")
        code, own = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
        distinct, number = np.unique(number * max(1, len(own)) + code, return_inverse=True)
        values = [(*values[d // max(1, len(own))], own[d % max(1, len(own))]) for d in distinct.tolist()]
    return number, values
