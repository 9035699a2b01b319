"""Quality rules: base counts of a text and compression bands over the whole text and over fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.llm.common import sample_cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
SCHEMA += ", base_failed boolean, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, kept boolean"
_WINDOW = 8
_SPACE = " \t\n\r\v\f"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size, which falls with the size of a text: (bytes, low, high) at growing sizes.

    Between two sizes the limits lie on the line over the logarithm of the size. These are wide, for text of any kind;
    `fit` finds those of a corpus with labels.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (16, 0.0, 9.9),
        (64, 0.40, 1.10),
        (128, 0.40, 0.98),
        (256, 0.36, 0.88),
        (512, 0.32, 0.78),
        (1024, 0.30, 0.72),
        (4096, 0.28, 0.66),
        (16384, 0.26, 0.62),
        (131072, 0.22, 0.62),
    )
    chunk_size: int = 4096
    chunk: tuple[float, float] = (0.20, 0.72)
    #: A text is rejected if more than this share of its chunks lies on one side of the chunk limits.
    chunk_share: float = 0.3
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        at, low, high = np.array(self.whole).T
        place = np.log2(max(size, 1))
        return float(np.interp(place, np.log2(at), low)), float(np.interp(place, np.log2(at), high))


@dataclass(frozen=True)
class FitParams:
    #: Good documents to fit the bands on, those with the smallest hashes of their ids.
    docs: int = 20_000
    #: Good documents that a size needs for limits of its own.
    least_docs: int = 20
    #: Distance of the limits from the middle, in standard deviations; for chunks, whose content varies more, this times two.
    width: float = 4.0


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that stand in a window of eight words found twice or more. hashes: one 64-bit value per word."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(_WINDOW):
            key = (key ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    # Equal windows have equal keys; the windows that share a key are compared word by word.
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    found = np.zeros(n + _WINDOW, np.int64)
    for at in np.flatnonzero(hit).tolist():
        window = tuple(words[at : at + _WINDOW])
        if window in seen:
            for start in {seen[window], at}:
                found[start] += 1
                found[start + _WINDOW] -= 1
        else:
            seen[window] = at
    return int((np.cumsum(found) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly space and \t \n \v \f \r
    lines = [x for x in data.split(b"\n") if x.strip()]
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
    )


def compression(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, int, bool]:
    """Ratio of the whole text (null if empty), chunks, those under and over their limits, and the verdict.

    Chunks follow each other from the start of a text that fills one; the last one ends with the text, so every byte
    is in a chunk.
    """
    if not data:
        return None, 0, 0, 0, False
    ratio = len(packer.compress(data)) / len(data)
    low, high = bands.limits(len(data))
    size, last = bands.chunk_size, len(data) - bands.chunk_size
    starts = sorted({*range(0, last + 1, size), last}) if last >= 0 else ()
    parts = [len(packer.compress(data[s : s + size])) / size for s in starts]
    under, over = sum(p < bands.chunk[0] for p in parts), sum(p > bands.chunk[1] for p in parts)
    most = bands.chunk_share * len(parts)
    return ratio, len(parts), under, over, low <= ratio <= high and under <= most and over <= most


def bands_of(sizes: np.ndarray, ratios: np.ndarray, bands: Bands = Bands(), params: FitParams = FitParams()) -> Bands:
    """Bands from sizes and ratios of good texts: at every half octave with enough of them the ratio is a line over the
    logarithm of the size, and the limits lie `width` deviations (from the median one) to its sides. Sizes well outside those seen keep the limits of `bands`."""
    logs, found = np.log2(np.maximum(sizes, 1)), []
    for at in np.arange(4, 32, 0.5):
        near = np.abs(logs - at) < 0.5
        if near.sum() < params.least_docs or np.ptp(logs[near]) == 0:
            continue
        slope, middle = np.polyfit(logs[near] - at, ratios[near], 1)
        rest = ratios[near] - middle - slope * (logs[near] - at)
        wide = params.width * max(1.4826 * float(np.median(np.abs(rest - np.median(rest)))), 1e-3)
        found.append((2.0**at, float(middle) - wide, float(middle) + wide))
    if not found:
        return bands
    first, last = found[0][0], found[-1][0]
    own = replace(bands, whole=tuple(sorted([*found, *(w for w in bands.whole if w[0] < first / 1.5 or w[0] > 4 * last)])))
    if not first <= bands.chunk_size <= last:
        return own
    low, high = own.limits(bands.chunk_size)
    return replace(own, chunk=((3 * low - high) / 2, (3 * high - low) / 2))


def fit(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), params: FitParams = FitParams()) -> Bands:
    """Bands from the documents that labels (doc_id, quality) call good (1), read from a bounded sample of whole texts.

    At most `docs` ids are broadcast, and as many sizes and ratios reach the driver. Documents that fail the base
    rules are passed over; without good ones the given bands stay.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = F.broadcast(sample_cut(good, F.col("doc_id"), params.docs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out = [(0, 0.0)][:0]
            for text in batch.column("text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                if not base_failed(base_counts(text or "")):
                    out.append((len(data), len(packer.compress(data)) / len(data)))
            sizes, ratios = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())], ["size", "ratio"])

    found = docs.select("doc_id", "text").join(few, "doc_id", "left_semi").select("text").mapInArrow(measure, "size long, ratio double").toPandas()
    return bands_of(found["size"].to_numpy(), found["ratio"].to_numpy(), bands, params)


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts and verdict of every whole text, in one pass and without a shuffle.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and the
    compression ratios lie within their bands. A null or empty text has no words: base_failed, a null ratio, not
    kept. Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out = []
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                counts = base_counts(text or "")
                failed = base_failed(counts)
                *ratios, within = compression((text or "").encode("utf-8", "surrogatepass"), bands, packer)
                out.append((doc, *counts, failed, *ratios, within and not failed))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64()] + [pa.int64()] * 3 + [pa.bool_()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
