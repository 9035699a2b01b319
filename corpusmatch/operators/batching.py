"""Requests of bounded size: ordered documents of a key grouped under a byte budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmatch.operators.storage import written


def byte_batches(df: DataFrame, key: str, order: str, text: Column, budget: int, query: Column | None = None) -> DataFrame:
    """(key, order, size, batch): consecutive documents share a batch while query and documents fit the budget.

    A document over the budget is alone in its batch, and so is every one if the query leaves no room; a null text
    has size 0. Rows with a null key are left out; of equal places the smaller document comes first.

    A key, however hot, is cut by many tasks. Rows are dealt to ranges of (key, order). What a range does to the bytes used
    when it begins is a function of few steps: it only matters at which row the first batch of its own begins, and from there
    all is fixed. Each range gives that function; one task a key runs through the functions of its ranges, not through its
    rows, and says what each range begins with; then every range is numbered by itself.
    """
    room = F.lit(budget) - F.coalesce(F.octet_length(query) if query is not None else F.lit(0), F.lit(0))
    sized = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.col(order).alias("order_"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), room.cast("long").alias("room"))
    ranged = written(sized.repartitionByRange("key_", "order_").withColumn("range", F.spark_partition_id()), "ranges")
    kind = ranged.schema["key_"].dataType.simpleString()
    dealt = ranged.repartition("range", "key_").sortWithinPartitions("range", "key_", "order_", "size")

    def functions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for where, owner, sizes, rooms in _segments(parts, "size", "room"):
            rows += [(*step, where, owner) for step in _steps(sizes, rooms)]
            if len(rows) >= _ROWS:
                yield pd.DataFrame(rows, columns=["over", "used", "new", "range", "key_"])
                rows = []
        yield pd.DataFrame(rows, columns=["over", "used", "new", "range", "key_"])

    steps_ = written(dealt.mapInPandas(functions, f"over long, used long, new long, range int, key_ {kind}"), "steps")

    def begins(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, batch, rows = object(), 0, -1, []
        for where, owner, over, ends, news in _segments(parts, "over", "used", "new"):
            if owner != now:
                now, used, batch = owner, _FIRST, -1
            rows.append((where, owner, used, batch))
            # The step with the greatest limit that `used` is over, or the last one, where no batch begins.
            at = int(np.argmax(used > over))
            used, batch = (used + int(ends[at]), batch) if news[at] == 0 else (int(ends[at]), batch + int(news[at]))
            if len(rows) >= _ROWS:
                yield pd.DataFrame(rows, columns=["range", "key_", "used", "batch"])
                rows = []
        yield pd.DataFrame(rows, columns=["range", "key_", "used", "batch"])

    ordered = steps_.repartition("key_").sortWithinPartitions("key_", "range", F.desc("over"))
    firsts = ordered.mapInPandas(begins, f"range int, key_ {kind}, used long, batch long")

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, used = object(), 0, 0
        for part in parts:
            out = []
            for where, owner, size, free, first, begun in zip(part["range"], part["key_"], part["size"], part["room"], part["used"], part["batch"], strict=True):
                if (where, owner) != at:
                    at, batch, used = (where, owner), begun, first
                if free <= 0 or used + size > free:
                    batch, used = batch + 1, size
                else:
                    used += size
                out.append(batch)
            yield part[["key_", "order_", "size"]].rename(columns={"key_": key, "order_": order}).assign(batch=out)

    schema = T.StructType([T.StructField(key, ranged.schema["key_"].dataType), T.StructField(order, ranged.schema["order_"].dataType), T.StructField("size", T.LongType()), T.StructField("batch", T.LongType())])
    both = ranged.join(firsts, ["range", "key_"]).repartition("range", "key_").sortWithinPartitions("range", "key_", "order_", "size")
    return both.select("range", "key_", "order_", "size", "room", "used", "batch").mapInPandas(number, schema)


#: Bytes used before the first row of a key: so many that it begins a batch.
_FIRST = 1 << 60


#: Rows that leave a task at once.
_ROWS = 10_000


def _segments(parts: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """range, key_ and the columns' values of one (range, key_) after another, from sorted parts that cut anywhere."""
    now, held = None, []
    for part in parts:
        ranges, owners = part["range"].to_numpy(), part["key_"].to_numpy()
        values = [part[c].to_numpy() for c in columns]
        cuts = (np.flatnonzero((ranges[1:] != ranges[:-1]) | (owners[1:] != owners[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if a == b:
                continue
            if held and (ranges[a], owners[a]) != now:
                yield (*now, *map(np.concatenate, zip(*held, strict=True)))
                held = []
            now = (ranges[a], owners[a])
            held.append([v[a:b] for v in values])
    if held:
        yield (*now, *map(np.concatenate, zip(*held, strict=True)))


def _steps(sizes: np.ndarray, rooms: np.ndarray) -> list[tuple[int, int, int]]:
    """(over, used, new) by falling `over`: begun with more than `over` bytes used, a range ends with `used` bytes and `new` batches begun.

    The last has new 0: the range fits into the batch before it, and adds `used` bytes. Steps with the same end are one.
    """
    total, n = np.cumsum(sizes), len(sizes)
    # Row k begins a batch if more than this was used before the range; no row is asked that comes after one that does.
    limit = np.minimum.accumulate(np.where(rooms > 0, rooms - total, -1))
    starts = np.flatnonzero(np.r_[True, limit[1:] < limit[:-1]])
    even = (rooms == rooms[0]).all() and rooms[0] > 0
    ends: dict[int, tuple[int, int]] = {}

    def end(k: int) -> tuple[int, int]:
        """Bytes used at the end, and batches begun, if one begins at k."""
        path = []
        while k not in ends:
            path.append(k)
            if even:
                nxt = int(np.searchsorted(total, total[k] - sizes[k] + rooms[0], "right"))
                nxt = max(nxt, k + 1)
            else:
                used, nxt = int(sizes[k]), k + 1
                while nxt < n and rooms[nxt] > 0 and used + sizes[nxt] <= rooms[nxt]:
                    used, nxt = used + int(sizes[nxt]), nxt + 1
            if nxt >= n:
                ends[k] = (int(total[-1] - total[k] + sizes[k]), 1)
                path.pop()
                break
            k = nxt
        for one in reversed(path):
            used, new = ends[k]
            ends[one] = (used, new + 1)
            k = one
        return ends[path[0]] if path else ends[k]

    out: list[tuple[int, int, int]] = []
    for k in starts.tolist():
        used, new = end(k)
        over = max(int(limit[k]), -1)
        if out and out[-1][1:] == (used, new):
            out[-1] = (over, used, new)
        else:
            out.append((over, used, new))
        if limit[k] < 0:
            return out
    return [*out, (-1, int(total[-1]), 0)]


def embed_texts(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(key, vector, error) of every row, the texts handed to the embedder `batch` at a time.

    A batch that the embedder fails on, or returns too few vectors for, has null vectors and says why, and is left for
    the next pass; a null text is embedded as empty. Each task calls the embedder for its own rows.
    """
    schema = T.StructType([df.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def one(texts: list[str]) -> tuple[list, str | None]:
        try:
            vectors = embedder(texts)
        except Exception as failed:  # whatever a caller's embedder raises concerns this batch alone
            return [None] * len(texts), f"{type(failed).__name__}: {failed}"
        if len(vectors) != len(texts):
            return [None] * len(texts), f"{len(vectors)} vectors for {len(texts)} texts"
        return list(vectors), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors, error = one(["" if v is None else v for v in part.column(text).to_pylist()])
                columns = [part.column(key), pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "vector", "error"])

    return df.select(key, text).mapInArrow(run, schema)
