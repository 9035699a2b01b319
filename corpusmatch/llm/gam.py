"""Quality classifier: a generalised additive model with pairwise interactions over figures of the whole text.

Each figure is cut into bins at its quantiles. Boosting goes round all figures in turn, each time fitting a tree of at
most four leaves on one figure's bins and adding its leaves to that figure's lookup table; then the pairs of figures whose
joint cuts explain most of what is left get tables of their own in the same way. A held-out part of the sample says when
to stop. A score is a sum of table entries, looked up for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmatch.llm.common import sample_cut
from corpusmatch.llm.tokens import byte_class, bytes_of, cut, steps

FEATURES = (
    "log_words", "word_bytes", "word_spread", "longest_word", "upper", "symbols", "digits", "marks", "shouts", "non_ascii", "letters", "controls",
    "byte_entropy", "distinct_words", "same_as_last", "commonest_word", "repeated_triples", "symbol_ends", "inner_capitals", "words_a_sentence",
    "words_a_line", "short_lines", "repeated_lines",
)

_SPACE = byte_class(b" \t\n\r\x0b\x0c")
_UPPER, _DIGIT = byte_class(bytes(range(65, 91))), byte_class(b"0123456789")
_LETTER = _UPPER | byte_class(bytes(range(97, 123))) | (np.arange(256) > 127)
_MARK, _SHOUT, _STOP = byte_class(b".,;:!?'\"()-"), byte_class(b"!?"), byte_class(b".!?")
_SYMBOL = byte_class(b"#*$%&|<>=_~^{}[]\\/@+`")
_CONTROL = byte_class(bytes([*range(9), *range(14, 32), 127]))
_NOT_LINE_END = ~byte_class(b"\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    #: Labelled documents of each class to learn from, those with the smallest hashes of their ids.
    docs: int = 10_000
    bins: int = 32
    #: Bins of a figure in the table of a pair.
    pair_bins: int = 12
    pairs: int = 10
    rate: float = 0.1
    rounds: int = 300
    #: Rounds without a smaller loss on the held-out fifth of the sample that end the boosting.
    patience: int = 25
    ridge: float = 2.0
    threshold: float = 0.3


def _per_text(mask: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return (total[begins[1:]] - total[begins[:-1]]).astype(float)


def _repeats(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: distinct keys, and the greatest count of one."""
    pairs = np.empty(len(key), [("text", np.int64), ("key", key.dtype)])
    pairs["text"], pairs["key"] = text, key
    order = np.lexsort((key, text))
    pairs = pairs[order]
    if not len(pairs):
        return np.zeros(n), np.zeros(n)
    new = np.r_[True, (pairs["text"][1:] != pairs["text"][:-1]) | (pairs["key"][1:] != pairs["key"][:-1])]
    at = np.flatnonzero(new)
    times, owner = np.diff(np.r_[at, len(pairs)]), pairs["text"][at]
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text; a null, empty or blank one has zeros. All of each text counts."""
    data, begins = bytes_of(texts)
    n, size = len(texts), np.diff(begins).astype(float)
    words = cut(data, begins, ~_SPACE)
    ids, distinct = words.encoded()
    ends = np.frombuffer(words.words.buffers()[1], np.int64)
    kept = np.frombuffer(words.words.buffers()[2] or b"", np.uint8)
    length, text = np.diff(ends).astype(float), words.text
    count = lambda mask: _per_text(mask[data], begins)
    n_words = np.bincount(text, minlength=n).astype(float)
    per_word, solid = np.maximum(n_words, 1), np.maximum(size - count(_SPACE), 1)
    letters = count(_LETTER)
    mean = np.bincount(text, length, n) / per_word
    longest = np.zeros(n)
    np.maximum.at(longest, text, length)
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, n) / per_word - mean**2, 0))
    kinds, most = _repeats(text, ids, n)
    same = np.bincount(text[1:], (ids[1:] == ids[:-1]) & (text[1:] == text[:-1]), n) if len(ids) else np.zeros(n)
    inside = np.flatnonzero(text[2:] == text[:-2]) if len(ids) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        wide = ids.astype(np.uint64) + np.uint64(1)
        triple = (((wide[inside] * _MIX) ^ wide[inside + 1]) * _MIX ^ wide[inside + 2]) * _MIX
    triples, _ = _repeats(text[inside], triple, n)
    n_triples = np.bincount(text[inside], minlength=n)
    edge_ends = np.bincount(text, _SYMBOL[kept[ends[1:] - 1]], n) if len(ids) else np.zeros(n)
    inner = _UPPER[kept]
    if len(ids):
        inner[ends[:-1]] = False
    running = np.r_[0, np.cumsum(inner)]
    capitals = np.bincount(text, running[ends[1:]] > running[ends[:-1]], n) if len(ids) else np.zeros(n)
    share = np.bincount((np.repeat(np.arange(n), size.astype(np.int64)) << 8) + data, minlength=n << 8).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    lines = cut(data, begins, _NOT_LINE_END)
    line_ids, _ = lines.encoded()
    n_lines = np.bincount(lines.text, minlength=n).astype(float)
    line_sizes = np.diff(np.frombuffer(lines.words.buffers()[1], np.int64))
    different, _ = _repeats(lines.text, line_ids, n)
    short = np.bincount(lines.text, line_sizes < 20, n)
    per_line = np.maximum(n_lines, 1)
    columns = [
        np.log1p(n_words), mean, spread, np.log1p(longest), count(_UPPER) / np.maximum(letters, 1), count(_SYMBOL) / per_word, count(_DIGIT) / solid,
        count(_MARK) / per_word, count(_SHOUT) / per_word, count(np.arange(256) > 127) / solid, letters / solid, count(_CONTROL) / solid,
        entropy, kinds / per_word, same / per_word, most / per_word, (n_triples - triples) / np.maximum(n_triples, 1), edge_ends / per_word, capitals / per_word,
        np.log1p(n_words / np.maximum(count(_STOP), 1)), np.log1p(n_words / per_line), short / per_line, (n_lines - different) / per_line,
    ]
    return np.where((n_words > 0)[:, None], np.stack(columns, 1), 0.0)


@dataclass
class Model:
    """edges: upper ends of each figure's bins. tables: what each bin adds. pairs: (figure, figure, bins of pair by bin of each, table)."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    params: Params = Params()

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[codes[:, j]]
        for j, k, to_j, to_k, table in self.pairs:
            z += table[to_j[codes[:, j]], to_k[codes[:, k]]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g**2 / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Steps of a tree of depth two on bins with the sums g and h: one value a bin."""

    def best(a: int, b: int) -> int | None:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return None
        gain = _gain(left_g, left_h, ridge) + _gain(g[a:b].sum() - left_g, h[a:b].sum() - left_h, ridge)
        at = int(gain.argmax())
        return a + at + 1 if gain[at] > _gain(g[a:b].sum(), h[a:b].sum(), ridge) + 1e-12 else None

    cuts, root = {0, len(g)}, best(0, len(g))
    if root:
        cuts |= {root, best(0, root), best(root, len(g))} - {None}
    out, ends = np.zeros(len(g)), sorted(cuts)
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes at once: its gain, and its four steps as a table."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    sums = []
    for x in (g, h):
        c = x.cumsum(0).cumsum(1)
        a, right, down, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        sums.append((a, right - a, down - a, total - right - down + a))
    gain = sum(_gain(x, y, ridge) for x, y in zip(*sums, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps_ = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*sums, strict=True)]
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = steps_
    return float(gain[i, j] - _gain(g.sum(), h.sum(), ridge)), table


def _loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, z) - y * z)).sum())


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: Params = Params()) -> Model:
    """Model from figures x, classes y (0, 1) and weights of the rows. Every fifth row is held out to say when to stop."""
    share = float(np.clip((weight * y).sum() / weight.sum() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(bias, params=params)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Model(bias, edges, [np.zeros(len(e) + 1) for e in edges], [], params)
    codes, test = model.codes(x), np.arange(len(y)) % 5 == 4
    z, inside = np.full(len(y), bias), weight * ~test

    def boost(parts: list[tuple[np.ndarray, np.ndarray]], step) -> None:
        """parts: each row's place in a table (flat), and the table. step: sums of a table's bins to what it adds."""
        nonlocal z
        least, since, kept = _loss(z[test], y[test], weight[test]), 0, [t.copy() for _, t in parts]
        for _ in range(params.rounds):
            for place, table in parts:
                p = 1 / (1 + np.exp(-z))
                g = np.bincount(place, inside * (y - p), table.size).reshape(table.shape)
                h = np.bincount(place, inside * p * (1 - p), table.size).reshape(table.shape)
                add = params.rate * step(g, h)
                table += add
                z = z + add.ravel()[place]
            now = _loss(z[test], y[test], weight[test])
            if now < least - 1e-6 * abs(least):
                least, since, kept = now, 0, [t.copy() for _, t in parts]
            else:
                since += 1
                if since >= params.patience:
                    break
        for (place, table), best in zip(parts, kept, strict=True):
            z = z + (best - table).ravel()[place]
            table[:] = best

    boost([(codes[:, j], t) for j, t in enumerate(model.tables) if len(t) > 1], lambda g, h: _tree(g, h, params.ridge))
    p = 1 / (1 + np.exp(-z))
    residual, curve = inside * (y - p), inside * p * (1 - p)
    coarse = [np.arange(len(t)) * min(len(t), params.pair_bins) // len(t) for t in model.tables]
    found = []
    for j in range(len(edges)):
        for k in range(j + 1, len(edges)):
            shape = (coarse[j][-1] + 1, coarse[k][-1] + 1)
            place = coarse[j][codes[:, j]] * shape[1] + coarse[k][codes[:, k]]
            sums = (np.bincount(place, v, shape[0] * shape[1]).reshape(shape) for v in (residual, curve))
            found.append((_quarters(*sums, params.ridge)[0], j, k, place, shape))
    found = [f for f in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[: params.pairs] if f[0] > 0]
    model.pairs = [(j, k, coarse[j], coarse[k], np.zeros(shape)) for _, j, k, _, shape in found]
    boost([(f[3], m[4]) for f, m in zip(found, model.pairs, strict=True)], lambda g, h: _quarters(g, h, params.ridge)[1])
    # The mean of each table goes to the bias, so a table says how its figure differs from the usual.
    for j, table in enumerate(model.tables):
        usual = float((weight * table[codes[:, j]]).sum() / weight.sum())
        table -= usual
        model.bias += usual
    return model


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, figures) of (doc_id, quality, text), in one pass over whole texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            x = features(part.column("text"))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), own], ["doc_id", "quality", "figures"])

    return docs.select("doc_id", "quality", "text").mapInArrow(measure, "doc_id long, quality int, figures array<double>")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Model of labels (doc_id, quality), from at most `docs` labelled documents of each class, whole texts.

    The ids of the sample are broadcast and its figures come to the driver, 23 numbers a document, both bounded by twice
    `docs`. Weights make the classes as frequent as among all labels. Null labels and ids are passed over; with one class
    every text scores its share, without labels 0.5; rows with one id and both labels count for both.
    """
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    total = {r.quality: r["count"] for r in own.groupBy("quality").count().collect()}
    few = F.broadcast(sample_cut(own, F.col("doc_id"), params.docs, "quality"))
    found = _measured(docs.select("doc_id", "text").join(few, "doc_id")).toPandas()
    if not len(found):
        return Model(0.0, params=params)
    found["order"] = [tuple(x) for x in found["figures"]]
    found = found.sort_values(["doc_id", "quality", "order"])
    y = found["quality"].to_numpy(np.int64)
    weight = np.array([total.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)])[y]
    return learn(np.stack(found["figures"].to_list()), y, weight / weight.mean(), params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: from 0 to 1, and 1 where it reaches the threshold; one pass, no shuffle.

    A null, empty or blank text scores what figures of zero give. Repeated rows each give a row; other columns are not
    looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in steps(batches):
            found = own.scores(features(part.column("text")))
            columns = [part.column("doc_id"), pa.array(found), pa.array((found >= own.params.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double, predicted int")


def lookup_tables(spark: SparkSession, model: Model) -> DataFrame:
    """What the model adds for each figure from `low` (exclusive) up to `high`: (feature, low, high, adds). Pairs of figures are left out."""
    rows = []
    for name, edges, table in zip(FEATURES, model.edges, model.tables, strict=False):
        ends = [None, *map(float, edges), None]
        rows += [(name, ends[k], ends[k + 1], float(v)) for k, v in enumerate(table)]
    return spark.createDataFrame(rows, "feature string, low double, high double, adds double")
