"""Quality model, source divergence and phrases: against brute force in plain Python, on held-out labels and on awkward rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmatch.llm import divergence, gam, phrases, queries, tokens

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, rank int, n long, words string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Few words, many ways to part them; nulls, empty texts, repeated rows, one very long text, clashing column names."""
    rng = np.random.default_rng(0)
    words = ["an", "An", "ANT", "Ünder", "ünder", "a1b", "x y", "日本", "日", "é", "anthem", "antique", "q"]
    marks = [" ", " ", " ", "\t", ". ", ",", "\n", "\r", "\x0b", "\x00", "  ", "-", "\x85 "]
    rows = []
    for k in range(120):
        n = 6000 if k == 7 else int(rng.integers(0, 40))
        text = "".join(str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(n))
        lang, source = [None, "", "en", "fr"][k % 4], [None, "", "s", "t", "only"][k % 5] if k % 4 < 3 else "lone"
        rows.append((k, None if k % 17 == 0 else text, lang, source, 1, 2, "x"))
    rows += [rows[3]] * 5 + [(None, "an ant an ant", "de", "s", None, None, None), (500, "", "it", "a", 1, 1, ""), (501, None, "it", "b", 1, 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_of_a_batch():
    texts = ["ab c", None, "", "d", "e. f\tgé", " ", "é"]
    data, begins = tokens.bytes_of(pa.array(["skip", *texts, "rest"]).slice(1, len(texts)))
    found = tokens.cut(data, begins, ~tokens.byte_class(b" \t."), tokens.byte_class(b"."))
    assert [w.decode() for w in found.words.to_pylist()] == ["ab", "c", "d", "e", "f", "gé", "é"]
    assert found.text.tolist() == [0, 0, 3, 4, 4, 4, 6] and len(set(found.piece.tolist())) == 5
    number, values = tokens.groups_of(pa.array(["a", None, "a"]), pa.array(["x", "x", None]))
    assert [values[k] for k in number] == [("a", "x"), (None, "x"), ("a", None)]
    parts = [p.num_rows for p in tokens.steps(iter([pa.RecordBatch.from_pydict({"text": ["x" * (3 << 20)] * 5 + ["y" * (9 << 20), ""]})]))]
    assert sum(parts) == 7 and len(parts) >= 3


def brute_phrases(rows, params):
    counts, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, params.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    kept = {k: v for k, v in counts.items() if v >= params.least}
    out = {}
    for (lang, words), a in kept.items():
        if len(words) < 2:
            continue
        score, _, left, right = min((1000 * a * total[lang] // (kept[lang, words[:k]] * kept[lang, words[k:]]), k, kept[lang, words[:k]], kept[lang, words[k:]]) for k in range(1, len(words)))
        inside = any(x == lang and len(w) > len(words) and params.covered * a <= 100 * f and any(w[i : i + len(words)] == words for i in range(len(w))) for (x, w), f in kept.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, total[lang]))
    return {(lang, i + 1, p.decode(), -a, x, y, n, -s) for lang, found in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(found)[: params.top])}


@pytest.mark.parametrize("params", [phrases.Params(least=3, top=40), phrases.Params(least=2, covered=80, top=10_000), phrases.Params(least=5, longest=3)])
def test_phrases(awkward, params, monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 2000)
    got = phrases.collocations(awkward, params).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute_phrases(awkward.collect(), params)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20 and got.count() == len(want)
    assert phrases.collocations(awkward.where("false")).isEmpty() and phrases.collocations(awkward.where("lang = 'it'")).isEmpty()


def test_windows_only_of_what_may_be_frequent(spark):
    """Infrequent hashes hardly pass the bitmap of frequent ones, and words make no windows, but are counted."""
    rng = np.random.default_rng(4)
    own, others = (rng.integers(-(2**63), 2**63 - 1, n) for n in (60_000, 200_000))
    often = phrases._bitmap(spark.createDataFrame(pa.table({"hash": own})))
    assert often.has(own).all() and often.has(others).mean() < 0.001
    words = " ".join(f"w{k}" for k in rng.integers(0, 100, 12_000))
    docs = spark.createDataFrame([(f"{words}. " + "aa bb cc. " * 120, "en")], "text string, lang string")
    counts = phrases.word_counts(docs).where("n >= 100")
    often = phrases._bitmap(counts)
    pairs = phrases._bitmap(phrases.pair_counts(docs, often).where("n >= 100"))
    threes = phrases._bitmap(phrases.triple_counts(docs, often, pairs).where("n >= 100"))
    found = phrases.windows(docs, often, pairs, threes, 5).collect()
    assert {(r.w1, r.w2, r.w3, r.w4, r.n) for r in found} == {("aa", "bb", "cc", "", 120), ("bb", "cc", "", "", 120)}
    assert {tuple(r.words) for r in phrases.phrase_counts(docs)[0].collect()} == {(r.word,) for r in counts.collect()} | {("aa", "bb"), ("bb", "cc"), ("aa", "bb", "cc")}


def brute_audit(rows, params):
    groups, docs = {}, {}
    for r in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r.text)))
        groups.setdefault((r.lang or "", r.source or ""), Counter()).update(found)
        docs.setdefault(r.lang or "", Counter()).update(found.keys())
    out = set()
    for lang, seen in docs.items():
        kept = sorted((t for t, n in seen.items() if n >= params.least_docs), key=str.encode)
        share = lambda c: {t: 1 + params.scale * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {s: c for (x, s), c in groups.items() if x == lang}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode()) for u in own if u != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[: params.top]
            out |= {(lang, s, kind, i.decode(), -v, k + 1) for kind, rows_ in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(rows_)}
    return out


@pytest.mark.parametrize("params", [divergence.Params(least_docs=3, first=1), divergence.Params(least_docs=10, first=2, top=3), divergence.Params()])
def test_divergence(awkward, params, monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 2000)
    got = divergence.audit(awkward, params).select("lang", "source", "part", "item", "value", "rank")
    want = brute_audit(awkward.collect(), params)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and ("it", "a", "pair", "b", 0, 1) in want
    assert divergence.audit(awkward.where("false"), params).isEmpty()


def test_prefixes_are_left_out_before_their_terms(awkward):
    """The pass after the first counts only what extends a kept prefix."""
    docs = divergence._filled(awkward)
    first = divergence.prefix_counts(docs, 0, 1, None).where("n >= 60 and not whole")
    kept = divergence._bitmap(first, first.count(), "prefix")
    every, less = (divergence.prefix_counts(docs, 1, 2, b).select("lang", "prefix").distinct() for b in (None, kept))
    begun = {(r.lang, bytes(r.prefix)) for r in first.collect()}
    assert {(r.lang, bytes(r.prefix)) for r in less.collect()} == {(r.lang, bytes(r.prefix)) for r in every.collect() if (r.lang, bytes(r.prefix)[:1]) in begun}
    assert less.count() < every.count()


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_phrase_collocations"])
def test_twins(spark, name):
    data = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetch_df()
    got = queries.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 50
    assert {tuple(r) for r in got[want.columns].itertuples(index=False)} == {tuple(r) for r in want.itertuples(index=False)}


def plain_figures(text):
    """Some of the figures, word by word."""
    words = text.split()
    n = max(1, len(words))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x]
    size = lambda w: len(w.encode())
    return {
        "log_words": np.log1p(len(words)), "word_bytes": sum(map(size, words)) / n, "longest_word": np.log1p(max(map(size, words), default=0)),
        "distinct_words": len(set(words)) / n, "same_as_last": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "commonest_word": max(Counter(words).values(), default=0) / n, "repeated_triples": 1 - len(set(triples)) / max(1, len(triples)) if triples else 0,
        "symbol_ends": sum(w[-1] in "#*$%&|<>=_~^{}[]\\/@+`" for w in words) / n, "inner_capitals": sum(any("A" <= c <= "Z" for c in w[1:]) for w in words) / n,
        "shouts": sum(map(text.count, "!?")) / n, "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "words_a_line": np.log1p(len(words) / max(1, len(lines))),
    }


def test_figures_of_texts():
    texts = ["one two two Two! iPod\nsame\nsame\n\n", "a", "é# b$ c", "x y z x y z x y z", "last|"]
    got = gam.features(pa.array([None, "", " \n ", *texts]))
    assert not got[:3].any() and np.isfinite(got).all()
    for row, text in zip(got[3:], texts, strict=True):
        own = dict(zip(gam.FEATURES, row, strict=True))
        for name, value in plain_figures(text).items():
            assert own[name] == pytest.approx(value), (name, text)
    assert np.allclose(gam.features(pa.array(texts[::-1]))[::-1], got[3:])


def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = (x[:, 1] * x[:, 2] > 0).astype(np.int64)  # neither figure says anything alone
    model = gam.learn(x, y, np.ones(len(y)))
    fresh = rng.normal(size=(2000, 4))
    truth = fresh[:, 1] * fresh[:, 2] > 0
    alone = gam.learn(x, (np.abs(x[:, 0]) > 1).astype(np.int64), np.ones(len(y)))
    assert ((alone.scores(fresh) > 0.5) == (np.abs(fresh[:, 0]) > 1)).mean() > 0.97
    assert model.pairs[0][:2] == (1, 2) and ((model.scores(fresh) > 0.5) == truth).mean() > 0.9
    assert gam.learn(x, np.ones(4000, np.int64), np.ones(4000)).scores(x[:2]).min() > 0.99
    assert gam.learn(x[:0], y[:0], np.ones(0)).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_model_on_held_out_labels(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    first, again = (queries.op11_quality_model(spark, data).orderBy("doc_id").toPandas() for _ in range(2))
    assert first.equals(again) and first.score.between(0, 1).all() and len(first) == 1000
    out = first.merge(labels.toPandas(), on="doc_id")
    out = out[out.held_out]
    good = out[out.quality == 1].score.to_numpy()
    bad = out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.98 and (good >= 0.3).mean() > 0.97 and (bad >= 0.3).mean() < 0.25


def test_quality_model_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(None, 1), (1, None), (2, 1), (2, 1)], "doc_id long, quality int")
    model = gam.fit(awkward, labels, gam.Params(docs=40))
    out = gam.score(awkward, model)
    assert out.count() == awkward.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert gam.score(awkward.where("false"), model).isEmpty()
    assert {r.score for r in gam.score(awkward, gam.fit(awkward, labels.where("false"))).collect()} == {0.5}
    assert {r.score for r in gam.score(awkward, gam.fit(awkward.where("false"), labels)).collect()} == {0.5}
    shapes = gam.lookup_tables(spark, model)
    assert {r.feature for r in shapes.select("feature").distinct().collect()} == set(gam.FEATURES)
    assert shapes.groupBy("feature").agg(F.count_if(F.col("low").isNull()).alias("n")).where("n <> 1").isEmpty()
