"""Queries over whole small tables against plain Python, row by row, and operators on rows that few tests have."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmatch.llm import ann, common, jaccard, language_id, packing, pii, queries, sql, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_counts_on_all_documents(spark, documents):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, DATA).collect()}
    for doc in documents.collect():
        text = doc.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got.pop(doc.doc_id)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert not got


def test_languages_text_by_text(spark, documents):
    """Every text scored alone, bit by bit, against the query over all of them."""
    learned = [r for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    filters = language_id.fit(documents.where(common.crc_mod("doc_id", 5) > 0))
    assert filters.languages == sorted({r.lang for r in learned if r.lang})
    got = {r.doc_id: r for r in queries.op3_language_id(spark, DATA).collect()}
    for doc in documents.collect():
        found, _ = language_id.grams([doc.text or ""])
        r = got[doc.doc_id]
        assert r.held_out == (zlib.crc32(str(doc.doc_id).encode()) % 5 == 0)
        if not len(found):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        shares = []
        for i in range(len(filters.languages)):
            holds = np.ones(len(found), bool)
            for at in language_id._slots(found, filters.hashes, filters.slots.shape[1]):
                holds &= (filters.slots[i // 64][at.astype(np.int64)] >> np.uint64(i % 64)) & np.uint64(1) > 0
            rate = filters.false_rate[i]
            shares.append(min(1.0, max(0.0, (holds.sum() / len(found) - rate) / (1 - rate))))
        assert r.lang_pred == filters.languages[int(np.argmax(shares))] and r.score == pytest.approx(max(shares))
    for i, lang in enumerate(filters.languages):  # a filter has no false negatives
        texts = [r.text for r in learned if r.lang == lang and r.text]
        often = Counter(language_id.grams(texts)[0].tolist()).most_common(50)
        kept = filters.hits(np.array([g for g, _ in often], np.uint64), np.zeros(50, np.int64), 1)[0, i]
        assert kept == 50


def test_toxicity_text_by_text(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = queries.toxicity_model(documents, labels)
    got = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    for doc in documents.collect():
        words = (doc.text or "").split()
        total = 0.0
        for word in words:
            buckets, _ = toxicity.subwords([word], model.params)
            total += model.logit[buckets].mean()
        z = total / (len(words) + model.params.padding) + model.bias
        assert got[doc.doc_id].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert got[doc.doc_id].predicted == int(got[doc.doc_id].score >= 0.7)
    assert {r.score for r in toxicity.score(documents, toxicity.fit(documents.join(labels.where("false").select("doc_id", "toxic"), "doc_id"))).collect()} == {0.5}


def test_surrogates_text_by_text(spark, documents):
    """Nothing but entities changes; each entity has one surrogate in all documents, and no two share one."""
    out = {r.doc_id: r for r in queries.op8_pii_surrogates(spark, DATA).collect()}
    given, changed = {}, 0
    for doc in documents.collect():
        r, found = out[doc.doc_id], pii.mentions(doc.text)
        assert r.n_entities == len(found)
        if not found:
            assert r.text == doc.text
            continue
        changed += 1
        at, upto = 0, 0
        for k, m in enumerate(found):
            between = doc.text[upto : m.start]
            assert r.text[at : at + len(between)] == between
            at, upto = at + len(between), m.end
            after = doc.text[m.end : found[k + 1].start if k + 1 < len(found) else len(doc.text)]
            end = r.text.index(after, at) if after else len(r.text) if k + 1 == len(found) else at
            new = r.text[at:end]
            assert new and new != m.text
            given.setdefault((m.kind, m.canon), set()).add(pii.canonical(m.kind, new))
            at = end
        assert r.text[at:] == doc.text[upto:]
    assert changed > 3 and all(len(v) == 1 for v in given.values())
    values = [(kind, *v) for (kind, _), v in given.items()]
    assert len(set(values)) == len(values) and not {(k, v) for k, v in values} & set(given)


def test_pipeline_stage_by_stage(spark, documents):
    """Each stage's rows, worked out from the rows before it by other means."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    clean = common.materialize(stages["toxicity"](spark, documents, DATA), "t1")
    scores = {r.doc_id: r.score for r in toxicity.score(documents, queries.toxicity_model(documents, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    assert set(rows(clean)) == {d for d, s in scores.items() if s < 0.5}

    single = common.materialize(stages["n-gram Jaccard join"](spark, clean, DATA), "t2")
    sets = {}
    for r in clean.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {d: low if c == high else c for d, c in label.items()}
    assert set(rows(single)) == {d for d, c in label.items() if c == d}

    private = common.materialize(stages["PII"](spark, single, DATA), "t3")
    before, after = rows(single), rows(private)
    assert set(before) == set(after)
    for d, r in after.items():
        assert (r.text != before[d].text) == bool(pii.mentions(before[d].text)) and r.n_chars == len(r.text or "") and r.source == before[d].source

    mixed = common.materialize(stages["mixing sources to target weights"](spark, private, DATA), "t4")
    con = duckdb.connect()
    con.register("documents", private.toPandas())
    want = {d: int(taken / size) if size else 1 for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({sql.OP6_SQL})").fetchall()}
    assert Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in want.items() if n}

    packed = stages["best-fit packing"](spark, mixed, DATA).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    lengths = Counter()
    for r in mixed.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        lengths.update((r.doc_id, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
    assert Counter(zip(packed.doc_id, packed.piece, packed.length, strict=True)) == lengths
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096
    assert packed.sequence_id.nunique() <= 1.1 * packed.length.sum() / 4096 + 1


def test_pieces_of_one_length_in_many_parts(spark):
    """More pieces than one task ranks: places and sequences still fit together."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same words").otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("text"))
    out = packing.pack(docs, queries.tokenizer_file()).toPandas()
    assert len(out) == 9000 and out.doc_id.is_unique
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096
    assert out.sequence_id.nunique() <= out.length.sum() // 4096 + 2


def test_repeats_across_parts_of_a_long_text(spark):
    """A text of over a mebibyte is hashed in parts; a string that repeats over their border goes."""
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrst"), 1_100_000))
    border = (1 << 20) - 250
    docs = [(1, letters), (2, letters[border : border + 600]), (3, letters[:300])]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (out[1].n_removed, out[1].n_spans, out[2].n_removed, out[3].n_removed) == (600, 1, 600, 0)


def test_neighbours_of_repeated_and_null_ids(spark):
    rows = [(k, [float(k % 7), float(k % 3), 1.0, float(k % 5)]) for k in range(300)] + [(0, [0.0, 0.0, 1.0, 0.0])] * 2 + [(None, [1.0, 1.0, 1.0, 1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    own = out[out.query_id == 0].sort_values("rank")
    assert own["rank"].tolist() == list(range(1, 11)) and own.vec_id.is_unique and 0 not in set(own.vec_id) and (own.score.diff().dropna() >= 0).all()


def test_links_under_one_hot_shingle(spark):
    """One shingle in every document, and groups of near copies of it, in several blocks."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(30)]
        for c in range(8):
            words = list(base)
            words[int(rng.integers(30))] = f"x{g}c{c}"
            rows.append((8 * g + c, "the same four words " + " ".join(words)))
    params = jaccard.Params(words=4, percent=85)
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()}
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t in rows}
    label = {k: k for k in sets}
    for g in range(40):
        for a, b in itertools.combinations(range(8 * g, 8 * g + 8), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    assert out == label
