"""Runs, imports, ingests, extraction and evaluation on literal rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmatch.functions import text as tx
from corpusmatch.operators import evaluation, extraction, linking, matching, profiles, tables
from corpusmatch.plans import registry, upkeep  # noqa: F401  upkeep adds its queries
from corpusmatch.sources import postings


def test_settings():
    found = matching.config_of({"rerank_weight": " 0.5 ", "retrieval_limit": "20", "apply_threshold": 80})
    assert (found.rerank_weight, found.retrieval_limit, found.apply_threshold) == (0.5, 20, 80.0)
    for wrong in ({"nope": 1}, {"rerank_weight": " "}, {"rerank_weight": "much"}, {"rerank_weight": 2}, {"retrieval_limit": 1.5}, {"retrieval_limit": True}, {"rerank_top_k": None}, {"apply_threshold": 40}, {"rerank_weight": float("nan")}):
        with pytest.raises(ValueError):
            matching.config_of(wrong)


def test_release_imports(spark):
    empty = spark.createDataFrame([("esco", "1", ["en"], "active", 5, None), ("own", "1", ["en"], "active", 2, None)], "namespace string, version string, languages array<string>, status string, concepts long, error string")
    state = lambda df: {(r.namespace, r.version): (r.status, r.concepts, r.error, r.languages) for r in df.collect()}
    during, said = tables.import_release(empty, "esco", "2", "en", 7, None)
    assert said == "importing" and state(during)["esco", "2"] == ("importing", None, None, ["en"]) and state(during)["esco", "1"][0] == "active"
    failed, said = tables.import_release(during, "esco", "2", "en", 7, 6)
    assert said == "failed" and state(failed)["esco", "2"] == ("failed", 6, "found 6 concepts, expected 7", ["en"]) and state(failed)["esco", "1"][0] == "active"
    ready, said = tables.import_release(failed, "esco", "2", "en", 7, 7)
    assert said == "ready" and state(ready)["esco", "2"] == ("ready", 7, None, ["en"])
    active, said = tables.import_release(failed, "esco", "2", "en", 7, 7, activate_=True)
    assert said == "active" and state(active)["esco", "1"][0] == "superseded" and state(active)["own", "1"][0] == "active"
    assert tables.import_release(active, "esco", "2", "en", 7, 7)[1] == "unchanged" and tables.import_release(active, "esco", "2", "uk", 7, 6)[1] == "failed"
    merged, said = tables.import_release(active, "esco", "2", "uk", 7, 7)
    assert said == "merged" and state(merged)["esco", "2"][3] == ["en", "uk"] and len(state(merged)) == 3


def test_ingest_keeps_bad_rows_apart(spark):
    rows = [("s", 1, "a"), ("s", 2, "bad"), ("s", 3, None), ("s", 4, "d"), ("s", 5, "late"), ("t", 1, "bad")]
    listings = spark.createDataFrame(rows, "source string, id long, html string")
    known = spark.createDataFrame([("s", 1)], "source string, id long")

    def parse(text):
        if text == "bad":
            raise ValueError("no title")
        return {"title": text.upper(), "n": len(text)}  # a null text breaks it as well

    done, counts = postings.ingest(listings, known, ["source", "id"], 4, "html", parse, "title string, n long", F.asc("id"))
    got = {(r.source, r.id): (r.title, r.n, (r.error or "").split(":")[0]) for r in done.collect()}
    assert got == {("s", 2): (None, None, "ValueError"), ("s", 3): (None, None, "AttributeError"), ("s", 4): ("D", 1, ""), ("t", 1): (None, None, "ValueError")}
    assert {tuple(r) for r in counts.collect()} == {("s", 4, 1, 2), ("t", 1, 0, 1)}


def test_run_history(spark):
    log = [("a", 1, "start", None, None, None, None), ("a", 3, "step", "embed", 5, 1, None), ("a", 2, "step", "scrape", 7, None, None), ("a", 4, "finish", None, None, None, "boom"), ("a", 5, "finish", None, None, None, None), ("b", 2, "start", None, None, None, None), ("c", 9, "step", "x", 1, 1, None), ("c", 10, "finish", None, None, None, "lost")]
    got = {r.run: (r.status, r.started_at, r.finished_at, r.steps, r.seen, r.errors, r.error) for r in tables.run_history(spark.createDataFrame(log, "run string, at int, kind string, step string, seen long, errors long, error string")).collect()}
    assert got == {"a": ("succeeded", 1, 5, ["scrape", "embed"], 12, 1, None), "b": ("running", 2, None, [], 0, 0, None), "c": ("failed", 9, 10, ["x"], 1, 1, "lost")}


def test_metric_report(spark):
    """Against the definitions, on rankings of several lengths; nothing judged and nothing relevant included."""
    rng = random.Random(1)
    rows = [(g, r, rng.choice([None, 0, 1, 2, 3])) for g in ("a", "b") for r in range(1, 60)] + [("none", r, None) for r in (1, 2)] + [("poor", r, 0) for r in (1, 2, 3)]
    got = {(r.g, r.metric, r.k): r.value for r in evaluation.metric_report(spark.createDataFrame(rows, "g string, rank int, label int"), "g", (5, 20, 50)).collect()}
    for g in ("a", "b", "none", "poor"):
        ranked = [(r, x) for h, r, x in rows if h == g and x is not None]
        relevant = sum(x >= 2 for _, x in ranked)
        assert got[g, "judged", None] == len(ranked) and got[g, "relevant", None] == relevant
        for k in (5, 20, 50):
            want = sum(x >= 2 for r, x in ranked if r <= k) / relevant if relevant else None
            assert got[g, "recall", k] == want
        for k in (5, 20):
            best = sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(sorted((x for _, x in ranked), reverse=True)[:k]))
            dcg = sum((2**x - 1) / math.log2(r + 1) for r, x in ranked if r <= k)
            assert got[g, "ndcg", k] == (pytest.approx(dcg / best) if best else None)
        assert (g, "ndcg", 50) not in got
        first = [r for r, x in ranked if x >= 2 and r <= 10]
        assert got[g, "mrr", 10] == (None if not ranked else 1 / min(first) if first else 0.0)


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    got = matching.cosine_topk(items.withColumnRenamed("item_id", "user_id").where("user_id in (1, 2)"), items, 10)
    assert [(r.user_id, r.item_id) for r in got.orderBy("rank").collect()] == [(1, 1), (1, 7)]
    good, refused = matching.refused_vectors(items.withColumn("model", F.lit("m")), "model", "vector")
    assert {r.item_id: r.reason for r in refused.collect()} == {5: "has no dimensions, the model's have 2", 8: "has 3 dimensions, the model's have 2"} and good.count() == 6


def test_only_the_first_are_reranked(spark):
    pairs = [("u", k, 1 - k / 10, [] if k != 2 else ["too far"], 0.1 * k) for k in range(1, 6)]
    df = spark.createDataFrame(pairs, "user_id string, item_id int, similarity double, reasons array<string>, relevance double")
    got = {r.item_id: (r.rerank_position, r.score) for r in matching.match_pass(df, matching.MatchConfig(rerank_top_k=2)).collect()}
    assert {k: p for k, (p, _) in got.items()} == {1: 2, 2: None, 3: 1, 4: None, 5: None}
    assert got[4][1] == 60.0 and got[2][1] == 0.0 and got[3][1] == pytest.approx(100 * (0.7 * 0.3 + 0.3 * 0.7), abs=0.05)


def test_extraction_job(spark):
    revisions = [(1, "parsed", "use Python now", None, None), (2, "received", "x", None, None), (3, "parsed", "stored differs", "Python here", None), (4, "parsed", "Python alone", None, "out of memory"), (5, "parsed", "python and tea", None, None), (6, None, "x", None, None), (7, "parsed", "Python " * 5, None, None)]
    spans = [(1, "tool", 4, 10, "Python", 2.0), (1, "tool", 0, 3, "xxx", 0.5), (3, "tool", 0, 6, "Python", 0.5), (4, "tool", 0, 6, "Python", 0.5), (7, "tool", 28, 34, "Python", 0.5), (99, "tool", 0, 1, "x", 0.5)]
    index = linking.alias_index(spark.createDataFrame([(1, "python"), (2, "tea"), (3, "tea")], "concept_id long, label string"))
    outcomes, links, moves = extraction.extraction_job(
        spark.createDataFrame(revisions, "doc_id long, status string, text string, input_text string, error string"), spark.createDataFrame(spans, "doc_id long, label string, start_char int, end_char int, quote string, confidence double"), index, most_chars=20,
    )
    got = {r.doc_id: (r.extracted, r.skipped_reason, r.origin, r.kept, r.discarded, r.linked, r.warnings) for r in outcomes.collect()}
    none, cut = "no spans were kept: structural facts only", "the text was cut before extraction"
    assert got == {
        1: (True, None, "neural_extraction", 1, 1, 1, []), 2: (False, "revision is received, not parsed", None, None, None, None, None),
        3: (False, "1 evidence span(s) do not quote the stored text", None, None, None, None, None), 4: (False, "out of memory", None, None, None, None, None),
        5: (True, None, "structural_extraction", 0, 0, 1, [none]), 6: (False, "revision is without a status, not parsed", None, None, None, None, None), 7: (True, None, "structural_extraction", 0, 1, 1, [none, cut]),
    }
    assert {(r.doc_id, r.form, r.status, r.confidence) for r in links.collect()} == {(1, "python", "linked", 1.0), (5, "python", "linked", 1.0), (5, "tea", "ambiguous", 1.0), (7, "python", "linked", 1.0)}
    ends = {r.doc_id: (r.to_status, r.code) for r in moves.where("step = 2").collect()}
    assert ends == {1: ("extracted", None), 3: ("failed", "invalid_evidence"), 4: ("failed", "extraction_error"), 5: ("extracted", None), 7: ("extracted", None)}
    queue = extraction.reextraction_queue(
        spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "old", 5), (3, None, 4), (4, "old", 3), (5, "new", 1)], "doc_id long, extractor_model_id string, created_at int"),
        spark.createDataFrame([(k, "failed" if k == 4 else "extracted") for k in range(1, 6)], "doc_id long, status string"), "new", 5,
    )
    assert [(r.doc_id, r.reason) for r in queue.collect()] == [(3, "extractor was unknown"), (2, "extractor was old")]


def test_extraction_queries_on_repeated_words(spark, tmp_path):
    """A text that says its first word again right after it doesn't quote it where the extractor found it."""
    texts = ["ha ha and more", "Et Et Et Et Et", "word, and more", " blank at first", "a b c d e f g ", "Et " * 1000, " t" * 1499]
    rows = [(k, texts[k], n) for k, n in enumerate((14, 56, 14, 14, 70, 14, 14))]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("extraction_job", "extraction_moves"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(f"{c}::VARCHAR" for c in got.columns)
        want = con.execute(f"select {columns} from ({registry.SQL[name]})").fetchall()
        said = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        assert sorted(map(str, (tuple(map(said, r)) for r in got.collect()))) == sorted(map(str, want))


def test_previews_and_evidence(spark):
    df = spark.createDataFrame([("mail a@b.example  now " + "x" * 200,), ("short\n\n one",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.preview(F.col("t"), 20)).collect()]
    assert got == ["mail [email] now xxx…", "short one", None]
    places = "array<struct<evidence:struct<start:int,end:int>>>"
    row = spark.range(1).select(profiles.profile_spans(F.expr(f"cast(array(struct(struct(1, 3)), struct(null)) as {places})"), F.expr("cast(array(struct(5, 9), struct(null, null)) as array<struct<start_char:int,end_char:int>>)")).alias("s")).first()
    assert [(x.start, x.end) for x in row.s] == [(1, 3), (5, 9)]


def test_rows_against_named_rules(spark):
    rows = [("linked", 1, 0.5, 0, 3), ("linked", None, 0.5, 0, 3), ("unmapped", 2, 1.5, 4, 4), ("unmapped", None, None, None, None)]
    df = spark.createDataFrame(rows, "status string, concept_id int, confidence double, start_char int, end_char int")
    assert {r.rule: r.violations for r in tables.constraint_report(df, tables.mention_rules()).collect()} == {"linked has a concept": 1, "others have none": 1, "confidence": 1, "places": 1}
    made = spark.createDataFrame([("neural_extraction", None), ("neural_extraction", "m"), ("structural_extraction", "m")], "origin string, extractor_model_id string")
    assert {r.violations for r in tables.constraint_report(made, tables.profile_rules()).collect()} == {1}
