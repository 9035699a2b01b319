"""Operators over chains of rows against plain Python: retrieval, coverage, graphs, lifecycles, parses, passes on triggers."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmatch.operators import graph, lexical, linking, passes, relinking, requirements, revisions, tables
from corpusmatch.operators.matching import MatchConfig
from corpusmatch.operators.storage import shared_folder
from corpusmatch.sources import pages
from corpusmatch.streaming import matching as sm


def brute_lexical(docs, queries, k, c):
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    df, n = Counter(w for ws in words.values() for w in set(ws)), len(docs)
    usual = sum(map(len, words.values())) / n
    out = set()
    for q, text in queries:
        found = {}
        for term in set(re.findall(r"\w+", (text or "").lower())) & set(df):
            idf = math.floor(math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * 1000 + 0.5)
            for d, ws in words.items():
                if tf := ws.count(term):
                    found[d] = found.get(d, 0) + math.floor(idf * (tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * len(ws) / usual))) * 1000)
        out |= {(q, d, s, r + 1) for r, (d, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


@pytest.mark.parametrize(("k", "share"), [(3, 0.1), (40, 0.02), (1, 1.0)])
def test_lexical_topk_is_exact(spark, k, share):
    """Common terms wait, and no document is lost for it, also where rare terms find too few, or none."""
    rng = random.Random(k)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(60)]
    docs = [(d, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(1, 40)))) for d in range(150)]
    docs += [(150, None), (151, ""), (152, docs[0][1]), (153, docs[0][1].upper())]
    queries = [(q, " ".join(rng.sample(common, 2) + rng.sample(rare, 3))) for q in range(12)] + [(20, "c0 c1"), (21, "nowhere"), (22, None), (23, "r1 r1 nowhere"), (24, "")]
    config = lexical.LexicalConfig(rare_share=share)
    index = lexical.lexical_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = lexical.lexical_topk(spark.createDataFrame(queries, "query_id long, text string"), index, k, config)
    assert {tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()} == brute_lexical(docs, queries, k, config)
    assert lexical.lexical_topk(spark.createDataFrame([], "query_id long, text string"), index, k).isEmpty()


def test_lexical_index_of_what_is_asked(spark):
    """Only terms asked are indexed, with the same result; blocks of few documents and queries lose none, nor does a null key or a score of 0."""
    rng = random.Random(3)
    docs = [(d, " ".join(rng.choice(["w1", "w2", "w3", "w4", "rare", "other"]) for _ in range(rng.randint(1, 9))) + " all") for d in [None, *range(300), 7]]
    asked = spark.createDataFrame([(0, "w1 rare"), (1, "W2 w3"), (2, "all"), (3, None)], "query_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.lexical_index(df, asked=asked)
    assert {r.term for r in index.stats.collect()} == {"w1", "w2", "w3", "rare", "all"}
    got = [lexical.lexical_topk(asked, i, 1000, docs_a_block=d, queries_a_block=q).collect() for i, d, q in ((index, 16, 1), (lexical.lexical_index(df), 4096, 512))]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    # Every document has `all`, so its idf is 0 or next to it.
    assert {r.doc_id for r in got[0] if r.query_id == 2} == {None, *range(300)}
    few = lexical.lexical_topk(asked, index, 5, docs_a_block=16, queries_a_block=1).collect()
    assert sorted(map(str, few)) == sorted(str(r) for r in got[0] if r["rank"] <= 5)


def test_fusion_of_absent_ranks(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 10, 4)], "user_id long, item_id long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 5, 1)], "user_id long, item_id long, rank int")
    got = {(r.user_id, r.item_id): (r.one_rank, r.two_rank, r.score, r["rank"]) for r in lexical.fused({"one": (one, 1.0), "two": (two, 0.5)}).collect()}
    assert got == {
        (1, 11): (2, 1, 1 / 62 + 0.5 / 61, 1), (1, 10): (1, None, 1 / 61, 2), (1, 12): (None, 2, 0.5 / 62, 3), (2, 10): (1, None, 1 / 61, 1), (3, 5): (None, 1, 0.5 / 61, 1),
    }
    assert lexical.fused({"one": (one, 1.0), "two": (two, 0.5)}, limit=1).count() == 3


def test_requirement_statuses(spark):
    needs = [("p", 1, 10, "required", False), ("p", 2, 20, "required", False), ("p", 3, 30, "preferred", False), ("p", 4, 40, "preferred", True), ("p", 5, 50, "unspecified", None), ("p", 6, 60, "required", True), ("p", 7, None, "required", False), ("p", 8, 80, "required", True)]
    facts = [(1, "u", 10, True, False, 0.5), (2, "u", 10, True, True, 0.1), (3, "u", 21, True, False, 0.9), (4, "u", 22, True, False, 0.9), (5, "u", 3, True, None, None), (6, "u", 40, True, True, 1.0), (7, "u", 50, True, True, 1.0), (8, "u", 50, False, False, 0.2), (9, "u", 60, False, False, 0.2), (10, "u", 81, True, True, 1.0), (11, "u", None, True, True, 1.0), (12, "v", 20, True, True, 1.0)]
    tree = [(21, 20, 1), (22, 20, 2), (30, 3, 1), (81, 80, 1)]
    similar = [("u", 7, 99, 0.9), ("u", 2, 98, 0.99), ("u", 3, 97, 0.1)]
    out = requirements.requirement_statuses(
        spark.createDataFrame([("u", "p"), ("u", "p"), ("w", "p")], "user_id string, posting_id string"),
        spark.createDataFrame(needs, "posting_id string, requirement_id int, concept_id int, necessity string, negated boolean"),
        spark.createDataFrame(facts, "evidence_id int, user_id string, concept_id int, has boolean, confirmed boolean, confidence double"),
        spark.createDataFrame(tree, "node int, ancestor int, distance int"), spark.createDataFrame(similar, "user_id string, requirement_id int, evidence_id int, similarity double"),
    )
    got = {r.requirement_id: (r.status, r.method, r.evidence_id) for r in out.where("user_id = 'u'").collect()}
    assert got == {
        1: ("satisfied", "confirmed", 2), 2: ("partial", "narrower", 3), 3: ("partial", "broader", 5), 4: ("conflicting", "denied", 6), 5: ("conflicting", "denied", 8),
        6: ("satisfied", "concept", 9), 7: ("partial", "similar", 99), 8: ("unknown", None, None),
    }
    assert {r.status for r in out.where("user_id = 'w'").collect()} == {"unknown"}
    rolled = {r.user_id: r for r in requirements.coverage(out).collect()}
    u = rolled["u"]
    required, preferred = (1 + 0.65 + 1 + 0.65 + 0.45) / 5, (0.65 + 0) / 2
    assert (u.satisfied, u.partial, u.unknown, u.conflicting) == (2, 3, 1, 2) and u.evidence_completeness == 7 / 8
    assert u.requirement_coverage == pytest.approx((3 * required + preferred) / 4) and rolled["w"].requirement_coverage == pytest.approx(0.45)
    with pytest.raises(ValueError, match="statuses"):
        requirements.Policy(unknown=0.0)


def test_requirements_are_not_broadcast(spark):
    """Spark takes 400 requirements with lists of ancestors for a few kB, as their tables are small; a million passed the driver whole."""
    needs = spark.range(400).selectExpr("id div 2 as posting_id", "id as requirement_id", "id % 7 as concept_id", "'required' as necessity", "id % 5 = 0 as negated")
    pairs = spark.range(600).selectExpr("id % 3 as user_id", "id % 200 as posting_id")
    evidence = spark.range(9).selectExpr("id as evidence_id", "id % 3 as user_id", "id % 7 as concept_id", "true as has", "false as confirmed", "0.5D as confidence")
    out = requirements.requirement_statuses(pairs, needs, evidence, spark.range(1, 7).selectExpr("id as node", "0L as ancestor", "1L as distance"))
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [posting_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins
    assert out.count() == out.select("user_id", "posting_id", "requirement_id").distinct().count() == 1200


def test_requirements_are_dealt_out_by_user_once(spark):
    """What is asked and what is known go out by user; rows of ancestors were shuffled by user and concept, and once more by requirement."""
    pairs = spark.createDataFrame([(1, 2)], "user_id long, posting_id long")
    needs = spark.createDataFrame([(2, 3, 4, "required", False)], "posting_id long, requirement_id long, concept_id long, necessity string, negated boolean")
    evidence = spark.createDataFrame([(7, 1, 5, True, True, 0.5)], "evidence_id long, user_id long, concept_id long, has boolean, confirmed boolean, confidence double")
    out = requirements.requirement_statuses(pairs, needs, evidence, spark.createDataFrame([(4, 5, 1)], "node long, ancestor long, distance long"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 3, "required", "partial", "broader", 7)]
    plan = requirements.coverage(out)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(user_id" in line]
    assert dealt and all(re.search(r"hashpartitioning\(user_id#\d+L, \d+\)", line) for line in dealt)


def test_ancestors_with_cycles(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)} | {(100 + k, 101 + k) for k in range(30)}
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want = set()
    for node in up:
        seen, now, far = {node}, {node}, 0
        while now:
            far += 1
            now = {b for a in now for b in up.get(a, ())} - seen
            seen |= now
            want |= {(node, b, far) for b in now}
    rows = [*edges, *list(edges)[:5], (None, 3), (4, None), (5, 5)]
    assert {tuple(r) for r in graph.ancestors(spark.createDataFrame(rows, "child int, parent int")).collect()} == want
    assert graph.ancestors(spark.createDataFrame([], "child int, parent int")).isEmpty()


def test_ancestors_meet_at_one_distance_only(spark, monkeypatch):
    """Each pair of a tree is written once; joins of all pairs with all wrote every pair again in every round."""
    kept, counts = graph.written, []

    def counted(df, name):
        out = kept(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.createDataFrame([(i, i // 3) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1021)], "child int, parent int")
    assert graph.ancestors(edges).count() == sum(counts)


def test_cascade_takes_orphans_last(spark):
    make = spark.createDataFrame
    jobs, raws = make([(1,), (2,), (3,)], "job int"), make([(10,), (11,), (12,), (13,)], "raw int")
    records = make([(100, 1, 10), (101, 1, 11), (102, 2, 11), (103, None, 12), (104, 3, None)], "rec int, job_id int, raw_id int")
    notes = make([(7, 100), (8, 102), (9, None)], "note int, rec_id int")
    known = {"jobs": graph.Table(jobs, "job"), "records": graph.Table(records, "rec"), "notes": graph.Table(notes, "note"), "raws": graph.Table(raws, "raw")}
    rules = [graph.Link("records", "job_id", "jobs"), graph.Link("notes", "rec_id", "records"), graph.Orphan("raws", "records", "raw_id")]
    gone = graph.cascade(known, {"jobs": make([(1,), (1,), (None,), (3,)], "x int")}, rules)
    keys = lambda name: sorted(r[0] for r in gone[name].collect())
    assert [keys(n) for n in ("jobs", "records", "notes", "raws")] == [[1, 3], [100, 101, 104], [7], [10]]
    assert {tuple(r) for r in graph.cascade_counts(gone).collect()} == {("jobs", 2), ("records", 3), ("notes", 1), ("raws", 1)}
    left = graph.survivors(known, gone)
    assert sorted(r.raw for r in left["raws"].collect()) == [11, 12, 13] and left["notes"].count() == 2


def test_lifecycle_refuses_and_clears(spark):
    allowed = {"received": ("parsed", "failed"), "failed": ("received",), "parsed": ("failed",)}
    rows = [("a", 1, "parsed", None, None, "first"), ("a", 2, "received", "x", "y", "z"), ("a", 3, "failed", "E1", "why", None), ("a", 4, None, None, None, None), ("a", 5, "received", "E9", "no", None), ("b", 1, "failed", "E2", None, "by hand"), (None, 1, "parsed", None, None, None)]
    df = spark.createDataFrame(rows, "id string, at int, target string, code string, detail string, reason string").repartition(3)
    got = [tuple(r) for r in revisions.lifecycle(df, "id", "at", allowed, "received").orderBy("id", "at").select("id", "at", "from_status", "legal", "status", "failure_code", "failure_detail", "reason").collect()]
    assert got == [
        ("a", 1, "received", True, "parsed", None, None, "first"), ("a", 2, "parsed", False, "parsed", None, None, None), ("a", 3, "parsed", True, "failed", "E1", "why", "E1"),
        ("a", 4, "failed", False, "failed", "E1", "why", None), ("a", 5, "failed", True, "received", None, None, "E9"), ("b", 1, "received", True, "failed", "E2", None, "by hand"),
    ]
    steps = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (1, 3, None), (1, 4, "y")], "o int, at int, s string")
    legal = revisions.transitions(steps, "o", "at", "s", spark.createDataFrame([("x", "y")], "from_status string, to_status string")).orderBy("at")
    assert [r.legal for r in legal.collect()] == [True, False, False, False]


def test_upserts_keep_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "k int, kept string, v int")
    new = spark.createDataFrame([(1, "b", 7, 1), (1, "c", 8, 0), (2, "d", None, 1), (3, None, 1, 2), (3, "e", 2, 3), (3, "f", 3, 1)], "k int, kept string, v int, at int")
    got = {tuple(r) for r in tables.upsert(old, new, ["k"], keep=("kept",), order=("at",)).collect()}
    assert got == {(1, "a", 7), (2, "d", None), (3, "f", 2)}
    assert tables.upsert(old, new.where("k = 3"), ["k"]).where("k = 3").first().v == 3
    with pytest.raises(PySparkException, match="null in key k"):
        tables.upsert(old, spark.createDataFrame([(None, "x", 1)], old.schema), ["k"]).collect()
    made = revisions.override_profile(
        spark.createDataFrame([(1, 4, "neural", False, ["x"])], "user_id int, revision_no long, origin string, reviewed boolean, competencies array<string>"),
        spark.createDataFrame([(1, ["b"], 9), (1, ["a"], 10), (2, ["z"], 1)], "user_id int, competencies array<string>, at int"), "at",
    )
    assert {(r.revision_no, *r.competencies, r.parent_no) for r in made.collect()} == {(4, "x", None), (5, "b", 4), (6, "a", 5)}


def test_relinking_touches_only_changed_documents(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    docs = spark.createDataFrame([(d, " ".join(rng.choices(words, k=12)) if d % 9 else None) for d in range(60)], "doc_id long, text string")
    spans = docs.where("doc_id % 2 = 0 and text is not null").select("doc_id", F.substring_index("text", " ", 2).alias("raw_text"), F.lit(0).alias("start_char"), F.length(F.substring_index("text", " ", 2)).alias("end_char"), F.lit(0.5).alias("confidence"))
    old_labels = [(k, w) for k, w in enumerate(words[:10])] + [(50, "word1 word2"), (51, "word3 word4")]
    new_labels = [x for x in old_labels if x[0] not in (4, 50)] + [(60, "word20 word21"), (61, "word5"), (62, "absent word6")]
    old, new = (linking.alias_index(spark.createDataFrame(x, "concept_id long, label string")) for x in (old_labels, new_labels))
    full = lambda index: linking.link_rows(docs, spans, index)
    index = relinking.word_index(docs)
    rows, touched = relinking.relink(full(old), docs, spans, index, old, new)
    assert sorted(map(str, rows.collect())) == sorted(map(str, full(new).collect()))
    changed = {r.form for r in relinking.changed_forms(old, new).collect()}
    texts = {r.doc_id: set((r.text or "").split()) for r in docs.collect()}
    want = {d for d, own in texts.items() if any(set(f.split()) <= own for f in changed)}
    assert {r.doc_id for r in touched.collect()} == want and 0 < len(want) < 53 and "word4" in changed and "word7" not in changed


def test_parse_store(spark):
    texts = [(1, "one\n\n- two\n- three"), (2, "x" * 50 + "\n\nshort"), (3, "short\n\n" + "y" * 50), (4, None), (5, ""), (6, "<p>a</p><p>b <b>c</b></p>")]
    docs = spark.createDataFrame(texts, "id int, text string")
    store = pages.ParseStore(spark, shared_folder(spark, "parses"))
    store.commit(pages.parsed_documents(docs, "id", "text", most=40), 1)
    got = {r.id: r for r in store.texts("id").collect()}
    assert {k: (r.parsed_text, r.n_blocks, r.truncated, r.error) for k, r in got.items()} == {
        1: ("one\n- two\n- three", 3, False, None), 2: (None, 0, True, "first block over the limit"), 3: ("short", 1, True, None), 4: (None, 0, False, "no text found"), 5: (None, 0, False, "no text found"), 6: ("a\nb c", 2, False, None),
    }
    assert [(r.text, r.start_char, r.block_type) for r in store.blocks("id").where("id = 1").orderBy("ordinal").collect()] == [("one", 0, "paragraph"), ("- two", 4, "list_item"), ("- three", 10, "list_item")]
    # A parse that dies before it is in the manifest changes nothing.
    pages.parsed_documents(docs.limit(1), "id", "text").write.parquet(f"{store.folder}/staged/lost")
    assert store.texts("id").count() == 6
    store.commit(pages.parsed_documents(docs.where("id = 2"), "id", "text"), 2)
    assert [(r.version, r.n_blocks) for r in store.texts("id").where("id = 2").collect()] == [(2, 2)] and store.blocks("id").where("id = 2").count() == 2
    revs = spark.createDataFrame([(1, "a line of text", "received", "uk"), (2, "", "received", None), (3, "z", "parsed", None), (4, "later", None, None)], "id int, text string, status string, language string")
    moves = pages.backfill(store, revs, "id", "text", 2, ["id"], 3)
    assert {(r.id, r.from_status, r.to_status, r.reason, r.language) for r in moves.collect()} == {(1, "received", "parsed", None, "uk"), (2, "received", "failed", "no text found", None)}


def _matching_case(spark, seed):
    rng = random.Random(seed)
    vector = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(3)]
    user = lambda k: (k, vector(), rng.choice(["red ring", "blue rod", None]), "m", [], [], rng.choice([None, 5.0]), 10.0, [], [])
    posting = lambda k: (k, vector(), rng.choice(["red rod", "blue ring tall"]), rng.choice(["x", "y"]), float(rng.randrange(9)), float(rng.randrange(20)), "USD", True, [])
    sides = lambda users, items: (spark.createDataFrame([user(k) for k in users], sm.USER), spark.createDataFrame([posting(k) for k in items], sm.POSTING))
    return [sides(range(4), range(12)), sides([], [12, 13]), sides([1, 9], [3, 14]), sides([2], [])]


def test_matching_on_triggers_is_the_whole_pass(spark, monkeypatch):
    """Four triggers, whole logs in between; retrieval smaller than the corpus, so postings come in and fall out."""
    monkeypatch.setattr(sm, "_WHOLE", 2)
    config, folder = MatchConfig(retrieval_limit=4), shared_folder(spark, "case")
    users, items, out = {}, {}, None
    for n, (u, p) in enumerate(_matching_case(spark, 6)):
        users.update({r.user_id: tuple(r) for r in u.collect()})
        items.update({r.item_id: tuple(r) for r in p.collect()})
        sm.changes_of(u, p, n).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(sm.CHANGE).parquet(f"{folder}/in/*")
        out = sm.stream_matching(stream, f"{folder}/state", config)
    assert sorted(map(str, sm.stream_matching(stream, f"{folder}/state", config).collect())) == sorted(map(str, out.collect()))  # nothing new
    none = spark.createDataFrame([], "user_id long, item_id long, model string, query_hash string, doc_hash string, relevance double")
    want = passes.whole_pass(spark.createDataFrame(list(users.values()), sm.USER), spark.createDataFrame(list(items.values()), sm.POSTING), none, config)
    key = lambda r: (r.user_id, r.item_id, round(r.similarity, 9), r.eligible, tuple(r.reasons), r.relevance, r.score, r.rerank_position, r.recommendation)
    assert sorted(map(str, map(key, out.collect()))) == sorted(map(str, map(key, want.collect()))) and out.count() == 5 * 4
    decisions = spark.createDataFrame([(1, out.where("user_id = 1").first().item_id, d, k) for k, d in enumerate(("approved", "rejected"))], "user_id long, item_id long, decision string, at int")
    said = Counter(r.decision for r in passes.with_decisions(out, decisions).collect())
    assert said == {"rejected": 1, "pending": 19}




@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_of_a_hot_key(spark, seed):
    """Equal to the loop over each key, with one key in many ranges, documents over the budget, empty ones and changing room."""
    from corpusmatch.operators import batching

    rng = random.Random(seed)
    rows = []
    for k in range(900):
        owner = "hot" if k % 3 else rng.choice(["a", "b", None])
        rows.append((owner, k, rng.choice(["", None, "é" * rng.randint(1, 30), "x" * rng.randint(1, 200)]), "q" * rng.choice([0, 0, 10, 130] if seed == 3 else [5])))
    df = spark.createDataFrame(rows, "owner string, at int, text string, asked string")
    want, now = {}, {}
    for owner, at, text, asked in rows:
        if owner is None:
            continue
        size, free = len((text or "").encode()), 120 - len(asked)
        batch, used = now.get(owner, (-1, 1 << 60))
        batch, used = (batch + 1, size) if free <= 0 or used + size > free else (batch, used + size)
        now[owner] = (batch, used)
        want[owner, at] = (size, batch)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batching.byte_batches(df, "owner", "at", F.col("text"), 120, F.col("asked")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.owner, r["at"]): (r.size, r.batch) for r in got} == want and len(got) == len(want)


def test_segments_of_short_keys():
    """Keys of a few rows each cost no pandas object each: many are cut fast, in parts that end anywhere."""
    import time

    import pandas as pd

    from corpusmatch.operators import batching

    owners = [k // 3 for k in range(60_000)]
    whole = pd.DataFrame({"range": [k // 30_001 for k in range(60_000)], "key_": owners, "size": range(60_000)})
    begun = time.process_time()
    got = list(batching._segments((whole[a : a + 997] for a in range(0, 60_000, 997)), "size"))
    assert time.process_time() - begun < 4
    want = whole.groupby(["range", "key_"], sort=False)["size"].agg(list)
    assert [(r, k, v.tolist()) for r, k, v in got] == [(*i, v) for i, v in want.items()] and not list(batching._segments(iter([whole[:0]]), "size"))


def test_steps_of_a_range():
    """What a range does to the bytes used, for every number of them, against the loop."""
    import numpy as np

    from corpusmatch.operators import batching

    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 12)
        sizes = np.array([rng.randint(0, 9) for _ in range(n)])
        rooms = np.array([rng.choice([-2, 7, 12]) for _ in range(n)] if rng.random() < 0.5 else [12] * n)
        for used in [*range(14), 1 << 60]:
            u, new = used, 0
            for size, room in zip(sizes.tolist(), rooms.tolist(), strict=True):
                u, new = (size, new + 1) if room <= 0 or u + size > room else (u + size, new)
            row = next(r for r in batching._steps(sizes, rooms) if used > r[0])
            assert ((used + row[1], 0) if row[2] == 0 else row[1:]) == (u, new)


def test_near_duplicates_by_minhash(spark):
    """Recall of links within clusters against all pairs, nothing linked that isn't, and odd rows."""
    from corpusmatch.operators import neardup

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(12)]
    rows = []
    for k in range(260):
        words = list(base[k % 12])
        for at in rng.sample(range(len(words)), rng.randint(0, 3)):
            words[at] = word()
        rows.append((k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, rows[5][1].upper()), (302, rows[5][1]), (None, rows[5][1]), (303, "one two"), (304, "One  two"), (305, " ".join(word() for _ in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicate_clusters(docs).collect()}
    sets = {k: {" ".join(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows if k is not None and t and t.split()}
    label = {k: k for k in got}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    together = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if label[a] == label[b]]
    found = sum(got[a].component_id == got[b].component_id for a, b in together)
    assert found >= 0.9 * len(together) > 500
    assert all(label[a] == label[b] for i, a in enumerate(keys) for b in keys[i + 1 :] if got[a].component_id == got[b].component_id)
    assert got[302].component_id == got[5].component_id and got[304].component_id == 303 and (got[300].component_id, got[301].n_shingles) == (300, 0)
    assert {k: r.n_shingles for k, r in got.items() if k in sets and k != 302} == {k: len(s) for k, s in sets.items() if k != 302}
    assert neardup.near_duplicate_clusters(docs.where("false")).isEmpty()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 200: 150, 150: 150, 300: 150}


def test_a_bucket_of_many_unlike_texts_empties_in_few_rounds(spark):
    """Most of these sets share the smallest hash, and no two are linked; a round for each would be too many."""
    from corpusmatch.operators import neardup

    config = neardup.MinHashConfig(words=1, bands=1, rows=1)
    docs = spark.createDataFrame([(k, f"a b c d own{k}") for k in range(20)] + [(100, "own7 d c b a"), (101, "a a b c d own9")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_clusters(docs, config, most_rounds=6).collect()}
    assert got == {**{k: k for k in range(20)}, 100: 7, 101: 9}
