"""Single functions on literal rows."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmatch.functions import render
from corpusmatch.functions import text as tx
from corpusmatch.operators import batching as bt
from corpusmatch.operators import evaluation, linking, matching, revisions
from corpusmatch.operators import tables as tb
from corpusmatch.sources import pages


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("$2000-3000", (2000, 3000, "USD")), ("€1,500 – €2,000", (1500, 2000, "EUR")), ("up to $1000", (None, 1000, "USD")), ("від $1500", (1500, None, "USD")), ("$2500", (2500, 2500, "USD")), ("negotiable", None)],
)
def test_salary(spark, text, want):
    got = value(spark, tx.salary(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("Привіт, це український текст про їжу та її історію", "uk"), ("Этот русский текст объясняет всё, что мы знаем", "ru"), ("This is an English text about nothing", "en"), ("Zażółć gęślą jaźń i idź spać", "pl"), ("AWS 3.12", None)])
def test_language(spark, text, want):
    assert value(spark, tx.detect_language(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("write a.b@c.org now", "write [email] now"), ("call +380 50 123 45 67", "call [phone]"), ("(050) 123-45-67", "([phone]"), ("from 12.03.2024 on", "from 12.03.2024 on"), ("x?token=abc&y=1", "x?token=[redacted]&y=1")],
)
def test_redact(spark, text, want):
    got = value(spark, tx.redact(F.col("t")), t=text)
    assert got == want or got == want.replace("([", "[")


def test_keyword_borders(spark):
    hit = lambda text, kw: value(spark, matching.mentions_keyword(F.col("t"), F.col("k")), t=text, k=kw)
    assert hit("We use Java daily", "java") and not hit("JavaScript only", "java")
    assert not hit("We use C++ here", "C++") and hit("We use C++x", "C++")


def test_names(spark):
    assert value(spark, tx.normalize_company(F.col("t")), t="React, LLC") == "react"
    doc = render.profile_document(F.lit("text"), F.array(F.lit(" cook "), F.lit("")), F.array().cast("array<string>"), F.array(F.lit("remote")))
    assert value(spark, doc, t="") == "LOOKING FOR: cook\nWORK FORMAT: remote\nCV: text"


def test_revisions(spark):
    df = spark.createDataFrame([("o", k, t) for k, t in enumerate("aabaca")], "owner string, ord int, text string")
    got = [(r.revision_no, r.is_new, r.reverted) for r in revisions.revisions(df, "owner", "ord", "text").orderBy("ord").collect()]
    assert got == [(1, True, False), (1, False, False), (2, True, False), (1, False, True), (3, True, False), (1, False, True)]


def test_metrics_without_relevant(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, None)], "g string, rank int, label int")
    r = evaluation.metrics(df, "g", 10).first()
    assert (r.recall, r.precision, r.ndcg, r.mrr) == (None, 0.0, None, 0.0)


def test_longest_match(spark):
    """Forms that are broadcast and forms that are joined give the same, also with ties, empty and null texts."""
    index = spark.createDataFrame([("machine learning",), ("machine",), ("learning rate",), ("b",), ("a b",), ("b a b",)], "form string")
    docs = spark.createDataFrame([(1, "the Machine  learning, rate"), (2, "a b a b a b"), (3, None), (4, "")], "doc_id long, text string")
    few = linking.scan_mentions(docs, index).collect()
    assert [(r.raw_text, r.form, r.start_char, r.end_char) for r in few if r.doc_id == 1] == [("Machine  learning", "machine learning", 4, 21)]
    assert sorted(few) == sorted(linking.scan_mentions(docs, index, most_forms=2).collect())


def test_link_rows(spark):
    labels = [(1, "Google Sheets"), (2, "sheets"), (3, "google"), (4, "sheets"), *((k, f"word {k} common") for k in range(10, 200))]
    index = linking.alias_index(spark.createDataFrame([*labels, (5, "common")], "concept_id long, label string"))
    docs = spark.createDataFrame([(1, "uses google sheets and sheets"), (2, "common google, GOOGLE")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "google sheets", 5, 18, 0.7), (1, "my sheets", 100, 109, 0.4), (1, "nothing", 200, 207, 0.2)], "doc_id long, raw_text string, start_char int, end_char int, confidence double")
    rows = linking.link_rows(docs, spans, index)
    got = {(r.doc_id, r.form): (r.status, r.concept_id, r.alternatives, r.start_char, r.confidence) for r in rows.collect()}
    assert got == {
        (1, "google sheets"): ("linked", 1, None, 5, 0.7), (1, "sheets"): ("ambiguous", None, [2, 4], 103, 1.0), (1, "nothing"): ("unmapped", None, None, 200, 0.2),
        (2, "common"): ("unmapped", None, None, 0, 1.0), (2, "google"): ("linked", 3, None, 7, 1.0),
    }
    assert {tuple(r) for r in linking.status_counts(rows).collect()} == {(1, 1, 1, 1), (2, 1, 0, 1)}
    assert {tuple(r) for r in linking.unmapped_counts(rows).collect()} == {("nothing", 1, "nothing", 1, 1), ("common", 1, "common", 2, 2)}


def test_texts_of_spans_are_dealt_by_place_once(spark):
    """Spans were dealt by all their columns and those without a form by place again; a place may hold two texts, or one twice."""
    index = linking.alias_index(spark.createDataFrame([(1, "known")], "concept_id long, label string"))
    spans = [(1, "a known one", 0, 11, 0.5), (1, "a known one", 0, 11, 0.5), (1, "an odd one", 0, 11, 0.5), (2, "odd", 0, 3, 0.5), (None, "odd", 0, 3, 0.5), (None, "odd", 0, 3, 0.5)]
    spans = spark.createDataFrame(spans, "doc_id long, raw_text string, start_char int, end_char int, confidence double")
    docs = spark.createDataFrame([(1, "known"), (3, "known"), (None, "known")], "doc_id long, text string")
    out = linking.link_rows(docs, spans, index)
    assert {(r.doc_id, r.form, r.start_char, r.status) for r in out.collect()} == {(1, "known", 2, "linked"), (2, "odd", 0, "unmapped"), (3, "known", 0, "linked"), (None, "known", 0, "linked"), (None, "odd", 0, "unmapped")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, raw_text", plan)


def test_raw_texts_that_are_forms_move_as_nulls(spark):
    """Every mention took its text along twice, as it stands and as a form."""
    index = linking.alias_index(spark.createDataFrame([(1, "known")], "concept_id long, label string"))
    spans = spark.createDataFrame([(3, "Odd one", 0, 7, 0.5), (4, "odd", 0, 3, 0.5)], "doc_id long, raw_text string, start_char int, end_char int, confidence double")
    out = linking.link_rows(spark.createDataFrame([(1, "known"), (2, "Known")], "doc_id long, text string"), spans, index)
    assert {(r.doc_id, r.raw_text, r.form) for r in out.collect()} == {(1, "known", "known"), (2, "Known", "known"), (3, "Odd one", "odd one"), (4, "odd", "odd")}
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Window [row_number()", 1)[1]
    assert re.search(r"nullif|if \(\(raw_text#\d+ = form#\d+\)\) null|CASE WHEN \(raw_text#\d+ = ", below)


def test_mentions_move_without_their_concepts(spark):
    """Lists of concepts come to mentions after the last window; they went through it with every mention."""
    index = linking.alias_index(spark.createDataFrame([(1, "a word"), (2, "word")], "concept_id long, label string"))
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    spans = spark.createDataFrame([], "doc_id long, raw_text string, start_char int, end_char int, confidence double")
    plan = linking.link_rows(docs, spans, index)._jdf.queryExecution().optimizedPlan()
    ranked = plan.toString().split("Window [row_number()", 1)[1]
    lines = ranked.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :"))
    below = [line for k, line in enumerate(lines[1:]) if all(depth(x) > depth(lines[1]) - 3 for x in lines[1 : k + 2])]
    assert not any("concept_ids" in line for line in below)


def test_leaders_of_copies(monkeypatch):
    """What was compared before isn't compared again, with the same score; long texts aren't kept."""
    from corpusmatch.operators import clustering

    made = []

    class Counted(clustering.SequenceMatcher):
        def __init__(self, junk, a, b):
            made.append((a, b))
            super().__init__(junk, a, b)

    pairs = [("never met before a", "never met before b"), ("x" * 300, "x" * 299 + "y")]
    want = [clustering.similarity(*p, 0.5) for p in pairs]
    monkeypatch.setattr(clustering, "SequenceMatcher", Counted)
    scores = [[clustering.pair_score(*p, *p[::-1]) for p in pairs] for _ in range(3)]
    assert scores[0] == scores[1] == scores[2] and made.count(pairs[0]) <= 1 and len(made) > 3
    assert [clustering.pair_score(a, "same words", b, "same words") for a, b in pairs] == [(w + 1) / 2 for w in want]


def test_structural_profile_is_dealt_out(spark, tmp_path):
    """Spans are looked for after rows are dealt out, and each place once, so the one task that reads a small file does no such work."""
    from corpusmatch.plans import queries

    row = [(k, "blue bolt", k % 50, 900.0 + k) for k in range(40)]
    spark.createDataFrame(row, "p_partkey long, p_name string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = queries.queries()["structural_profile"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = [x.split("\n:  Union")[0] for x in plan.split("Repartition")[1:]]
    assert len(below) == 2 and not any("locate" in x.split("Relation")[0] for x in below) and plan.count("locate") <= 8
    assert {r.kind for r in out.collect()} == {"experience", "employment_type", "location", "compensation", "rejected"}


def test_leader_clusters(spark):
    """Against the loop: best score first, of equal ones the cluster seen last, and joining a cluster sees it; the first posting stays the leader."""
    import random
    from difflib import SequenceMatcher

    from corpusmatch.operators import clustering

    rng = random.Random(5)
    titles = ["Senior Python Developer", "Senior Python Developer!", "Python Developer", "Data Engineer", "Data Engineers", ""]
    rows = [(k, rng.choice(["React, LLC", "react", "Other", None]), rng.choice(titles), rng.choice(["build things well", "build things", "zzz", None]), k // 2) for k in range(120)]
    names = {"React, LLC": "react", "react": "react", "Other": "other", None: ""}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    leaders, want = [], {}
    for k, company, title, text, _ in rows:
        best, home = 0.0, k
        for c, leader, t, d in reversed(leaders):
            one, two = ratio(title.lower().rstrip("!"), t), ratio(text or "", d)
            if c == names[company] and one >= 0.86 and two >= 0.5 and (one + two) / 2 > best:
                best, home = (one + two) / 2, leader
        own = [x for x in leaders if x[1] == home] or [(names[company], k, title.lower().rstrip("!"), text or "")]
        leaders = [x for x in leaders if x[1] != home] + own
        want[k] = home
    df = spark.createDataFrame(rows, "id long, company string, title string, description string, seen long").repartition(5)
    assert {r.id: r.cluster for r in clustering.leader_clusters(df, "id", "seen").collect()} == want
    tied = [(k, "x", t, "same text", k) for k, t in enumerate(["abcdefghij", "abcdefghxy", "abcdefghij", "abcdefghiy"])]
    out = clustering.leader_clusters(spark.createDataFrame(tied, df.schema), "id", "seen").collect()
    assert {r.id: r.cluster for r in out} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_relay_retries_and_redeliveries(spark, tmp_path):
    """A failed event is tried again in the next batch; one delivered again in a later batch counts once."""
    from corpusmatch.streaming import jobs

    schema = "key int, kind string, until int"
    for at, part in enumerate([[(1, "a", 2), (2, "a", 0), (3, "x", 0)], [(2, "a", 0), (4, "a", 99)], [(5, "a", 0), (1, "a", 2)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    errors = {"a": F.when(F.col("attempts_") < F.col("until"), "not yet")}
    got = {r.key: (r.status, r.attempts) for r in jobs.stream_relay(stream, "kind", F.lit(0), errors, "key").collect()}
    assert got == {1: ("published", 2), 2: ("published", 0), 3: ("unhandled", 0), 4: ("failed", 2), 5: ("published", 0)}


def test_version_activation(spark):
    from corpusmatch.operators import tables

    rows = [("esco", "1", "active", 5, None), ("esco", "2", "ready", 7, None), ("own", "1", "active", 2, None)]
    versions = spark.createDataFrame(rows, "namespace string, version string, status string, concepts int, error string")
    status = lambda df: {(r.namespace, r.version): r.status for r in df.collect()}
    assert status(tables.activate(versions, "esco", "2", 7)) == {("esco", "1"): "superseded", ("esco", "2"): "active", ("own", "1"): "active"}
    failed = tables.activate(versions, "esco", "2", 8)
    assert status(failed)["esco", "1"] == "active" and failed.where("status = 'failed'").first().error == "found 8 concepts, expected 7"


def test_profiles_from_spans(spark):
    from corpusmatch.operators import profiles

    docs = spark.createDataFrame([(1, "We use Python daily"), (2, "nothing")], "doc_id long, text string")
    rows = [(1, "tool", 7, 13, "Python", 1.7), (1, "Tool", 0, 2, "We", -1.0), (1, "tool", 0, 3, "xyz", 0.5), (1, "tool", 5, 99, "x", 0.5), (1, "tool", None, 2, "We", 0.5)]
    spans = spark.createDataFrame(rows, "doc_id long, label string, start_char int, end_char int, quote string, confidence double")
    out = {r.doc_id: r for r in profiles.with_fallback(docs, profiles.competencies(profiles.verified_spans(docs, spans))).collect()}
    assert [(c.quote, c.category, c.confidence) for c in out[1].kept] == [("We", "other", 0.0), ("Python", "tool", 1.0)]
    assert sorted(c.reason for c in out[1].rejected) == ["bare", "misquoted", "out of bounds"]
    assert (out[2].origin, out[2].review, out[1].origin) == ("structural", True, "neural")


def test_postings_from_pages(spark):
    from corpusmatch.sources import postings

    html = "<a href='/jobs/12-x'>One <b>job</b></a><a href='/jobs/12-x'>again</a><a href='/about'>About</a><a href='/jobs/13'> </a><h1 class='big t'>Title</h1><aside><ul><li><span class='location-text'>Kyiv, Lviv</span><li>Віддалено<li>1 рік досвіду<li>3 роки досвіду<li>$2000-3000</ul></aside>"
    pages_ = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = postings.listing_rows(pages_, "page_id", "html", "https://x.y/", r"/jobs/(\d+)").collect()
    assert [tuple(r) for r in rows] == [(1, "12", "https://x.y/jobs/12-x", "One job")]
    found = postings.detail_fields(pages_, "page_id", "html", {"title": "h1.t", "company": ".none"}).withColumn("s", postings.sidebar(F.col("items"), F.col("places")))
    one = {r.page_id: r for r in found.collect()}[1]
    assert (one.title, one.company, tuple(one.s)) == ("Title", None, ("Kyiv, Lviv", True, "3 роки досвіду", "$2000-3000"))
    parsed = found.select(
        F.col("page_id").cast("string").alias("external_id"), F.lit("u").alias("url"), F.lit(" ").alias("title"), F.lit("Lead cook").alias("listing_title"), F.lit(" Acme ").alias("company"),
        F.lit(None).cast("string").alias("description"), F.lit("text").alias("listing_description"), "s.location", "s.experience", "s.salary", "s.remote",
    )
    union = postings.all_sources({"one": lambda df: postings.normalized(df, "one")}, {"one": parsed})
    assert union.schema.simpleString() == spark.createDataFrame([], postings.POSTING).schema.simpleString()
    row = union.where("external_id = '1'").first()
    assert (row.title, row.company, row.description, row.remote, row.places, row.salary["max"], row.seniority, row.years) == ("Lead cook", "Acme", "text", True, ["Kyiv", "Lviv"], 3000.0, "senior", 3.0)
    with pytest.raises(ValueError):
        postings.all_sources({}, {"one": parsed})


def test_page_blocks():
    html = "<title>T</title><script>x</script><p>Hello <b>wor</b>ld</p><ul><li>one<li>two</ul>tail 😀"
    assert pages.page_blocks(html) == [("title", "T"), ("paragraph", "Hello wor ld"), ("list_item", "one"), ("list_item", "two"), ("paragraph", "tail 😀")]


def test_config_bounds():
    with pytest.raises(ValueError):
        matching.MatchConfig(apply_threshold=40, consider_threshold=50)


def test_taxonomy_release(spark, tmp_path):
    """Repeated URIs join their labels, rows without URI or label and edges without an end go, cells may span lines."""
    from corpusmatch.sources import feeds

    files = {
        "skills": 'conceptUri,skillType,preferredLabel,altLabels\nu1,knowledge,SQL,"structured\nquery"\nu1,knowledge,SQL,sql language\n,knowledge,none,\nu2,,cook,\nu3,,,\n',
        "occupations": "conceptUri,preferredLabel,altLabels\no1,baker,\n",
        "skillGroups": "conceptUri,preferredLabel\n",
        "ISCOGroups": "conceptUri,preferredLabel\ng1,clerks\n",
        "broaderRelationsSkillPillar": "conceptUri,broaderUri\nu2,u1\nu2,u1\nu1,\n",
        "broaderRelationsOccPillar": "conceptUri,broaderUri\no1,g1\n",
        "skillSkillRelations": "originalSkillUri,relationType,relatedSkillUri\nu1,essential,u2\nu2,optional,u1\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}_en.csv").write_text(text)
    concepts = feeds.taxonomy_concepts(spark, str(tmp_path))
    got = {r.concept_id: (r.type, r.label, r.forms) for r in concepts.collect()}
    assert got == {
        "u1": ("knowledge", "SQL", ["SQL", "structured", "query", "sql language"]),
        "u2": ("skill", "cook", ["cook"]),
        "o1": ("occupation", "baker", ["baker"]),
        "g1": ("occupation_group", "clerks", ["clerks"]),
    }
    edges = feeds.taxonomy_relations(spark, str(tmp_path))
    assert {tuple(r) for r in edges.collect()} == {
        ("u2", "u1", "broader"), ("o1", "g1", "broader"), ("u1", "u2", "essential_for"), ("u2", "u1", "optional_for"),
    }
    assert feeds.release_report(concepts, edges).first().asDict() == {"concepts": 4, "surface_forms": 7, "relations": 4}
    assert feeds.checksums(spark, str(tmp_path)).count() == len(files)
    (tmp_path / "skills_uk.csv").write_text("conceptUri,preferredLabel,description\nu1,b,\nu1,a,said\nu1,c,later\n")
    languages, missing = feeds.release_files(spark, str(tmp_path))
    assert languages == ["en", "uk"] and not missing["en"] and len(missing["uk"]) == len(files) - 1 and "occupations_uk.csv" in missing["uk"]
    for name in files:
        if name != "skills":
            (tmp_path / f"{name}_uk.csv").write_text(files[name].split("\n")[0] + "\n")
    one = feeds.taxonomy_concepts(spark, str(tmp_path), "uk").first()
    assert (one.label, one.forms, one.description) == ("b", ["b", "a", "c"], "said")


def test_stream_of_revisions_in_batches(spark, tmp_path):
    """One file a batch gives what the whole history gives at once."""
    from corpusmatch.operators import revisions as rv
    from corpusmatch.streaming import jobs

    rows = [(o, 10 * k + o, c) for k, part in enumerate(("aab", "bac", "dd a".replace(" ", "c"))) for o in (1, 2) for c in part]
    rows = [(o, i, c) for i, (o, _, c) in enumerate(rows)]
    schema = "owner int, ord int, content string"
    for at in range(0, len(rows), 6):
        spark.createDataFrame(rows[at : at + 6], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    columns = ["owner", "ord", "revision_no", "is_new", "reverted"]
    got = jobs.stream_revisions(stream, "owner", "ord", "content").select(*columns)
    want = rv.revisions(spark.createDataFrame(rows, schema), "owner", "ord", "content").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_mentions_cover_whole_benchmark_texts(spark):
    from corpusmatch.plans import queries as plans

    text = " ".join(f"w{k}" for k in range(100))
    tables = {
        "benchmark": spark.createDataFrame([(1, text)], "item_id long, text string"),
        "documents": spark.createDataFrame([(1, "x w70 w71 w72 y w98"), (2, "w80, then w99")], "doc_id long, text string"),
    }
    got = {(r.doc_id, r.start, r.words, r.form) for r in plans._mentions(tables.__getitem__).collect()}
    assert got == {(1, 1, 3, "w70 w71 w72"), (1, 5, 1, "w98"), (2, 0, 1, "w80"), (2, 2, 1, "w99")}


def test_blocks_follow_any_element():
    html = "<form>a</form><figure>b</figure><dl><dt>t<dd>d</dl><div>in <i>x</i><p>p</p>out</div><nav><p>n</p></nav><pre>k\nl</pre>"
    assert pages.page_blocks(html) == [
        ("paragraph", "a"), ("paragraph", "b"), ("heading", "t"), ("paragraph", "d"), ("paragraph", "in x"), ("paragraph", "p"), ("paragraph", "out"), ("paragraph", "k\nl"),
    ]


def test_plain_text_blocks(spark):
    text = "– one\r\n· two\n\t\nplain\u00a0 x\nmore\n— three\n12) four\n-five"
    found, cut = pages.placed(pages.text_blocks(text))
    assert [b[1:3] for b in found] == [("list_item", "– one"), ("list_item", "· two"), ("paragraph", "plain x more"), ("list_item", "— three"), ("list_item", "12) four"), ("paragraph", "-five")]
    whole = "\n".join(b[2] for b in found)
    assert not cut and all(whole[a:b] == t and n == k for k, (n, _, t, a, b) in enumerate(found))
    docs = spark.createDataFrame([(1, "ab\n\ncdef\n\ng"), (2, None), (3, "x")], "doc_id long, text string")
    out = pages.plain_text_blocks(docs, most=4)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, 0, "paragraph", "ab", 0, 2, True), (3, 0, "paragraph", "x", 0, 1, False)]
    at = pages.block_at(pages.plain_text_blocks(docs), spark.createDataFrame([(1, 0), (1, 2), (1, 6), (1, 99)], "doc_id long, at int"), "doc_id", "at")
    assert {r["at"]: r.ordinal for r in at.collect()} == {0: 0, 2: None, 6: 1, 99: None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("050\u00a0123\u00a045\u00a067", "[phone]"), ("050 123 45 67 then 9050 123 45 67890", "[phone] then [phone] 67890"),
        ("12 03 20 24 050 123 45 67", "12 03 20 24 [phone]"), ("Bearer\u00a0abcdefghijklmnopqrst", "Bearer [redacted]"), ("no digits", "no digits"), ("a@b.c 050 123 45 67", "[email] [phone]"),
    ],
)
def test_redaction_where_it_stands(spark, text, want):
    assert value(spark, tx.redact(F.col("t")), t=text) == want


def test_script_profile_counts_letters_only(spark):
    p = tx.script_profile(F.col("t"))
    got = value(spark, F.array(*p.values()), t="é ü ó aż \u0482\u0483ії ы")
    assert got == [8, 3, 2, 2, 1, 1]


def test_counts_of_a_class_replace_runs(spark):
    """A run of other characters is one replacement; each character was one."""
    plan = spark.createDataFrame([("a",)], "text string").select(tx.count_of(F.col("text"), "a"))._jdf.queryExecution().analyzed().toString()
    assert "[^a]+" in plan
    text = "".join(map(chr, [*range(32, 0x590), 0x1F600])) * 3
    got = value(spark, F.struct(*tx.script_profile(F.col("text")).values()), text=text)
    letters = [c for c in text if c.isalpha()]
    assert got[0] == len(letters) and got[1] == sum("\u0400" <= c <= "\u04ff" for c in letters)


def test_filter_reasons_name_values(spark):
    one = lambda x: F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)")
    job = {"company": F.lit("React"), "text": F.lit("PHP and Java"), "years": F.lit(5.0), "salary_max": F.lit(1000.0), "currency": F.lit("USD"), "remote": F.lit(False), "places": one(["Ukraine", "Kyiv"])}
    wish = {"blacklist": one([" react "]), "blocked": one(["php", "go"]), "max_years": F.lit(3.0), "salary": F.lit(2000), "formats": one(["remote"]), "locations": one(["Poland"])}
    assert value(spark, matching.filter_reasons(job, wish), t="") == [
        'company "React" is blacklisted', "mentions blocked stack: php", "requires 5.0+ years, candidate caps at 3.0", "salary tops out at 1000.0 USD, below desired 2000 USD",
        "candidate wants remote-only; job isn't remote", "job restricted to ['Ukraine', 'Kyiv'], outside candidate's ['Poland']",
    ]


def test_stratified_sample_is_a_round_robin(spark):
    """Against the loop over strata in order of (band, language)."""
    import random

    rng = random.Random(3)
    rows = [(k, rng.uniform(-5, 110), rng.choice(["en", "uk", None, "zz"])) for k in range(200)]
    strata = {}
    for k, score, language in sorted(rows, key=lambda r: (-r[1], r[0])):
        strata.setdefault((int(min(max(score, 0), 99.999) // 10 * 10), language or "unknown"), []).append(k)
    want = []
    while len(want) < 50:
        for key in sorted(strata):
            if strata[key] and len(want) < 50:
                want.append(strata[key].pop(0))
    pool = spark.createDataFrame(rows, "id int, score double, language string")
    assert sorted(r.id for r in evaluation.stratified_sample(pool, 50).collect()) == sorted(want)


def test_cosine_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[7] = x[8]
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, [0.0] * 6), (901, [1.0]), (902, None)], "item_id int, vector array<double>")
    users = items.where("item_id < 12 or item_id > 800").withColumnRenamed("item_id", "user_id")
    got = matching.cosine_topk(users, items, 5, queries_a_block=4, item_blocks=3).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for u in range(12):
        want = np.lexsort((np.arange(300), -np.round(unit @ unit[u], 12)))[:5].tolist()
        assert got[got.user_id == u].sort_values("rank").item_id.tolist() == want
    assert got[got.user_id == 901].item_id.tolist() == [901] and not {900, 902} & {*got.user_id}


def test_phrases_of_the_sources(spark):
    df = spark.createDataFrame([("Без досвіду, 2",), ("від 3 років",), ("no number",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.experience_years(F.col("t"))).collect()] == [0.0, 3.0, None, None]
    df = spark.createDataFrame([("Київ,  Львів , віддалено (EU), ",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.cities(F.col("t"))).collect()] == [["Київ", "Львів"], []]
    df = spark.createDataFrame([("<ol><li>x</ol>",), ("a < b",)], "t string")
    assert [r[0] for r in df.select(tx.is_markup(F.col("t"))).collect()] == [True, False]
    df = spark.createDataFrame([(" a\t  b​\n c ",)], "t string")
    assert df.select(tx.block_text(F.col("t"))).first()[0] == "a b\n c"


def test_card_leaves_out_missing_facts(spark):
    match = {"score": F.lit(82.5), "recommendation": F.lit("apply"), "similarity": F.lit(0.5), "relevance": F.lit(None).cast("double")}
    none = F.lit(None).cast("double")
    job = {"title": F.lit('"A" & B'), "company": F.lit("C"), "low": none, "high": none, "currency": F.lit("USD"), "remote": F.lit(False), "level": F.lit("")}
    links = F.array(F.struct(F.lit("site").alias("source"), F.lit("u").alias("url")))
    totals = {"pending": F.lit(1), "approved": F.lit(None).cast("long"), "rejected": F.lit(2)}
    card = spark.range(1).select(render.card(match, job, links, totals)).first()[0]
    assert card.split("\n") == [
        "<b>82% MATCH</b> · APPLY", "", "<b>&quot;A&quot; &amp; B</b> — C", "", "🧮 similarity 50% · not reranked", "",
        '🔗 <a href="u">Site</a>', "", "📊 1 pending · 0 approved · 2 rejected",
    ]


def test_failed_batches_of_an_embedder_stay_for_the_next_pass(spark):
    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts if t != "lost"]

    df = spark.createDataFrame([(0, "a"), (1, None), (2, "bad"), (3, "b"), (4, "lost"), (5, "c"), (6, "dd")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["vector"], r["error"]) for r in bt.embed_texts(df, "id", "t", embedder, 2).collect()}
    assert got[0] == ([1.0], None) and got[1] == ([0.0], None) and got[6] == ([2.0], None)
    assert got[2] == got[3] == (None, "ValueError: no") and got[4] == got[5] == (None, "1 vectors for 2 texts")
    assert bt.embed_texts(df.limit(0), "id", "t", embedder).count() == 0


def test_stored_texts_of_either_form(spark):
    rows = [(1, "a < b\n\n- one", None), (2, "<h1>T</h1><p>x  y</p>", "de"), (3, None, "en"), (4, " \n", None)]
    df = spark.createDataFrame(rows, "id long, text string, language string")
    got = {r["id"]: r for r in pages.parsed_revisions(df.drop("text"), pages.stored_blocks(df, "id", "text"), "id").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["parsed", "parsed", "failed", "failed"]
    assert got[2]["parsed_text"] == "T\nx y" and got[2]["language"] == "de" and got[2]["n_blocks"] == 2
    assert got[1]["parsed_text"].startswith("a < b\n") and got[1]["n_blocks"] == 2
    assert got[3]["parsed_text"] is None and got[3]["language"] == "en" and got[4]["error"] == "no text found"


def test_stored_texts_are_parsed_to_their_end(spark):
    """All blocks after 200 000 characters were left out, and a text of one block over that had failed."""
    line, n = "одна довга стрічка із досить багатьма літерами", 6000
    rows = [(1, f"{line}\n\n" * n, None), (2, f"<p>{line}</p>" * n, None), (3, "x" * 200_001, "en"), (4, "short", "en")]
    df = spark.createDataFrame(rows, "id long, text string, language string")
    blocks = pages.stored_blocks(df, "id", "text")
    got = {r["id"]: r for r in pages.parsed_revisions(df.drop("text"), blocks, "id").collect()}
    assert got[1]["parsed_text"] == got[2]["parsed_text"] == "\n".join([line] * n) and got[1]["n_blocks"] == got[2]["n_blocks"] == n
    assert got[1]["language"] == "uk" and got[3]["parsed_text"] == "x" * 200_001 and got[3]["status"] == got[4]["status"] == "parsed"
    assert blocks.where("truncated").count() == 0


def test_resets_and_owners_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k long, s string")
    got = tb.reset_counts({"a": (df, F.col("s") == "x"), "b": (df.limit(0), F.lit(True))})
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 0)}
    users = spark.createDataFrame([(1, "u2"), (1, "u1"), (None, "u3")], "k long, user string")
    assert {tuple(r) for r in tb.resolved_owners(df, users, "k", "user").collect()} == {(1, "x", "u1"), (2, None, None)}


def test_cheap_patterns_find_what_plain_ones_do(spark):
    """Looking at marks and words first changes no text, in odd mixtures of blanks, line ends, digits and marks."""
    rng = random.Random(5)
    pieces = ["a@b.c", "@", "x.y+z@q-r.s.t", " ", "  ", "\t", "\n", "\n\n\n", "\r", "\x0b", " ", "\u0085", " ", "+", "00", "12", "٣٤", "3456", "(", ")", "-", "–", ".", "ж", "bearer abcdefghij0123456789", "?token=x", "0", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 24))) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    steps = (
        (r"bot\d{6,}:[A-Za-z0-9_-]{20,}", "bot[redacted]"), (r"(?iU)\b(bearer)\s+[A-Za-z0-9._~+/-]{16,}=*", "$1 [redacted]"), (r"(?iU)([?&](?:api[_-]?key|token|secret|access[_-]?token|password)=)[^&\s]+", "$1[redacted]"),
        (r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[email]"), (r"(?U)(?:\+|\b00)\d[\d\s().‐-―-]{6,}\d", "[phone]"),
    )
    hidden = t
    for pattern, mark in steps:
        hidden = F.regexp_replace(hidden, pattern, mark)
    grouped = r"(?U)\b\(?\d{2,4}\)?(?:[\s.‐-―-]\d{2,4}){2,3}\b"
    runs = F.transform(F.regexp_extract_all(hidden, F.lit(f"({grouped})"), F.lit(1)), lambda m: F.when(F.length(F.regexp_replace(m, r"(?U)\D", "")) >= 9, "[phone]").otherwise(m))
    hidden = F.array_join(F.zip_with(F.split(hidden, grouped, -1), runs, lambda part, run: F.concat(part, F.coalesce(run, F.lit("")))), "")
    assert df.where(~tx.collapse(t).eqNullSafe(plain)).count() == 0
    assert df.where(~tx.redact(t).eqNullSafe(hidden)).count() == 0
    assert df.where(hidden != t).count() > 1000
    label = lambda text: F.when(F.trim(text) != "", F.concat(F.lit("[CV]\n"), F.trim(text)))
    for first in ("", "[A]\n\n\n\nx  y \n"):
        own = F.substring(render.collapse(F.concat_ws("\n\n", F.nullif(F.lit(first), F.lit("")), label(tx.redact(tx.collapse(t))))), 1, 30)
        assert df.where(~render.sections(F.nullif(F.lit(first), F.lit("")), limit=30, last=("CV", tx.redact(tx.collapse(t)))).eqNullSafe(own)).count() == 0


def test_a_long_text_is_worked_out_once(spark):
    """The CV, and a posting's description, are redacted once, though more than one field may hold them."""
    none, text = F.expr("cast(array() as array<string>)"), F.col("t")
    made = render.candidate_representations(none, none, none, F.expr("cast(array() as array<struct<necessity:string,name:string>>)"), none, text)
    plan = spark.createDataFrame([("x",)], "t string").select(made.alias("fields"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[email]") == 1


class _Taken:
    """Stands for a table: runs what is mapped over it on one batch of its own, and says how many rows came out at a time."""

    def __init__(self, batch):
        self.batch = batch
        self.schema = {n: T.StructField(n, T.LongType() if n == "id" else T.StringType()) for n in batch.schema.names}

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return [part.num_rows for part in run(iter([self.batch]))]


def test_texts_become_objects_in_small_parts():
    """A batch of 10 000 texts was one list of Python objects, with all that was made of it."""
    rows = _Taken(pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["<p>one</p>"] * 1000}))
    for made in (pages.html_text(rows, "id", "text"), pages.html_blocks(rows, "id", "text"), pages.plain_text_blocks(rows, "id", "text")):
        assert sum(made) == 1000 and max(made) <= 200
    made = bt.embed_texts(rows, "id", "text", lambda texts: [[1.0]] * len(texts))
    assert sum(made) == 1000 and max(made) <= 32


def test_owners_of_repeated_rows(spark):
    """Repeated rows change nothing, and no aggregate holds all keys for it."""
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (None, 3)], "user_id long, event_id long")
    yes, no = tb.owned(rows, spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 3)], "user_id long, event_id long"), ["user_id", "event_id"])
    assert sorted(map(tuple, yes.collect())) == [(1, 1), (1, 1)] and {tuple(r) for r in no.collect()} == {(2, 1), (None, 3)}
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in (yes, no))
