"""Queries over chains of rows: ancestors, cascades, lifecycles of revisions, parses and their blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmatch.operators import graph as gr
from corpusmatch.operators import neardup as nd
from corpusmatch.operators import profiles as pf
from corpusmatch.operators import revisions as rv
from corpusmatch.operators.storage import shared_folder
from corpusmatch.plans.registry import query
from corpusmatch.sources import pages as pg


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders WHERE o_orderkey // 3 <> o_orderkey UNION SELECT o_orderkey, o_orderkey - 2 FROM orders WHERE o_orderkey % 100 = 2
 UNION SELECT o_orderkey, o_orderkey + 7 FROM orders WHERE o_orderkey % 1000 = 0),
r AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM e UNION SELECT r.node, e.parent, r.distance + 1 FROM r JOIN e ON e.child = r.ancestor WHERE r.distance < 40)
SELECT node, ancestor, CAST(min(distance) AS BIGINT) AS distance FROM r WHERE node <> ancestor GROUP BY 1, 2""")
def concept_ancestors(t):
    """A tree over orders, some with a second parent, and cycles: 0 is under 7, which is under 0."""
    key = F.col("o_orderkey")
    up = F.array(F.expr("o_orderkey div 3"), F.when(key % 100 == 2, key - 2), F.when(key % 1000 == 0, key + 7))
    return gr.ancestors(t("orders").select(key.alias("child"), F.explode(up).alias("parent")))


#: Customers without an order since then are stale. What hangs on them, level by level, and parts that only lost orders name.
_CASCADE = """jobs AS (SELECT c_custkey AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1999-06-01'),
matches AS (SELECT event_id AS k FROM events WHERE user_id IN (FROM jobs)),
notifications AS (SELECT event_id + 1 AS k FROM events WHERE event_type <> 'view' AND event_id IN (FROM matches)),
deliveries AS (SELECT event_id + 2 AS k FROM events WHERE event_type <> 'view' AND value > 10 AND event_id + 1 IN (FROM notifications)),
vectors AS (SELECT vec_id AS k FROM embeddings WHERE vec_id IN (FROM jobs)),
records AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (FROM jobs)),
revisions AS (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE l_orderkey IN (FROM records)),
profiles AS (SELECT (l_orderkey * 10 + l_linenumber) * 2 AS k FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey * 10 + l_linenumber IN (FROM revisions)),
mentions AS (SELECT (l_orderkey * 10 + l_linenumber) * 4 AS k FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey * 10 + l_linenumber) * 2 IN (FROM profiles)),
raws AS (SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey * 10 + l_linenumber IN (FROM revisions)) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey * 10 + l_linenumber NOT IN (FROM revisions)))"""
_LEVELS = ("jobs", "matches", "notifications", "deliveries", "vectors", "records", "revisions", "profiles", "mentions", "raws")


@query(f"WITH {_CASCADE} " + " UNION ALL ".join(f"SELECT '{n}' AS entity, count(DISTINCT k) AS rows FROM {n}" for n in _LEVELS))
def cascade_counts(t):
    e, number = t("events"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    said = e.where("event_type <> 'view'")
    lines = t("lineitem").withColumn("number", number)
    tables = {
        "jobs": gr.Table(t("customer"), "c_custkey"), "matches": gr.Table(e, "event_id"),
        "notifications": gr.Table(said.select((F.col("event_id") + 1).alias("id"), F.col("event_id").alias("match_id")), "id"),
        "deliveries": gr.Table(said.where("value > 10").select((F.col("event_id") + 2).alias("id"), (F.col("event_id") + 1).alias("notification_id")), "id"),
        "vectors": gr.Table(t("embeddings").select("vec_id", F.col("vec_id").alias("job_id")), "vec_id"), "records": gr.Table(t("orders"), "o_orderkey"), "revisions": gr.Table(lines, "number"),
        "profiles": gr.Table(lines.where("l_returnflag <> 'N'").select((F.col("number") * 2).alias("id"), "number"), "id"),
        "mentions": gr.Table(lines.where("l_returnflag = 'R'").select((F.col("number") * 4).alias("id"), (F.col("number") * 2).alias("profile_id")), "id"),
        "raws": gr.Table(t("part"), "p_partkey"),
    }
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")).where(F.col("last") < F.lit("1999-06-01").cast("timestamp_ntz"))
    rules = [
        gr.Link("matches", "user_id", "jobs"), gr.Link("notifications", "match_id", "matches"), gr.Link("deliveries", "notification_id", "notifications"), gr.Link("vectors", "job_id", "jobs"),
        gr.Link("records", "o_custkey", "jobs"), gr.Link("revisions", "l_orderkey", "records"), gr.Link("profiles", "number", "revisions"), gr.Link("mentions", "profile_id", "profiles"), gr.Orphan("raws", "revisions", "l_partkey"),
    ]
    return gr.cascade_counts(gr.cascade(tables, {"jobs": last.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")}, rules))


_STEPS = {"signup": ("view", "click"), "view": ("click", "view", "error"), "click": ("purchase", "view", "error"), "purchase": ("view",), "error": ("view",)}


@query(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
a(f, t) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, vs in _STEPS.items() for v in vs)}),
r AS (SELECT user_id, 0::BIGINT AS nth, NULL::BIGINT AS event_id, NULL::VARCHAR AS from_status, 'signup' AS status, NULL::VARCHAR AS failure_code, false AS legal, NULL::VARCHAR AS reason FROM events GROUP BY 1
 UNION ALL SELECT r.user_id, n.nth, n.event_id, r.status, CASE WHEN a.t IS NULL THEN r.status ELSE n.event_type END, CASE WHEN a.t IS NULL THEN r.failure_code WHEN n.event_type = 'error' THEN n.props END, a.t IS NOT NULL,
 CASE WHEN a.t IS NOT NULL THEN CASE WHEN n.value > 50 THEN 'by hand' ELSE n.props END END
 FROM r JOIN n ON n.user_id = r.user_id AND n.nth = r.nth + 1 LEFT JOIN a ON a.f = r.status AND a.t = n.event_type)
SELECT user_id, event_id, from_status, status, failure_code, legal, reason FROM r WHERE nth > 0""")
def revision_lifecycle(t):
    """Refused requests leave the status as it was; leaving a failure clears its code."""
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("target"), F.col("props").alias("code"), F.lit(None).cast("string").alias("detail"), F.when(F.col("value") > 50, "by hand").alias("reason"))
    out = rv.lifecycle(e, "user_id", "event_id", _STEPS, "signup", failed="error")
    return out.select("user_id", "event_id", "from_status", "status", "failure_code", "legal", "reason")


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS kept, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS rejected, length(text) > 3000 AS truncated FROM documents WHERE length(text) > 0""")
def span_reports(t):
    """Spans of the last character of the first 3000, or of one more than there is; documents that go on are flagged."""
    d = t("documents").where(F.length("text") > 0)
    end = F.least(F.length("text"), F.lit(3000)) + F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1)
    spans = d.select("doc_id", F.lit("tool").alias("label"), (end - 1).alias("start_char"), end.alias("end_char"), F.expr("substring(text, least(length(text), 3000) + if(n_chars % 3 = 0, 0, 1), 1)").alias("quote"), F.lit(1.0).alias("confidence"))
    return pf.span_report(pf.verified_spans(d, spans.withColumn("quote", F.when(F.col("quote") == "", "x").otherwise(F.col("quote"))), 3000)).drop("warning")


@query()
def parsed_store(t):
    """All pages and documents parsed into a store, twice the even ones; blocks and texts come from the same parse."""
    pages = t("pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = pages.unionByName(t("documents").select((-F.col("doc_id") - 1).alias("id"), "text"))
    store = pg.ParseStore(both.sparkSession, shared_folder(both.sparkSession, "parses"))
    store.commit(pg.parsed_documents(both.withColumn("text", F.concat(F.lit("old "), "text")), "id", "text"), 1)
    store.commit(pg.parsed_documents(both.where("id % 2 = 0"), "id", "text"), 2)
    blocks = store.blocks("id").groupBy("id").agg(F.count("*").alias("found"), F.max("end_char").alias("end"), F.bool_and(F.length("text") == F.col("end_char") - F.col("start_char")).alias("places_hold"))
    return store.texts("id").join(blocks, "id", "left").select("id", "version", F.length("parsed_text").alias("length"), "n_blocks", "found", "end", "places_hold", "truncated", "error")


@query()
def near_duplicate_clusters(t):
    return nd.near_duplicate_clusters(t("documents"))
