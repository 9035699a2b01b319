"""Registered queries: each operator over the given tables, with the same result in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmatch.functions import render, text as tx
from corpusmatch.operators import batching as bt
from corpusmatch.operators import clustering as cl
from corpusmatch.operators import evaluation as ev
from corpusmatch.operators import linking as ln
from corpusmatch.operators import matching as mt
from corpusmatch.operators import profiles as pf
from corpusmatch.operators import relinking as rl
from corpusmatch.operators import review as rw
from corpusmatch.operators import revisions as rv
from corpusmatch.operators import tables as tb
from corpusmatch.operators.storage import dealt, written
from corpusmatch.plans import graphs, registry, retrieval, upkeep  # noqa: F401  all but the registry add their own queries
from corpusmatch.sources import feeds as fd
from corpusmatch.sources import pages as pg
from corpusmatch.sources import postings as po
from corpusmatch.streaming import jobs as st

_QUERIES, _SQL, _query = registry.QUERIES, registry.SQL, registry.query


def _stream_query(table: str, sql: str):
    """A query over a table that is read as a file stream."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = f"{sf_dir}/{table}.parquet"
            # As a pattern it may name one file as well as a folder of parts.
            return f(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{table}.parque[t]"))

        _QUERIES[f.__name__], _SQL[f.__name__] = run, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(c, digits: int = 4):
    return tx.round_score(c, digits)


_CONFIG = mt.MatchConfig(retrieval_limit=50)
_COSINE = """
q AS (SELECT vec_id AS user_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
i AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE true),
s AS (SELECT user_id, item_id, list_cosine_similarity(v, qv) AS similarity FROM q, i WHERE user_id <> item_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) AS rank FROM s) WHERE rank <= 50)
"""


def _cosine(t) -> DataFrame:
    e = t("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    users = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("user_id"), "vector")
    # One more than asked for, as a query's own row is among all rows.
    found = mt.cosine_topk(users, e.select(F.col("vec_id").alias("item_id"), "vector"), _CONFIG.retrieval_limit + 1).where("user_id <> item_id")
    return tb.top_per_key(found.drop("rank"), ["user_id"], _CONFIG.retrieval_limit, F.desc("similarity"), F.asc("item_id"))


@_query("WITH " + _COSINE + " SELECT user_id, item_id, rank FROM k")
def cosine_topk(t):
    return _cosine(t).select("user_id", "item_id", "rank")


@_query("WITH " + _COSINE + """,
f AS (SELECT k.*, p_size, p_retailprice, p_size > 40 AS far, p_retailprice < 950 AS poor,
        CASE WHEN item_id % 4 = 0 THEN NULL ELSE (item_id * 37 % 100) / 100.0::DOUBLE END AS relevance
      FROM k JOIN part ON p_partkey = item_id),
g AS (SELECT *, NOT far AND NOT poor AS eligible FROM f),
h AS (SELECT *, CASE WHEN eligible THEN relevance END AS used FROM g),
b AS (SELECT *, CASE WHEN NOT eligible THEN 0.0
        WHEN used IS NULL THEN floor(least(greatest(similarity, 0.0), 1.0) * 100 * 10 + 0.5) / 10
        ELSE floor((0.7::DOUBLE * least(greatest(used, 0.0), 1.0) + (1 - 0.7::DOUBLE) * least(greatest(similarity, 0.0), 1.0)) * 100 * 10 + 0.5) / 10 END AS score FROM h)
SELECT user_id, item_id, eligible,
       concat_ws('; ', CASE WHEN far THEN 'requires ' || CAST(p_size AS DOUBLE) || '+ years, candidate caps at 40.0' END,
         CASE WHEN poor THEN 'salary tops out at ' || CAST(p_retailprice AS DOUBLE) || ' USD, below desired 950 USD' END) AS reasons,
       score,
       CASE WHEN used IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY used DESC NULLS LAST, item_id) AS INTEGER) END AS rerank_position,
       CASE WHEN NOT eligible THEN 'skip' WHEN score >= 70 THEN 'apply' WHEN score >= 45 THEN 'consider' ELSE 'skip' END AS recommendation
FROM b""")
def match_pass(t):
    facts = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_name")
    pairs = _cosine(t).join(facts, F.col("item_id") == F.col("p_partkey"))
    empty = F.expr("cast(array() as array<string>)")
    job = {"company": F.col("p_brand"), "text": F.col("p_name"), "years": F.col("p_size"), "salary_max": F.col("p_retailprice"), "currency": F.lit("USD"), "remote": F.lit(True), "places": empty}
    wish = {"blacklist": empty, "blocked": empty, "max_years": F.lit(40), "salary": F.lit(950), "formats": empty, "locations": empty}
    relevance = F.when(F.col("item_id") % 4 != 0, (F.col("item_id") * 37 % 100) / 100.0)
    pairs = pairs.withColumn("reasons", mt.filter_reasons(job, wish)).withColumn("relevance", relevance)
    out = mt.match_pass(pairs, _CONFIG)
    return out.select("user_id", "item_id", "eligible", F.array_join("reasons", "; ").alias("reasons"), "score", "rerank_position", "recommendation")


@_query("""
SELECT p_partkey, w.user_id, concat_ws('; ',
  CASE WHEN lower(trim(p_brand)) = w.listed THEN 'company "' || p_brand || '" is blacklisted' END,
  CASE WHEN regexp_matches(p_type, '(?i)\\b' || w.kw || '\\b') THEN 'mentions blocked stack: ' || w.kw END,
  CASE WHEN p_size > w.max_years THEN 'requires ' || CAST(p_size AS DOUBLE) || '+ years, candidate caps at ' || CAST(w.max_years AS DOUBLE) END,
  CASE WHEN p_retailprice < w.salary THEN 'salary tops out at ' || CAST(p_retailprice AS DOUBLE) || ' USD, below desired ' || CAST(w.salary AS BIGINT) || ' USD' END,
  CASE WHEN w.remote_only AND p_partkey % 2 = 1 THEN 'candidate wants remote-only; job isn''t remote' END,
  CASE WHEN w.place <> '' AND NOT (contains(lower(split_part(p_type, ' ', 1)), w.place) OR contains(w.place, lower(split_part(p_type, ' ', 1)))) THEN 'job restricted to [''' || split_part(p_type, ' ', 1) || '''' || '], outside candidate''s [''' || w.place || '''' || ']' END) AS reasons
FROM part, (VALUES ('a', 'brand#11', 'copper', 30, 950.0, false, ''), ('b', 'brand#22', 'tin', 45, 1000.0, true, 'promo'), ('c', 'none', 'steel', 50, 0.0, false, 'standard')) w(user_id, listed, kw, max_years, salary, remote_only, place)""")
def hard_filter_reasons(t):
    part = t("part")
    rows = F.explode(F.array(*(
        F.struct(F.lit(u).alias("user_id"), F.lit(c).alias("listed"), F.lit(k).alias("kw"), F.lit(y).alias("max_years"), F.lit(s).alias("salary"), F.lit(r).alias("remote"), F.lit(p).alias("place"))
        for u, c, k, y, s, r, p in (("a", "brand#11", "copper", 30, 950.0, False, ""), ("b", "brand#22", "tin", 45, 1000.0, True, "promo"), ("c", "none", "steel", 50, 0.0, False, "standard"))
    ))).alias("w")
    df = part.select("*", rows)
    none = F.expr("cast(array() as array<string>)")
    job = {"company": F.col("p_brand"), "text": F.col("p_type"), "years": F.col("p_size"), "salary_max": F.col("p_retailprice"), "currency": F.lit("USD"), "remote": F.col("p_partkey") % 2 == 0, "places": F.array(F.split_part("p_type", F.lit(" "), F.lit(1)))}
    wish = {"blacklist": F.array("w.listed"), "blocked": F.array("w.kw"), "max_years": F.col("w.max_years"), "salary": F.col("w.salary"), "formats": F.when(F.col("w.remote"), F.array(F.lit("remote"))).otherwise(none), "locations": F.when(F.col("w.place") != "", F.array("w.place")).otherwise(none)}
    return df.select("p_partkey", "w.user_id", F.array_join(mt.filter_reasons(job, wish), "; ").alias("reasons"))


_DECISION = "CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END"


@_query(f"SELECT count(*) FILTER (d = 'pending') AS pending, count(*) FILTER (d = 'approved') AS approved, count(*) FILTER (d = 'rejected') AS rejected FROM (SELECT {_DECISION} AS d FROM events)")
def decision_pivot(t):
    d = t("events").select(F.expr(_DECISION).alias("d"))
    return d.groupBy().pivot("d", ["pending", "approved", "rejected"]).count()


@_query("SELECT CASE WHEN value >= 70 THEN 'apply' WHEN value >= 45 THEN 'consider' ELSE 'skip' END AS recommendation, count(*) AS n FROM events GROUP BY 1")
def band_counts(t):
    return t("events").groupBy(mt.band(F.col("value"), mt.MatchConfig()).alias("recommendation")).agg(F.count("*").alias("n"))


@_query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def latest_per_key(t):
    return tb.latest_per_key(t("events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "ts")


_REV = """WITH h AS (SELECT {owner} AS owner, {ord} AS ord, sha256({content}) AS content_hash FROM {table}),
a AS (SELECT *, row_number() OVER (PARTITION BY owner, content_hash ORDER BY ord) = 1 AS is_new FROM h),
b AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY owner ORDER BY ord ROWS UNBOUNDED PRECEDING) AS newest FROM a),
c AS (SELECT *, min(newest) OVER (PARTITION BY owner, content_hash) AS revision_no FROM b)
SELECT owner, ord, CAST(revision_no AS BIGINT) AS revision_no, is_new, NOT is_new AND revision_no < newest AS reverted FROM c"""


@_query(_REV.format(owner="conv_id", ord="turn", content="text", table="conversations"))
def revision_numbers(t):
    out = rv.revisions(t("conversations"), "conv_id", "turn", "text")
    return out.select(F.col("conv_id").alias("owner"), F.col("turn").alias("ord"), "revision_no", "is_new", "reverted")


@_query(_REV.format(owner="user_id", ord="event_id", content="event_type", table="events"))
def reverted_revisions(t):
    out = rv.revisions(t("events"), "user_id", "event_id", "event_type")
    return out.select(F.col("user_id").alias("owner"), F.col("event_id").alias("ord"), "revision_no", "is_new", "reverted")


_EDGES = (("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("error", "view"), ("purchase", "view"))


@_query(f"""WITH s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status, event_type AS to_status FROM events)
SELECT user_id, event_id, from_status, to_status, from_status IS NULL OR (from_status, to_status) IN ({', '.join(f"('{a}', '{b}')" for a, b in _EDGES)}) AS legal FROM s""")
def transition_audit(t):
    e = t("events")
    edges = e.sparkSession.createDataFrame(_EDGES, "from_status string, to_status string")
    return rv.transitions(e, "user_id", "event_id", "event_type", edges).select("user_id", "event_id", "from_status", "to_status", "legal")


@_query("""WITH c AS (SELECT DISTINCT user_id AS source, category FROM events, (VALUES ('signup'), ('view'), ('click'), ('purchase'), ('error'), ('refund')) v(category)),
l AS (SELECT user_id AS source, event_type AS category, max(ts) AS last FROM events WHERE value > 20 GROUP BY 1, 2)
SELECT source, category, last FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last NULLS FIRST, category) n FROM c LEFT JOIN l USING (source, category)) WHERE n = 1""")
def category_rotation(t):
    e = t("events").select(F.col("user_id").alias("source"), F.col("event_type").alias("category"), "ts", "value")
    names = F.explode(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error", "refund"))))
    every = e.select("source").distinct().select("source", names.alias("category"))
    last = tb.missing_categories(e.where("value > 20"), every, ["source", "category"], "ts")
    return tb.latest_per_key(last, ["source"], F.asc_nulls_first("last"), F.asc("category")).select("source", "category", "last")


@_query("""WITH g AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-01-01'),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM g))
SELECT 'keys' AS entity, count(*) AS purged FROM g UNION ALL SELECT 'parents', count(*) FROM o
UNION ALL SELECT 'children', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def stale_purge_counts(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    items = t("lineitem").select("l_orderkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return tb.purge_counts(orders, items, "o_custkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))


@_query("""SELECT event_id, user_id, value FROM events e LEFT JOIN customer ON c_custkey = user_id
WHERE event_type <> 'error' AND value >= CASE WHEN c_nationkey < 12 THEN 40 ELSE 70 END AND NOT (CASE WHEN c_nationkey < 12 THEN hour(ts) >= 1 AND hour(ts) < 6 ELSE hour(ts) >= 22 OR hour(ts) < 8 END)
AND coalesce(c_acctbal > 0, true) AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_id = e.event_id + 150)""")
def notify_candidates(t):
    """Users of the first nations have settings of their own, the others the defaults."""
    own = F.col("c_nationkey") < 12
    settings = t("customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(own, 40).alias("least"), F.when(own, 1).alias("start"), F.when(own, 6).alias("end")
    )
    e = t("events").join(settings, "user_id", "left")
    fits = mt.should_notify(F.col("enabled"), F.col("event_type") != "error", F.col("value"), F.col("least"), F.hour("ts"), F.col("start"), F.col("end"))
    delivered = t("events").select("user_id", (F.col("event_id") - 150).alias("event_id"))
    return e.where(fits).join(delivered, ["user_id", "event_id"], "left_anti").select("event_id", "user_id", "value")


@_query("""SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def posting_page(t):
    o = t("orders").where("o_orderstatus <> 'P'").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(50).select("o_orderkey", "c_name", "o_totalprice")


@_query("""SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash,
CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents""")
def embed_pending(t):
    docs = t("documents").select("doc_id", tx.text_hash(F.col("text")).alias("content_hash"))
    stored = t("documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("stored_id"), tx.text_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("*"))).otherwise(F.col("text"))).alias("stored"))
    both = docs.join(stored, F.col("doc_id") == F.col("stored_id"), "left")
    state = F.when(F.col("stored_id").isNull(), "new").when(F.col("stored").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    return both.select("doc_id", "content_hash", state.alias("state"))


@_query("""SELECT p_partkey, 'TITLE: ' || p_name || chr(10) || 'COMPANY: ' || p_brand || coalesce(chr(10) || 'EXPERIENCE REQUIRED: ' || nullif(p_size, 0) || '+ years', '')
|| chr(10) || 'WORK FORMAT: ' || CASE WHEN p_partkey % 2 = 0 THEN 'remote' ELSE 'on-site or hybrid' END || chr(10) || 'LOCATION: ' || n_name
|| chr(10) || 'COMPENSATION: ' || CAST(trunc(p_retailprice) AS BIGINT) || ' USD' || chr(10) || 'DESCRIPTION: ' || p_type AS document
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey""")
def posting_document(t):
    supplier = t("supplier").select("s_suppkey", "s_nationkey").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = t("supplier").agg(F.count("*").alias("n"))
    part = t("part").join(F.broadcast(n)).join(supplier, F.col("s_suppkey") == F.col("p_partkey") % F.col("n"))
    doc = render.job_document(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_size").cast("double"), F.col("p_partkey") % 2 == 0, F.array("n_name"), F.lit(None).cast("double"), F.col("p_retailprice"), F.lit("USD"), F.col("p_type"))
    return part.select("p_partkey", doc.alias("document"))


_SECTION = "CASE WHEN trim({1}) <> '' THEN '[{0}]' || chr(10) || trim({1}) END"
_PARTS = {
    "role": _SECTION.format("ROLE", "p_name"), "level": _SECTION.format("SENIORITY", "level"), "jobs": _SECTION.format("OCCUPATIONS", "p_brand"),
    "req": _SECTION.format("REQUIRED COMPETENCIES", "w[1]"), "pref": _SECTION.format("PREFERRED COMPETENCIES", "w[2]"), "rest": _SECTION.format("COMPETENCIES", "p_brand || '; ' || p_name"), "canon": _SECTION.format("CANONICAL COMPETENCIES", "p_type"),
    "years": _SECTION.format("EXPERIENCE", "years || '+ years required'"), "duty": _SECTION.format("RESPONSIBILITIES", "duty"), "place": "'[WORK FORMAT]' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'remote' ELSE 'on-site or hybrid' END",
    "pay": _SECTION.format("COMPENSATION", "pay"), "text": _SECTION.format("DESCRIPTION", "descr"),
}


@_query(f"""WITH p AS (SELECT *, string_split(p_name, ' ') AS w, CASE WHEN p_size % 3 = 0 THEN 'senior' END AS level, CASE WHEN p_size >= 10 THEN p_size END AS years, CASE WHEN p_size % 4 = 0 THEN repeat(p_name || chr(10), 59) || p_name END AS duty,
 CASE WHEN p_size % 5 <> 0 THEN CAST(trunc(p_retailprice) AS BIGINT) || ' USD' END AS pay, trim(repeat(p_name || ' ' || p_type || ' ', 100)) AS descr FROM part),
x AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in _PARTS.items())} FROM p)
SELECT p_partkey, field, body FROM (SELECT p_partkey, unnest(['occupation', 'competencies', 'experience', 'responsibilities', 'full_profile']) AS field,
 unnest([substr(concat_ws(chr(10) || chr(10), role, level, jobs), 1, 1200), substr(concat_ws(chr(10) || chr(10), req, pref, rest, canon), 1, 1200), years, substr(duty, 1, 1200),
 substr(concat_ws(chr(10) || chr(10), role, level, years, place, pay, text), 1, 4000)]) AS body FROM x) WHERE body <> ''""")
def field_representations(t):
    p, w, size = dealt(t("part")), F.split("p_name", " "), F.col("p_size")
    one = lambda need, name: F.struct(F.lit(need).cast("string").alias("necessity"), name.alias("name"))
    items = F.array(one("required", w[0]), one("preferred", w[1]), one("preferred", F.lower(w[1])), one(None, F.col("p_brand")), one("optional", F.col("p_name")))
    duty = F.when(size % 4 == 0, F.array_repeat("p_name", 60))
    made = render.job_representations(
        F.col("p_name"), F.when(size % 3 == 0, "senior"), F.array("p_brand", F.upper("p_brand"), F.lit(None)), items, F.array("p_type"), F.when(size >= 10, size.cast("double")).otherwise(0.0), duty,
        F.col("p_partkey") % 2 == 0, F.when(size % 5 != 0, F.col("p_retailprice")).otherwise(0.0), F.lit(None).cast("double"), F.lit("USD"), F.repeat(F.concat("p_name", F.lit("  "), "p_type", F.lit("\t")), F.lit(100)),
    )
    return p.select("p_partkey", F.explode(made).alias("f")).select("p_partkey", "f.field", "f.body")


@_query(r"""SELECT s_suppkey AS id, trim(regexp_replace(regexp_replace(lower(s_name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM supplier
UNION ALL SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '- ' || p_brand), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) FROM part""")
def normalize_names(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), tx.normalize_company(F.concat("s_name", F.lit(", Inc."))).alias("name"))
    return s.unionByName(t("part").select(F.col("p_partkey").alias("id"), tx.normalize_title(F.concat("p_name", F.lit("- "), "p_brand")).alias("name")))


@_query("""SELECT sha256(text) AS content_hash, count(*) AS members, min(doc_id) AS representative, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("members"), F.min("doc_id").alias("representative"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.where("members > 1")


_CLASSES = {"letters": r"\p{L}", "cyrillic": r"\x{0400}-\x{0481}\x{048A}-\x{04FF}", "latin": "A-Za-z" + tx.POLISH, "uk_marks": tx.UKRAINIAN, "ru_marks": tx.RUSSIAN, "pl_marks": tx.POLISH}
_PROFILE = ", ".join(f"CAST(length(regexp_replace(text, '[^{c}]', '', 'g')) AS INTEGER) AS {n}" for n, c in _CLASSES.items())


@_query(f"SELECT doc_id, {_PROFILE} FROM documents")
def script_profile(t):
    return t("documents").select("doc_id", *(c.alias(n) for n, c in tx.script_profile(F.col("text")).items()))


@_query(f"""SELECT conv_id, turn, CASE WHEN letters < 20 THEN NULL WHEN cyrillic > latin THEN
CASE WHEN uk_marks / cyrillic >= 0.02 AND NOT ru_marks / cyrillic >= 0.02 THEN 'uk' WHEN ru_marks / cyrillic >= 0.02 AND NOT uk_marks / cyrillic >= 0.02 THEN 'ru'
WHEN uk_marks / cyrillic >= 0.02 THEN CASE WHEN uk_marks >= ru_marks THEN 'uk' ELSE 'ru' END END
WHEN latin > 0 THEN CASE WHEN pl_marks / latin >= 0.02 THEN 'pl' ELSE 'en' END END AS language FROM (SELECT conv_id, turn, {_PROFILE} FROM conversations)""")
def detect_language(t):
    return t("conversations").select("conv_id", "turn", tx.detect_language(F.col("text")).alias("language"))


_BLANK = r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_RUN = rf"\b\(?\d{{2,4}}\)?(?:[{_BLANK}.‐-―-]\d{{2,4}}){{2,3}}\b"


@_query(rf"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, 'bot\d{{6,}}:[A-Za-z0-9_-]{{20,}}', 'bot[redacted]', 'g'),
 '(?i)\b(bearer)[{_BLANK}]+[A-Za-z0-9._~+/-]{{16,}}=*', '\1 [redacted]', 'g'), '(?i)([?&](?:api[_-]?key|token|secret|access[_-]?token|password)=)[^&{_BLANK}]+', '\1[redacted]', 'g') AS b FROM documents),
c AS (SELECT doc_id, text, regexp_replace(regexp_replace(b, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+', '[email]', 'g'), '(?:\+|\b00)\d[\d{_BLANK}().‐-―-]{{6,}}\d', '[phone]', 'g') AS b FROM a),
d AS (SELECT doc_id, text, regexp_split_to_array(b, '{_RUN}') AS parts, regexp_extract_all(b, '{_RUN}') AS runs FROM c),
e AS (SELECT doc_id, text, list_aggregate(list_transform(list_zip(parts, runs), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN length(regexp_replace(z[2], '\D', '', 'g')) >= 9 THEN '[phone]' ELSE z[2] END), 'string_agg', '') AS out FROM d)
SELECT doc_id, text <> out AS changed, length(out) AS n FROM e""")
def redact_contacts(t):
    out = t("documents").select("doc_id", "text", tx.redact(F.col("text")).alias("out"))
    return out.select("doc_id", (F.col("text") != F.col("out")).alias("changed"), F.length("out").cast("long").alias("n"))


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(trunc(p_retailprice) AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(trunc(p_retailprice) AS DOUBLE) END AS lo,
CASE p_partkey % 4 WHEN 0 THEN CAST(trunc(p_retailprice) + 500 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(trunc(p_retailprice) AS DOUBLE) END AS hi,
CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM part""")
def salary_parse(t):
    whole = F.floor("p_retailprice").cast("string")
    sign = F.when(F.col("p_partkey") % 2 == 0, F.lit("$")).otherwise(F.lit("€"))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(sign, whole, F.lit(" – "), (F.floor("p_retailprice") + 500).cast("string"))).when(kind == 1, F.concat(F.lit("up to "), sign, whole)).when(kind == 2, F.concat(F.lit("from "), sign, whole)).otherwise(F.concat(sign, whole))
    return t("part").select("p_partkey", tx.salary(text).alias("s")).select("p_partkey", F.col("s.min").alias("lo"), F.col("s.max").alias("hi"), "s.currency")


@_query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'senior' WHEN 2 THEN 'middle' WHEN 3 THEN 'junior' END AS level FROM part""")
def seniority(t):
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Senior", "Lead", "Mid-level", "Intern", "Plain"))), F.col("p_size") % 5 + 1), F.lit(" cook"))
    return t("part").select("p_partkey", tx.seniority(title).alias("level"))


@_query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
 generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, regexp_full_match(line, '[{_BLANK}]*') AS blank, regexp_matches(line, '^[{_BLANK}]*([-*•·–—]|[0-9]+[.)])[{_BLANK}]+') AS bullet FROM l),
g AS (SELECT *, sum(CASE WHEN blank OR bullet THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m),
b AS (SELECT doc_id, grp, bullet, min(pos) AS pos, string_agg(regexp_replace(regexp_replace(replace(line, chr(8203), ''), '[{_BLANK}]+', ' ', 'g'), '^ | $', '', 'g'), ' ' ORDER BY pos) AS text FROM g WHERE NOT blank GROUP BY 1, 2, 3),
o AS (SELECT doc_id, row_number() OVER w - 1 AS ordinal, bullet, text, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
 FROM b WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN bullet THEN 'list_item' ELSE 'paragraph' END AS block_type, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(text) AS BIGINT) AS end_char
FROM o WHERE start_char + length(text) <= 200000""")
def plain_text_blocks(t):
    return pg.plain_text_blocks(t("documents")).drop("text", "truncated")


@_query()
def html_blocks(t):
    return pg.html_blocks(t("pages"), "page_id", "html")


@_query()
def html_text(t):
    return pg.html_text(t("pages"), "page_id", "html")


_LABELS = "SELECT p_partkey AS concept_id, p_type AS label FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part"


@_query(f"""WITH f AS (SELECT concept_id, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS form FROM ({_LABELS})), k AS (SELECT * FROM f WHERE length(form) >= 3),
u AS (SELECT word, count(*) AS uses FROM (SELECT unnest(list_distinct(string_split(form, ' '))) AS word FROM k) GROUP BY 1),
i AS (SELECT form, min(concept_id) AS concept_id, count(DISTINCT concept_id) AS n_concepts, CAST(len(string_split(form, ' ')) AS INTEGER) AS words FROM k GROUP BY form)
SELECT form, concept_id, n_concepts, words, floor(CASE WHEN words = 1 THEN 1.0 / (1.0 + uses / 20.0) ELSE 1.0 END * 1000000 + 0.5) / 1000000 AS specificity,
CASE WHEN CASE WHEN words = 1 THEN 1.0 / (1.0 + uses / 20.0) ELSE 1.0 END < 0.2 THEN 'unmapped' WHEN n_concepts = 1 THEN 'linked' ELSE 'ambiguous' END AS status FROM i LEFT JOIN u ON form = word""")
def alias_specificity(t):
    part = t("part")
    labels = part.select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("label")).unionByName(part.select(F.col("p_partkey").alias("concept_id"), F.explode(F.split("p_name", " ")).alias("label")))
    index = ln.alias_index(labels)
    return index.select("form", "concept_id", "n_concepts", "words", _rounded(F.col("specificity"), 6).alias("specificity"), ln.link_status(F.col("n_concepts"), F.col("specificity")).alias("status"))


def _words(column: str):
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _forms(t, longest: int = 3) -> DataFrame:
    """Forms of 1 to `longest` words from whole benchmark texts, with the item each comes from."""
    n = F.size("w")
    slices = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda s: F.array_join(F.slice("w", s, k), " ")))
    return t("benchmark").select("item_id", _words("text").alias("w")).select(F.col("item_id").alias("concept_id"), F.explode(F.flatten(slices)).alias("label"))


def _mentions(t) -> DataFrame:
    index = _forms(t).select(F.col("label").alias("form")).distinct()
    return ln.scan_mentions(t("documents"), index, longest=3).drop("raw_text")


_WORDS_SQL = r"[\p{L}\p{N}_]+"


def _labels_sql(longest: int) -> str:
    """Labels as `_forms` makes them."""
    return rf"""b AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORDS_SQL}') AS w FROM benchmark),
l AS (SELECT item_id AS concept_id, unnest(list_transform(range(1, greatest(len(w) - k + 1, 1) + 1), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS form FROM b, range(1, {longest} + 1) AS r(k))"""


def _scan_sql(longest: int) -> str:
    """Greedy longest matches of known forms in units (unit, raw): words with their places, the longest form at each, then those taken."""
    sizes = range(2, longest + 1)
    names = {1: "a", 2: "b2", 3: "c"} | {n: f"f{n}" for n in sizes[2:]}
    phrase = {n: " || ' ' || ".join(["word", *(f"w{k}" for k in range(2, n + 1))]) for n in range(1, longest + 1)}
    leads = ", ".join(f"lead(word, {n - 1}) OVER v AS w{n}" for n in sizes)
    size = " ".join(f"WHEN {names[n]}.form IS NOT NULL THEN {n}" for n in reversed(sizes))
    form = f"coalesce({', '.join(f'{names[n]}.form' for n in range(longest, 0, -1))})"
    joins = " ".join(f"LEFT JOIN known {names[n]} ON {names[n]}.form = {phrase[n]}" for n in range(1, longest + 1))
    return rf"""w AS (SELECT unit, raw, regexp_extract_all(lower(raw), '{_WORDS_SQL}') AS words, regexp_split_to_array(raw, '{_WORDS_SQL}') AS gaps FROM units),
k AS (SELECT unit, raw, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap, generate_subscripts(words, 1) AS pos FROM w WHERE len(words) > 0),
o AS (SELECT *, sum(length(gap) + length(word)) OVER v AS ends, {leads} FROM k WINDOW v AS (PARTITION BY unit ORDER BY pos)),
h AS (SELECT o.*, CAST(CASE {size} ELSE 1 END AS INTEGER) AS n, {form} AS form
 FROM o {joins} WHERE {form} IS NOT NULL),
g AS (SELECT unit, list_reduce(list({{'pos': pos, 'n': n, 'kept': []::BIGINT[]}} ORDER BY pos), lambda s, x: CASE WHEN x.pos >= s.pos THEN {{'pos': x.pos + x.n, 'n': 0, 'kept': list_append(s.kept, x.pos)}} ELSE s END, {{'pos': 0, 'n': 0, 'kept': []::BIGINT[]}}).kept AS kept FROM h GROUP BY unit),
found AS (SELECT h.unit, h.ends - length(h.word) AS start_char, e.ends AS end_char, h.pos - 1 AS start, h.n AS words, h.form, substr(h.raw, CAST(h.ends - length(h.word) + 1 AS BIGINT), CAST(e.ends - h.ends + length(h.word) AS BIGINT)) AS raw_text
 FROM (SELECT unit, unnest(kept) AS pos FROM g) JOIN h USING (unit, pos) JOIN o e ON e.unit = h.unit AND e.pos = h.pos + h.n - 1)"""


_SCAN_SQL = _scan_sql(3)


@_query(f"""WITH {_labels_sql(3)}, known AS (SELECT DISTINCT form FROM l), units AS (SELECT doc_id AS unit, text AS raw FROM documents WHERE text IS NOT NULL), {_SCAN_SQL}
SELECT unit AS doc_id, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(start AS INTEGER) AS start, words, form FROM found""")
def scan_mentions(t):
    return _mentions(t)


def _spans(t) -> tuple[DataFrame, DataFrame]:
    """Documents, and the lines of the English ones as their spans; the others have none."""
    docs = t("documents").select("doc_id", "text", "lang")
    parts = docs.where("lang = 'en'").select("doc_id", F.split("text", "\n").alias("all"))
    ends = F.aggregate("all", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    lines = parts.select("doc_id", F.explode(F.arrays_zip(F.col("all").alias("raw_text"), F.slice(ends, 1, F.size("all")).alias("start_char"))).alias("s")).select("doc_id", "s.*")
    return docs, lines.where("raw_text <> ''").select("doc_id", "raw_text", "start_char", (F.col("start_char") + F.length("raw_text")).alias("end_char"), F.lit(0.5).alias("confidence"))


def _linked(t, longest: int = 2) -> DataFrame:
    return ln.link_rows(*_spans(t), ln.alias_index(_forms(t, longest)), longest=longest)


def _linked_sql(labels: str = _labels_sql(2), scan: str = _SCAN_SQL) -> str:
    return rf"""{labels}, f AS (SELECT * FROM l WHERE length(form) >= 3), uses AS (SELECT word, count(*) AS uses FROM (SELECT unnest(list_distinct(string_split(form, ' '))) AS word FROM f) GROUP BY 1),
known AS (SELECT form, list_sort(list_distinct(list(concept_id))) AS ids FROM f GROUP BY form),
alias AS (SELECT form, ids, CASE WHEN contains(form, ' ') THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + uses / 20.0::DOUBLE) END AS specificity FROM known LEFT JOIN uses ON form = word),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents WHERE lang = 'en' AND text IS NOT NULL),
spans AS (SELECT * FROM (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - length(raw) - 1 AS shift, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS norm FROM lines) WHERE raw <> ''),
units AS (SELECT {{'d': doc_id, 's': shift}} AS unit, raw FROM spans WHERE norm NOT IN (SELECT form FROM known)
 UNION ALL SELECT {{'d': doc_id, 's': 0}}, text FROM documents WHERE lang IS DISTINCT FROM 'en' AND text IS NOT NULL), {scan},
every AS (SELECT unit.d AS doc_id, form, raw_text, unit.s + start_char AS start_char, unit.s + end_char AS end_char FROM found
 UNION ALL SELECT doc_id, norm, raw, shift, shift + length(raw) FROM spans WHERE norm IN (SELECT form FROM known) OR {{'d': doc_id, 's': shift}} NOT IN (SELECT unit FROM found)),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY start_char, end_char) AS nth FROM every),
rows AS (SELECT once.doc_id, once.form, raw_text, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, coalesce(ids, []) AS ids, coalesce(specificity, 1.0::DOUBLE) AS link_score,
 CASE WHEN coalesce(specificity, 1.0::DOUBLE) < 0.2::DOUBLE OR ids IS NULL THEN 'unmapped' WHEN len(ids) = 1 THEN 'linked' ELSE 'ambiguous' END AS status,
 CASE WHEN spans.doc_id IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM once LEFT JOIN alias ON alias.form = once.form
 LEFT JOIN spans ON spans.doc_id = once.doc_id AND spans.shift = start_char AND spans.shift + length(spans.raw) = end_char WHERE once.nth = 1)"""


_LINK_COLUMNS = """doc_id, form, raw_text, start_char, end_char, status, CASE WHEN status = 'linked' THEN ids[1] END AS concept_id,
CASE WHEN status = 'ambiguous' THEN array_to_string(ids, ',') ELSE '' END AS alternatives, link_score, confidence"""


@_query(f"WITH {_linked_sql()} SELECT {_LINK_COLUMNS} FROM rows")
def linked_mentions(t):
    return _linked(t).withColumn("alternatives", F.concat_ws(",", "alternatives"))


@_query(f"WITH {_linked_sql()} SELECT doc_id, count(*) FILTER (status = 'linked') AS linked, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmapped') AS unmapped FROM rows GROUP BY 1")
def mention_status_counts(t):
    return ln.status_counts(_linked(t))


#: Longest phrase that the reference looks up in a text; `link_rows` and `scan_mentions` go as far.
_LONGEST = 8


@_query(f"""WITH {_linked_sql(_labels_sql(_LONGEST), _scan_sql(_LONGEST))} SELECT form, count(*) AS occurrences, arg_min(raw_text, {{'d': doc_id, 's': start_char}}) AS sample, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM rows WHERE status = 'unmapped' GROUP BY 1""")
def unmapped_terms(t):
    return ln.unmapped_counts(_linked(t, _LONGEST))


#: Words of twelve letters or more in exactly two documents become internal concepts.
_PROMOTED_SQL = rf"""p AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_WORDS_SQL}'))) AS word FROM documents) WHERE length(word) >= 12 GROUP BY 1 HAVING count(*) = 2)"""
_NEW_LABELS_SQL = _labels_sql(2).replace("l AS (", "l1 AS (") + f", {_PROMOTED_SQL}, l AS (SELECT concept_id, form FROM l1 UNION ALL SELECT -length(word), word FROM p)"


def _relink(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, spans = _spans(t)
    words = written(rl.word_index(docs), "words")
    promoted = words.where("length(token) >= 12").groupBy("token").agg(F.count("*").alias("n")).where("n = 2")
    labels = _forms(t, 2)
    old, new = ln.alias_index(labels), ln.alias_index(labels.unionByName(promoted.select((-F.length("token")).cast("long").alias("concept_id"), F.col("token").alias("label"))))
    old, new = written(old, "old-forms"), written(new, "new-forms")
    rows, touched = rl.relink(ln.link_rows(docs, spans, old, longest=2), docs, spans, words, old, new, longest=2)
    return rows, touched, rl.changed_forms(old, new)


@_query(f"WITH {_linked_sql(_NEW_LABELS_SQL)} SELECT {_LINK_COLUMNS} FROM rows")
def relinked_mentions(t):
    """The corpus linked with a taxonomy that words were promoted into; the SQL links all of it, the query what they touch."""
    return _relink(t)[0].withColumn("alternatives", F.concat_ws(",", "alternatives"))


@_query(rf"""WITH {_PROMOTED_SQL} SELECT (SELECT count(*) FROM p) AS changed, (SELECT count(DISTINCT doc_id) FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORDS_SQL}')) AS word FROM documents) WHERE word IN (SELECT word FROM p)) AS touched, (SELECT count(*) FROM documents) AS documents""")
def relink_counts(t):
    _, touched, changed = _relink(t)
    one = lambda df, name: df.select(F.lit(name).alias("kind"))
    both = one(changed, "changed").unionByName(one(touched, "touched")).unionByName(one(t("documents"), "documents"))
    return both.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("changed", "touched", "documents")))


@_query("""WITH c AS (SELECT p_partkey AS concept_id, list_sort(list_distinct(string_split(p_name, ' '))) AS en, p_size % 2 = 0 AS has_de, p_type FROM part),
n AS (SELECT l_partkey AS concept_id, list_sort(list_distinct(list(l_returnflag))) AS forms FROM (SELECT l_partkey, l_returnflag FROM lineitem UNION ALL SELECT -1, 'x') GROUP BY 1)
SELECT c.concept_id, array_to_string(en, ',') AS en, CASE WHEN has_de THEN p_type ELSE array_to_string(forms, ',') END AS de FROM c LEFT JOIN n USING (concept_id)""")
def language_merge(t):
    c = t("part").select(F.col("p_partkey").alias("concept_id"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("en"), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).alias("de"))
    empty = F.create_map().cast("map<string,array<string>>")
    own = F.map_concat(F.create_map(F.lit("en"), "en"), F.when(F.col("de").isNotNull(), F.create_map(F.lit("de"), "de")).otherwise(empty))
    more = t("lineitem").select(F.col("l_partkey").alias("concept_id"), F.array("l_returnflag").alias("forms"))
    more = more.unionByName(more.limit(1).select(F.lit(-1).cast("long").alias("concept_id"), F.array(F.lit("x")).alias("forms")))
    out = ln.merge_language(c.select("concept_id", own.alias("labels")), more, "de")
    # A language that isn't there is null, an empty one can't be.
    return out.select("concept_id", F.array_join(F.col("labels")["en"], ",").alias("en"), F.array_join(F.col("labels")["de"], ",").alias("de"))


@_query("""WITH e AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem UNION ALL SELECT o_orderkey, -o_custkey FROM orders)
SELECT DISTINCT a, b FROM e WHERE a IN (SELECT o_orderkey FROM orders) AND b IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def edge_resolution(t):
    edges = t("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    edges = edges.unionByName(t("orders").select(F.col("o_orderkey").alias("a"), (-F.col("o_custkey")).alias("b")))
    return tb.resolved_edges(edges, t("orders").select(F.col("o_orderkey").alias("a")), t("part").where("p_size > 5").select(F.col("p_partkey").alias("b")))


_RANKED = """r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j AS (SELECT r.*, 2 * quality + (1 - toxic) AS label FROM r LEFT JOIN labels USING (doc_id))"""


@_query(f"""WITH {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY label DESC NULLS LAST, rank) AS ideal FROM j),
a AS (SELECT lang, count(label) AS judged, count(*) - count(label) AS unjudged, count(*) FILTER (label >= 2) AS relevant, count(*) FILTER (label >= 2 AND rank <= 100) AS hits,
 count(label) FILTER (rank <= 100) AS judged_in, sum((2.0 ** label - 1) / log2(rank + 1.0)) FILTER (label IS NOT NULL AND rank <= 100) AS dcg,
 sum((2.0 ** label - 1) / log2(ideal + 1.0)) FILTER (label IS NOT NULL AND ideal <= 100) AS best, min(rank) FILTER (label >= 2 AND rank <= 100) AS first FROM i GROUP BY 1)
SELECT lang, judged, unjudged, relevant, floor(hits / nullif(relevant, 0) * 1000000 + 0.5) / 1000000 AS recall, floor(hits / nullif(judged_in, 0) * 1000000 + 0.5) / 1000000 AS "precision",
floor(coalesce(dcg, 0.0) / nullif(best, 0.0) * 1000000 + 0.5) / 1000000 AS ndcg, CASE WHEN judged > 0 THEN floor(coalesce(1.0 / first, 0.0) * 1000000 + 0.5) / 1000000 END AS mrr FROM a""")
def ranking_metrics(t):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    labels = t("labels").select("doc_id", (2 * F.col("quality") + (1 - F.col("toxic"))).alias("label"))
    m = ev.metrics(t("documents").select("doc_id", "lang", rank.alias("rank")).join(labels, "doc_id", "left"), "lang", 100)
    return m.select("lang", "judged", "unjudged", "relevant", *(_rounded(F.col(c), 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr")))


_POOL = "SELECT doc_id AS id, n_chars % 1000 / 10.0::DOUBLE AS score, lang AS language, CAST(floor(least(greatest(n_chars % 1000 / 10.0::DOUBLE, 0), 99.999) / 10) * 10 AS INTEGER) AS band FROM documents"


def _pool(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 1000 / 10.0).alias("score"), F.col("lang").alias("language"))


@_query(f"""SELECT id, score, language, band, depth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band, coalesce(language, '') ORDER BY score DESC, id) AS INTEGER) AS depth FROM ({_POOL}))
ORDER BY depth, band, coalesce(language, 'unknown') LIMIT 300""")
def stratified_sample(t):
    return ev.stratified_sample(_pool(t), 300)


@_query(f"SELECT band, NULL::VARCHAR AS language, count(*) AS n FROM ({_POOL}) GROUP BY 1 UNION ALL SELECT NULL, language, count(*) FROM ({_POOL}) GROUP BY 2")
def sample_coverage(t):
    return ev.coverage(_pool(t)).select("band", "language", "n")


@_query("SELECT doc_id, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100")
def judge_queue(t):
    d = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left").where("toxic is null")
    return d.orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(100).select("doc_id", "n_chars")


@_query("SELECT lang AS tier, count(*) AS total, count(quality) AS judged, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def judge_progress(t):
    d = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return d.groupBy(F.col("lang").alias("tier")).agg(F.count("*").alias("total"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 1).alias("good"))


@_query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders)
WHERE n = 1 AND o_orderpriority IS DISTINCT FROM '1-URGENT'""")
def stale_profiles(t):
    last = tb.latest_per_key(t("orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return last.where(~F.col("o_orderpriority").eqNullSafe(F.lit("1-URGENT"))).select("o_custkey", "o_orderkey", "o_orderpriority")


@_query("""SELECT doc_id, CAST(strpos(lower(text), 'token') - 1 AS INTEGER) AS start_char, substr(text, strpos(lower(text), 'token'), 5) AS quote FROM documents WHERE strpos(lower(text), 'token') > 0""")
def span_checks(t):
    d = t("documents").select("doc_id", "text", tx.find_span(F.col("text"), F.lit("token")).alias("s")).where("s is not null")
    good = F.expr("substring(text, s.start + 1, s.end - s.start) = s.quote")
    return d.where(good).select("doc_id", F.col("s.start").alias("start_char"), F.col("s.quote").alias("quote"))


@_query("""SELECT rule, checked, violations FROM (SELECT unnest(['quantity', 'discount', 'ship']) AS rule, checked, unnest([a, b, c]) AS violations FROM
(SELECT count(*) AS checked, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) AS a, count(*) FILTER (NOT l_discount <= 0.08) AS b, count(*) FILTER (NOT l_shipdate >= TIMESTAMP '1995-01-01') AS c FROM lineitem))""")
def constraint_report(t):
    rules = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.08, "ship": F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")}
    return tb.constraint_report(t("lineitem"), rules)


@_query("""WITH n AS (SELECT event_id - event_id % 2 AS event_id, value * 2 AS value, 'changed' || event_id % 2 AS event_type, row_number() OVER (PARTITION BY event_id - event_id % 2 ORDER BY event_id DESC) AS last,
 row_number() OVER (PARTITION BY event_id - event_id % 2 ORDER BY event_id) AS first FROM events WHERE event_id % 3 <> 1)
SELECT coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.value, o.value) AS value, coalesce(o.event_type, f.event_type) AS event_type
FROM (SELECT * FROM events WHERE event_id % 3 <> 0) o FULL JOIN (SELECT * FROM n WHERE last = 1) n ON o.event_id = n.event_id LEFT JOIN (SELECT * FROM n WHERE first = 1) f ON f.event_id = n.event_id""")
def upsert_matches(t):
    """Each key comes up to twice; the later row counts, and the first type of an event stays."""
    e = t("events").select("event_id", "value", "event_type")
    last = F.col("event_id") % 2
    new = e.where("event_id % 3 <> 1").select((F.col("event_id") - last).alias("event_id"), (F.col("value") * 2).alias("value"), F.concat(F.lit("changed"), last.cast("string")).alias("event_type"), last.alias("at"))
    return tb.upsert(e.where("event_id % 3 <> 0"), new, ["event_id"], keep=("event_type",), order=("at",))


@_query("SELECT source, count(*) AS rows, count(DISTINCT lang) AS languages, sum(n_chars) AS chars, count(*) FILTER (n_chars < 100) AS short FROM documents GROUP BY 1")
def source_health(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("short"))


@_query("""WITH RECURSIVE d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(strlen(text), 0) AS size FROM conversations),
r AS (SELECT conv_id, turn, n, size, 0::BIGINT AS batch, size AS used FROM d WHERE n = 1
 UNION ALL SELECT d.conv_id, d.turn, d.n, d.size, CASE WHEN r.used + d.size > 400 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + d.size > 400 THEN d.size ELSE r.used + d.size END
 FROM r JOIN d ON d.conv_id = r.conv_id AND d.n = r.n + 1)
SELECT conv_id, turn, size, batch FROM r""")
def byte_batches(t):
    return bt.byte_batches(t("conversations"), "conv_id", "turn", F.col("text"), 412, F.lit("twelve bytes"))


@_query("""WITH RECURSIVE d AS (SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN 'hot' END, source) AS owner, doc_id, coalesce(strlen(text), 0) AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS n FROM d WHERE owner IS NOT NULL),
r AS (SELECT owner, doc_id, n, size, 0::BIGINT AS batch, size AS used FROM n WHERE n = 1
 UNION ALL SELECT n.owner, n.doc_id, n.n, n.size, CASE WHEN r.used + n.size > 20000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + n.size > 20000 THEN n.size ELSE r.used + n.size END
 FROM r JOIN n ON n.owner = r.owner AND n.n = r.n + 1)
SELECT owner, doc_id, size, batch FROM r""")
def source_batches(t):
    """Documents by source; one owner has a third of all."""
    owner = F.coalesce(F.when(F.col("doc_id") % 3 == 0, "hot"), F.col("source"))
    return bt.byte_batches(t("documents").withColumn("owner", owner), "owner", "doc_id", F.col("text"), 20_000)


_FACTS = """f AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS years, CASE WHEN p_partkey % 2 = 0 THEN 'senior' END AS level,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE trunc(p_retailprice) END AS low, CASE WHEN p_partkey % 4 = 0 THEN 1000.0 END AS high,
 'Senior ' || p_name || ', ' || p_size || ' years, up to 1000' AS text FROM part),
m AS (SELECT p_partkey, text, unnest([
 {'kind': 'experience', 'at': 1, 'value': CASE WHEN years >= 0 THEN 'years_min=' || years END, 'needle': CAST(years AS VARCHAR)},
 {'kind': 'experience', 'at': 2, 'value': 'seniority=' || level, 'needle': level},
 {'kind': 'employment_type', 'at': 3, 'value': 'employment_type=full_time', 'needle': NULL},
 {'kind': 'location', 'at': 4, 'value': CASE WHEN p_partkey % 2 = 1 THEN 'remote=true' ELSE 'remote=false' END, 'needle': NULL},
 {'kind': 'compensation', 'at': 5, 'value': CASE WHEN coalesce(high, low) IS NOT NULL AND NOT coalesce(low > high, false) THEN concat('min=', CAST(low AS BIGINT), ',max=', CAST(high AS BIGINT)) END, 'needle': CAST(CAST(coalesce(high, low) AS BIGINT) AS VARCHAR)}]) AS r FROM f)"""


@_query(f"""WITH {_FACTS} SELECT p_partkey, r.kind AS kind, r.value AS value, coalesce(strpos(lower(text), r.needle) > 0, false) AS explicit,
CAST(nullif(strpos(lower(text), r.needle), 0) - 1 AS INTEGER) AS start_char FROM m WHERE r.value IS NOT NULL
UNION ALL SELECT p_partkey, 'rejected', 'negative years', false, NULL FROM f WHERE years < 0
UNION ALL SELECT p_partkey, 'rejected', 'floor over ceiling', false, NULL FROM f WHERE low > high""")
def structural_profile(t):
    k = F.col("p_partkey")
    whole = F.floor("p_retailprice").cast("double")
    years = F.when(k % 7 == 0, -1).when(k % 3 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("double")
    low, high = F.when(k % 5 != 0, whole), F.when(k % 4 == 0, F.lit(1000.0))
    text = F.concat(F.lit("Senior "), "p_name", F.lit(", "), F.col("p_size").cast("string"), F.lit(" years, up to 1000"))
    r, d, _ = pf.job_profile(text, years, F.when(k % 2 == 0, "senior"), F.lit("full_time"), k % 2 == 1, low, high, F.lit("USD"))
    part = dealt(t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")).select("p_partkey", r.alias("r"), d.alias("d"))
    number = lambda name: F.coalesce(F.format_string("%.0f", F.col("r.value")[name].cast("double")), F.lit(""))
    has = lambda name: F.array_contains(F.map_keys("r.value"), name)
    pay = F.concat(F.lit("min="), number("min"), F.lit(",max="), number("max"))
    shown = F.when(has("min"), pay).when(has("years_min"), F.concat(F.lit("years_min="), number("years_min")))
    shown = F.coalesce(shown, F.concat(F.map_keys("r.value")[0], F.lit("="), F.map_values("r.value")[0]))
    # A plain explode would first ask for lists that aren't empty, and so make them twice, once before rows are dealt out.
    each = lambda c: part.select("p_partkey", F.explode_outer(c).alias(c)).where(F.col(c).isNotNull())
    kept = each("r").select("p_partkey", "r.kind", shown.alias("value"), "r.explicit", F.col("r.evidence.start").alias("start_char"))
    return kept.unionByName(each("d").select("p_partkey", F.col("d.outcome").alias("kind"), F.col("d.reason").alias("value"), F.lit(False).alias("explicit"), F.lit(None).cast("int").alias("start_char")))


@_query("""WITH q AS (SELECT p_type AS term, count(*) AS occurrences FROM part GROUP BY 1),
d AS (SELECT term, arg_max(action, ord) AS action FROM (SELECT p_type AS term, p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'ignored' ELSE 'pending' END AS action FROM part WHERE p_size < 40
 UNION ALL SELECT r_name, r_regionkey, 'promoted' FROM region) GROUP BY 1),
r AS (SELECT coalesce(q.term, d.term) AS term, CASE WHEN q.term IS NULL THEN 'missing' ELSE coalesce(action, 'pending') END AS status FROM q FULL JOIN d ON q.term = d.term),
w AS (SELECT 'internal:' || term AS concept_id, term AS label FROM r WHERE status = 'promoted'),
o AS (SELECT DISTINCT 'internal:' || p_type AS concept_id, p_type AS label FROM part WHERE p_size > 25)
SELECT coalesce(w.concept_id, o.concept_id) AS concept_id, coalesce(w.label, o.label) AS label, w.label IS NOT NULL AS active FROM w FULL JOIN o ON w.concept_id = o.concept_id""")
def term_review(t):
    part = t("part")
    action = F.when(F.col("p_size") % 3 == 0, "promoted").when(F.col("p_size") % 3 == 1, "ignored").otherwise("pending")
    made = part.where("p_size < 40").select(F.col("p_type").alias("term"), F.col("p_partkey").alias("ord"), action.alias("action"))
    made = made.unionByName(t("region").select(F.col("r_name").alias("term"), F.col("r_regionkey").cast("long").alias("ord"), F.lit("promoted").alias("action")))
    queue = part.groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("occurrences"))
    existing = part.where("p_size > 25").select(F.concat(F.lit("internal:"), "p_type").alias("concept_id"), F.col("p_type").alias("label")).distinct()
    return rw.internal_concepts(rw.review_terms(queue, made), existing)


@_query("""SELECT CAST(page_id AS VARCHAR) AS external_id, 'https://jobs.example/vacancies/' || page_id || '/' AS url, 'Page <' || page_id || '>' AS title, '<p>' || url || '</p>' AS description_html,
TIMESTAMP '2024-03-01 10:00:00' + to_minutes(CAST(page_id % 60 AS INTEGER)) - INTERVAL 2 HOUR AS published_at FROM pages WHERE page_id % 5 <> 0""")
def feed_items(t):
    page = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("https://jobs.example/vacancies/"), page, F.lit("/"))).otherwise("https://jobs.example/about")
    date = F.concat(F.lit("Fri, 01 Mar 2024 10:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00 +0200"))
    tags = {"title": F.concat(F.lit(" Page <"), page, F.lit("> ")), "link": link, "description": F.concat(F.lit("<p>"), "url", F.lit("</p>")), "pubDate": date}
    body = [x for name, value in tags.items() for x in (F.lit(f"<{name}>"), tx.html_escape(value), F.lit(f"</{name}>"))]
    items = t("pages").select(F.concat(F.lit("<item>"), *body, F.lit("</item>")).alias("xml"))
    return fd.feed_items(items, "xml").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@_stream_query("events", _REV.format(owner="user_id", ord="event_id", content="event_type", table="events"))
def stream_revisions(stream):
    out = st.stream_revisions(stream, "user_id", "event_id", "event_type")
    return out.select(F.col("user_id").alias("owner"), F.col("event_id").alias("ord"), "revision_no", "is_new", "reverted")


@_stream_query("events", """SELECT user_id, target, arg_max(action, event_id) AS action FROM (SELECT user_id, event_id, CAST(event_id % 17 AS VARCHAR) AS target,
CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END AS action FROM events) WHERE action IS NOT NULL GROUP BY 1, 2""")
def stream_decisions(stream):
    action = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").otherwise(F.col("event_type"))
    data = F.concat(F.lit("match:"), action, F.lit(":"), (F.col("event_id") % 17).cast("string"))
    return st.stream_decisions(stream.withColumn("data", data), "user_id", "data", ["event_id"])


@_stream_query("events", """SELECT event_id, CASE WHEN a >= 10 THEN 'dead' WHEN event_type NOT IN ('click', 'view') THEN 'unhandled' WHEN event_type = 'click' AND value > 60 THEN 'failed' ELSE 'published' END AS status,
a + (a < 10 AND event_type = 'click' AND value > 60)::BIGINT AS attempts FROM (SELECT *, event_id % 12 AS a FROM events)""")
def stream_relay(stream):
    errors = {"click": F.when(F.col("value") > 60, "over the limit"), "view": F.lit(None)}
    return st.stream_relay(stream, "event_type", F.col("event_id") % 12, errors, "event_id").select("event_id", "status", "attempts")


@_query()
def dedup_clusters(t):
    company = F.concat_ws(" ", "p_brand", F.substring_index("p_type", " ", 2), F.col("p_size").cast("string"))
    rows = dealt(t("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")).select("p_partkey", company.alias("company"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("description"))
    return cl.leader_clusters(rows, "p_partkey", "p_partkey")


@_query("""WITH n AS (SELECT sha256(text) AS cluster, source, arg_max('u' || doc_id, doc_id) AS url FROM documents GROUP BY 1, 2)
SELECT cluster, string_agg(source || '=' || url, ';' ORDER BY source) AS links FROM n GROUP BY 1""")
def source_links(t):
    rows = t("documents").select(F.sha2("text", 256).alias("cluster"), "source", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("normalized_at"))
    pairs = F.transform("links", lambda x: F.concat(x["source"], F.lit("="), x["url"]))
    return cl.source_links(rows).select("cluster", F.array_join(pairs, ";").alias("links"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND n_chars % 11 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE END AS relevance,
doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND n_chars % 11 <> 0 AS reused FROM documents""")
def rerank_cache_split(t):
    d = t("documents").select("doc_id", "n_chars", F.lit("m").alias("model"), tx.text_hash(F.col("source")).alias("query_hash"), tx.text_hash(F.col("text")).alias("doc_hash"))
    d = d.withColumns({"user_id": F.col("doc_id") % 10, "item_id": F.col("doc_id")})
    relevance = F.when(F.col("n_chars") % 11 != 0, (F.col("n_chars") % 100) / 100.0)
    changed = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_hash"))
    stored = d.where("doc_id % 5 <> 0").select("user_id", "item_id", "model", "query_hash", changed.alias("doc_hash"), relevance.alias("relevance"))
    return mt.reuse_relevance(d, stored).select("doc_id", "relevance", "reused")


@_query(r"""WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS q,
 list_distinct(list_filter(regexp_split_to_array(lower(answer), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS d FROM n)
SELECT conv_id, turn, CASE WHEN answer IS NOT NULL THEN floor(CAST(len(list_intersect(q, d)) AS DOUBLE) / nullif(len(q), 0) * 1000000 + 0.5) / 1000000 END AS relevance FROM w""")
def pair_relevance(t):
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t("conversations").select("conv_id", "turn", "text", answer.alias("answer"))
    return c.select("conv_id", "turn", _rounded(mt.token_overlap(F.col("text"), F.col("answer")), 6).alias("relevance"))


@_query("""WITH m AS (SELECT user_id, value >= 20 AS eligible, event_type = 'click' AS reranked, event_type = 'click' AND value > 50 AS reused,
 CASE WHEN value >= 70 THEN 'apply' WHEN value >= 45 THEN 'consider' ELSE 'skip' END AS r FROM events),
g AS (SELECT user_id, count(*) AS retrieved, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS filtered_out, count(*) FILTER (reranked) AS reranked, count(*) FILTER (reused) AS reused,
 count(*) FILTER (r = 'apply') AS apply, count(*) FILTER (r = 'consider') AS consider, count(*) FILTER (r = 'skip') AS skip FROM m GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(retrieved, 0) AS retrieved, coalesce(eligible, 0) AS eligible, coalesce(filtered_out, 0) AS filtered_out, coalesce(reranked, 0) AS reranked, coalesce(reused, 0) AS reused,
 coalesce(apply, 0) AS apply, coalesce(consider, 0) AS consider, coalesce(skip, 0) AS skip,
 CASE WHEN NOT c_acctbal > 0 THEN 'no document' WHEN retrieved IS NULL THEN 'nothing retrieved' END AS skipped_reason FROM customer LEFT JOIN g ON user_id = c_custkey""")
def pass_summary(t):
    click = F.col("event_type") == "click"
    m = t("events").select("user_id", (F.col("value") >= 20).alias("eligible"), F.when(click, 1).alias("rerank_position"), (click & (F.col("value") > 50)).alias("reused"), mt.band(F.col("value"), mt.MatchConfig()).alias("recommendation"))
    return mt.pass_summary(m, t("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("has_document")))


@_query("SELECT event_type AS document_type, user_id % 3 AS model, count(*) AS rows, user_id % 3 = 1 AS comparable FROM events GROUP BY ALL")
def model_usage(t):
    return mt.models_in_use(t("events").select(F.col("event_type").alias("document_type"), (F.col("user_id") % 3).alias("m")), "m", 1)


@_query("""SELECT user_id AS doc_id, start_char, end_char, event_type AS label, value AS confidence, event_id AS ord FROM
(SELECT *, event_id % 50 AS start_char, event_id % 50 + 3 AS end_char, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1""")
def best_span_labels(t):
    at = F.col("event_id") % 50
    e = t("events").select(F.col("user_id").alias("doc_id"), at.alias("start_char"), (at + 3).alias("end_char"), F.col("event_type").alias("label"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    return mt.best_label_per_span(e)


@_query("""SELECT event_id, user_id FROM events WHERE NOT (value < 45 OR event_type = 'error' OR (event_type = 'purchase' AND value < 60))""")
def visible_items(t):
    e = t("events")
    m = e.select("user_id", F.col("event_id").alias("item_id"), mt.band(F.col("value"), mt.MatchConfig()).alias("recommendation"), (F.col("event_type") != "error").alias("eligible"), F.when((F.col("event_type") == "purchase") & (F.col("value") < 60), "rejected").alias("decision"))
    return e.select("event_id", "user_id").join(mt.hidden_items(m).withColumnRenamed("item_id", "event_id"), ["user_id", "event_id"], "left_anti").select("event_id", "user_id")


@_query("""WITH f AS (SELECT * FROM (SELECT l_suppkey AS source, l_orderkey AS external_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 20)
SELECT source, external_id FROM f WHERE (source, external_id) NOT IN (SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity > 30)""")
def capped_ingest(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("external_id"), "l_linenumber", "l_quantity")
    known = rows.where("l_quantity > 30")
    return po.capped(rows, known, ["source", "external_id"], 20, F.asc("external_id"), F.asc("l_linenumber")).select("source", "external_id")


@_query("""SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1) ON l_orderkey = o_orderkey""")
def newest_revision(t):
    rows = t("lineitem").where("l_returnflag <> 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return tb.with_newest(t("orders").select("o_orderkey", "o_orderdate"), rows, "o_orderkey", ["l_linenumber", "l_quantity"], F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_quantity"))


@_query("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), k AS (SELECT l_partkey FROM p WHERE l_suppkey = 2)
SELECT CASE WHEN l_suppkey = 1 AND l_partkey NOT IN (FROM k) THEN 2 ELSE l_suppkey END AS l_suppkey, l_partkey FROM p""")
def repointed_pairs(t):
    return tb.repoint(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", 1, 2, "l_partkey")


@_query("SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def label_distribution(t):
    return ev.label_distribution(t("labels"), "quality")


@_query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM labels) AS judged, 0 AS active_versions, 'active_versions' AS blockers""")
def system_status(t):
    none = t("documents").where("doc_id < 0")
    out = tb.status_report({"documents": t("documents"), "vectors": t("embeddings"), "judged": t("labels"), "active_versions": none})
    return out.withColumn("blockers", F.array_join("blockers", ","))


@_query("""SELECT count(*) FILTER (event_type = 'error' AND value < 90) AS undelivered, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS revisions, count(DISTINCT user_id) AS users FROM events""")
def backlog_depths(t):
    kind = F.col("event_type")
    return t("events").agg(F.count_if((kind == "error") & (F.col("value") < 90)).alias("undelivered"), F.count_if(kind == "view").alias("pending"), F.count_if(kind == "click").alias("revisions"), F.count_distinct("user_id").alias("users"))


@_query(f"""SELECT id, score, language, band, depth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band, coalesce(language, 'unknown') ORDER BY score DESC, id) AS INTEGER) AS depth FROM ({_POOL}) WHERE id NOT IN (SELECT doc_id FROM labels))
ORDER BY depth, band, coalesce(language, 'unknown') LIMIT 200""")
def sample_builder(t):
    return ev.new_sample(_pool(t), t("labels").select(F.col("doc_id").alias("id")), 200)


@_query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_runs(t):
    return tb.recent(t("events").select("event_id", "user_id", "ts"), F.desc("ts"), F.desc("event_id"), limit=1000)


@_query("""SELECT p_type AS term, count(*) AS occurrences FROM part GROUP BY 1 HAVING count(*) >= 2 AND max(p_size) % 2 = 0 ORDER BY 2 DESC, 1 LIMIT 500""")
def review_queue(t):
    terms = t("part").groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("occurrences"), F.when(F.max("p_size") % 2 == 0, "pending").otherwise("ignored").alias("status"))
    return ln.review_queue(terms, limit=900).select("term", "occurrences")


@_query("""WITH d AS (SELECT event_id % 500 AS pair_id, user_id % 2 AS candidate, CASE WHEN value > 50 THEN NULL ELSE 1 END AS label, 'u' || user_id AS annotator, event_id AS made FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, candidate ORDER BY made DESC) AS n FROM d) WHERE n = 1)
SELECT p.doc_id AS pair_id, CASE WHEN l.pair_id IS NULL THEN p.quality ELSE l.label END AS label, CASE WHEN l.pair_id IS NULL THEN 'seed' WHEN l.label IS NOT NULL THEN l.annotator END AS annotator,
CASE WHEN l.pair_id IS NULL THEN 0 WHEN l.label IS NOT NULL THEN l.made END AS annotated_at FROM labels p LEFT JOIN l ON l.pair_id = p.doc_id AND l.candidate = p.doc_id % 2""")
def judgement_overlay(t):
    pairs = t("labels").select(F.col("doc_id").alias("pair_id"), (F.col("doc_id") % 2).alias("candidate"), F.col("quality").alias("label"), F.lit("seed").alias("annotator"), F.lit(0).cast("long").alias("annotated_at"))
    label, who = F.when(F.col("value") <= 50, 1).alias("label"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("annotator")
    made = t("events").select((F.col("event_id") % 500).alias("pair_id"), (F.col("user_id") % 2).alias("candidate"), label, who, F.col("event_id").alias("at"))
    return tb.judgements(pairs, made)[0].drop("candidate")


@_query("""SELECT user_id, event_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey = event_id) AS allowed FROM events""")
def owned_deletes(t):
    asked = t("events").select("user_id", "event_id")
    yes, no = tb.owned(t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id")), asked, ["user_id", "event_id"])
    return yes.withColumn("allowed", F.lit(True)).unionByName(no.withColumn("allowed", F.lit(False)))


@_query("SELECT doc_id AS owner, 1 AS revision_no, sha256(text) AS content_hash, 'received' AS status FROM documents")
def seed_revisions(t):
    return rv.seed_revisions(t("documents"), "doc_id", "text")[0]


@_query("SELECT doc_id, n_chars FROM documents WHERE n_chars % 3 = 0 AND source <> 'src1' ORDER BY n_chars, doc_id LIMIT 100")
def unparsed_backlog(t):
    d = t("documents").select("doc_id", "n_chars", F.when(F.col("n_chars") % 3 != 0, "x").alias("parsed_text"), F.when(F.col("source") == "src1", "failed").otherwise("received").alias("status"))
    return rv.unparsed(d, 100, "n_chars", "doc_id").select("doc_id", "n_chars")


@_query("""SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'bare' WHEN length(text) < 4 THEN 'out of bounds' WHEN n_chars % 7 = 0 THEN 'misquoted' ELSE 'kept' END AS outcome FROM documents WHERE text IS NOT NULL""")
def span_verification(t):
    d = t("documents").where("text is not null")
    quote = F.when(F.col("n_chars") % 5 == 0, "").when(F.col("n_chars") % 7 == 0, "~~~~").otherwise(F.substring("text", 1, 4))
    spans = d.select("doc_id", F.lit("tool").alias("label"), F.lit(0).alias("start_char"), F.lit(4).alias("end_char"), quote.alias("quote"), F.lit(1.5).alias("confidence"))
    return pf.verified_spans(d, spans).select("doc_id", "outcome")


@_query("""SELECT source AS run, 'parse' AS step, unnest(['seen', 'short']) AS metric, unnest([count(*), count(*) FILTER (n_chars < 100)]) AS value FROM documents GROUP BY source""")
def run_log(t):
    counts = t("documents").groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("n_chars") < 100).alias("short"))
    each = F.explode(tb.run_metrics(F.col("source"), "parse", {"seen": F.col("seen"), "short": F.col("short")})).alias("m")
    return counts.select(each).select("m.*")


@_query("""WITH p AS (SELECT c_custkey, '[LOOKING FOR]' || chr(10) || c_mktsegment AS looking, '[PREFERRED STACK]' || chr(10) || 'SQL; ' || c_mktsegment AS stack, CASE WHEN c_nationkey % 2 = 0 THEN '[WORK FORMAT]' || chr(10) || 'remote; office' END AS place,
 CASE WHEN c_nationkey % 3 = 0 THEN '[COMPETENCIES]' || chr(10) || c_mktsegment END AS rest, CASE WHEN c_acctbal > 0 THEN '[CV]' || chr(10) || 'Name: ' || c_name || chr(10) || chr(10) || 'mail [email] ' || trim(repeat(c_mktsegment || ' ', 600)) END AS cv FROM customer)
SELECT c_custkey, field, body FROM (SELECT c_custkey, unnest(['occupation', 'competencies', 'experience', 'full_profile']) AS field, unnest([concat_ws(chr(10) || chr(10), looking, place), concat_ws(chr(10) || chr(10), stack, rest),
 substr(cv, 1, 4000), substr(concat_ws(chr(10) || chr(10), looking, stack, place, cv), 1, 4000)]) AS body FROM p) WHERE body <> ''""")
def candidate_representations(t):
    roles = F.array("c_mktsegment", F.lower("c_mktsegment"), F.lit(" "))
    stack = F.array(F.lit("SQL"), F.lit("sql "), F.col("c_mktsegment"))
    formats = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("remote"), F.lit("office")))
    items = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.struct(F.lit("unspecified").alias("necessity"), F.col("c_mktsegment").alias("name"))))
    none = F.expr("cast(array() as array<string>)")
    cv = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Name:  "), "c_name", F.lit("\n\n\n\nmail someone@mail.example.com "), F.repeat(F.concat("c_mktsegment", F.lit(" ")), F.lit(600))))
    each = F.explode(render.candidate_representations(roles, stack, formats, items, none, cv)).alias("f")
    return dealt(t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")).select("c_custkey", each).select("c_custkey", "f.field", "f.body")


@_query()
def listing_links(t):
    return po.listing_rows(t("pages"), "page_id", "html", "https://jobs.example", r"^/(\w+)$")


@_query()
def detail_fields(t):
    return po.detail_fields(t("pages"), "page_id", "html", {"title": "h1", "company": "div.ad", "description_html": "article"}).drop("items", "places")


@_query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'added' END AS label FROM orders")
def insert_absent(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = o.where("o_orderstatus = 'F'").withColumn("label", F.lit("kept")).drop("o_orderstatus")
    return tb.insert_absent(old, o.withColumn("label", F.lit("added")).drop("o_orderstatus"), ["o_orderkey"])


@_query("SELECT count(*) AS offered, count(*) FILTER (o_orderstatus <> 'F') AS added FROM orders")
def insert_counts(t):
    return tb.insert_counts(t("orders").where("o_orderstatus = 'F'").select("o_orderkey"), t("orders").select("o_orderkey"), ["o_orderkey"])


@_query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity + 100 AS l_quantity FROM lineitem WHERE l_returnflag = 'R')
FROM n UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)""")
def replace_partition(t):
    items = t("lineitem")
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    new = items.where("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 100)
    return tb.replace_partition(items.select(columns), new.select(columns), "l_orderkey")


@_query("""SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.created, b.created) AS created, CASE WHEN b.event_id IS NULL THEN a.error ELSE b.error END AS error
FROM (SELECT event_id, 'first' AS created, 'refused' AS error FROM events WHERE event_id % 2 = 0) a FULL JOIN
(SELECT event_id, 'second' AS created, CASE WHEN value > 50 THEN 'late' END AS error FROM events WHERE event_id % 3 = 0) b ON a.event_id = b.event_id""")
def delivery_log(t):
    e = t("events")
    old = e.where("event_id % 2 = 0").select("event_id", F.lit("first").alias("created"), F.lit("refused").alias("error"))
    new = e.where("event_id % 3 = 0").select("event_id", F.lit("second").alias("created"), F.when(F.col("value") > 50, "late").alias("error"))
    return tb.upsert(old, new, ["event_id"], ("created",))


@_query(r"""SELECT doc_id, sha256(concat_ws(chr(10), 'LOOKING FOR: ' || source, 'PREFERRED STACK: ' || lang || ', SQL', 'WORK FORMAT: remote',
'CV: ' || nullif(trim(substr(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 1, 8000)), ''))) AS document_hash
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def profile_document(t):
    d = t("documents").where("lang is not null and source is not null")
    made = render.profile_document(F.col("text"), F.array("source", F.lit(" ")), F.array("lang", F.lit("SQL")), F.array(F.lit("remote")))
    return d.select("doc_id", F.sha2(made, 256).alias("document_hash"))


@_query(r"""WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1),
v AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS low, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 500 END AS high FROM orders JOIN n USING (o_custkey))
SELECT o_orderkey, concat_ws(chr(10), '<b>' || CAST(round_even(o_totalprice % 100, 0) AS BIGINT) || '% MATCH</b> · ' || CASE WHEN o_totalprice % 100 > 50 THEN 'APPLY' ELSE 'SKIP' END, '',
'<b>A &lt;b&gt; &amp; &quot;' || o_orderpriority || '&quot;</b> — Clerk&#x27;s',
nullif(concat_ws(' · ', '💰 ' || nullif(concat_ws('–', low, high), '') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' USD' END, CASE WHEN o_orderkey % 7 = 0 THEN '📍 Remote' END, CASE WHEN o_orderkey % 4 = 0 THEN '🎓 senior' END), ''), '',
'🧮 similarity ' || CAST(round_even(o_totalprice % 100 / 100 * 100, 0) AS BIGINT) || '% · ' || CASE WHEN o_orderkey % 3 = 0 THEN 'not reranked' ELSE 'rerank 25%' END, '',
'🔗 <a href="https://x.example/?a=1&amp;b=' || o_orderkey || '">Web</a> · <a href="/f">Feed of jobs</a>', '', '📊 ' || p || ' pending · ' || f || ' approved · ' || o || ' rejected') AS card FROM v""")
def notification_cards(t):
    o = t("orders")
    n = o.groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(k) for k, s in (("pending", "P"), ("approved", "F"), ("rejected", "O"))))
    key, score = F.col("o_orderkey"), F.col("o_totalprice") % 100
    match = {"score": score, "recommendation": F.when(score > 50, "apply").otherwise("skip"), "similarity": score / 100, "relevance": F.when(key % 3 != 0, 0.25)}
    job = {
        "title": F.concat(F.lit('A <b> & "'), "o_orderpriority", F.lit('"')), "company": F.lit("Clerk's"), "low": F.when(key % 5 != 0, F.col("o_custkey").cast("double")),
        "high": F.when(key % 2 == 0, (F.col("o_custkey") + 500).cast("double")), "currency": F.when(key % 3 == 0, "").otherwise("USD"), "remote": key % 7 == 0, "level": F.when(key % 4 == 0, "senior"),
    }
    link = lambda source, url: F.struct(F.lit(source).alias("source"), url.alias("url"))
    links = F.array(link("WEB", F.concat(F.lit("https://x.example/?a=1&b="), key.cast("string"))), link("feed", F.lit("/f")))
    totals = {k: F.col(k) for k in ("pending", "approved", "rejected")}
    return o.join(n, "o_custkey").select("o_orderkey", render.card(match, job, links, totals, {"feed": "Feed of jobs"}).alias("card"))


@_query(r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND text IS NOT NULL THEN 0.0 ELSE TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS DOUBLE) END AS years FROM documents""")
def experience_years(t):
    said = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Без досвіду, 2 "), "text")).otherwise(F.col("text"))
    return t("documents").select("doc_id", tx.experience_years(said).alias("years"))


@_query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '' AND NOT contains(lower(p), 'віддалено')), '|') AS places
FROM documents WHERE text IS NOT NULL""")
def location_split(t):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(", Віддалено (EU),  "))).otherwise(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.array_join(tx.cities(said), "|").alias("places"))


@_query(r"""SELECT 'page' AS kind, page_id AS id, regexp_matches(lower(html), '</p>|</div>|</ul>|</ol>|</li>|</h|<br') AS markup FROM pages
UNION ALL SELECT 'text', doc_id, regexp_matches(lower(text), '</p>|</div>|</ul>|</ol>|</li>|</h|<br') FROM documents""")
def markup_sniff(t):
    pages = t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), tx.is_markup(F.col("html")).alias("markup"))
    return pages.unionByName(t("documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), tx.is_markup(F.col("text")).alias("markup")))


_FLAT = _BLANK.replace(r"\s", r"\t\x0B\f\r ")


@_query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(chr(160) || text, chr(8203), ''), '[{_FLAT}]+', ' ', 'g'), '^[{_BLANK}\x0B]+|[{_BLANK}\x0B]+$', '', 'g')) AS text_hash FROM documents""")
def block_texts(t):
    said = F.concat(F.lit("​ "), "text", F.lit("​"))
    return t("documents").select("doc_id", F.sha2(tx.block_text(said), 256).alias("text_hash"))


@_query(rf"""WITH b AS ({_SQL["plain_text_blocks"]}) SELECT d.doc_id, d.n_chars // 2 AS place, b.ordinal FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND d.n_chars // 2 >= start_char AND d.n_chars // 2 < end_char""")
def block_places(t):
    places = t("documents").select("doc_id", F.expr("n_chars div 2").alias("place"))
    return pg.block_at(pg.plain_text_blocks(t("documents")), places, "doc_id", "place")


@_query()
def backfill_parse(t):
    """Plain texts and pages in one column, as a store of old and new revisions has them."""
    d = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"))
    both = d.unionByName(t("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("language")))
    return pg.parsed_revisions(both.drop("text"), pg.stored_blocks(both, "id", "text"), "id")


@_query("SELECT user_id, event_id, value, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS owner FROM (SELECT * FROM events) LEFT JOIN customer ON c_custkey = user_id")
def chat_owners(t):
    chats = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner"))
    return tb.resolved_owners(t("events").select("user_id", "event_id", "value"), chats, "user_id", "owner")


@_query("""SELECT o_orderkey, o_totalprice, value, coalesce(n, 0) AS members FROM orders LEFT JOIN (SELECT event_id, value FROM events) ON event_id = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount > 0.03 GROUP BY 1) ON l_orderkey = o_orderkey""")
def posting_details(t):
    matches = t("events").select(F.col("event_id").alias("o_orderkey"), "value")
    members = t("lineitem").where("l_discount > 0.03").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.posting_details(t("orders").select("o_orderkey", "o_totalprice"), matches, members, "o_orderkey")


@_query("""SELECT unnest(['documents', 'labels', 'pages', 'embeddings']) AS entity, unnest([(SELECT count(*) FROM documents WHERE source = 'src1'), (SELECT count(*) FROM labels WHERE toxic = 1), (SELECT count(*) FROM pages), 0]) AS rows""")
def reset_counts(t):
    own = {"documents": F.col("source") == "src1", "labels": F.col("toxic") == 1, "pages": F.lit(True), "embeddings": F.lit(False)}
    return tb.reset_counts({n: (t(n), c) for n, c in own.items()})


@_query("SELECT coalesce(lang, 'none') AS namespace, source AS version, count(*) AS concepts, count(*) FILTER (n_chars % 2 = 0) AS active FROM documents GROUP BY 1, 2")
def generation_counts(t):
    return tb.generation_counts(t("documents").select(F.coalesce("lang", F.lit("none")).alias("namespace"), F.col("source").alias("version"), (F.col("n_chars") % 2 == 0).alias("active")))


@_query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def users_with_document(t):
    return t("events").where("event_type = 'purchase'").select("user_id").distinct()


@_query("""SELECT lang AS namespace, source AS version, count(*) AS concepts, NULL::VARCHAR AS error,
CASE WHEN lang = 'en' AND source = 'src5' THEN 'active' WHEN lang = 'en' AND source = 'src1' THEN 'superseded' WHEN source = 'src1' THEN 'active' ELSE 'ready' END AS status
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2""")
def version_activation(t):
    d = t("documents").where("lang is not null and source is not null")
    status = F.when(F.col("source") == "src1", "active").otherwise("ready")
    versions = d.groupBy(F.col("lang").alias("namespace"), F.col("source").alias("version"), status.alias("status")).agg(F.count("*").alias("concepts"))
    return tb.activate(versions.withColumn("error", F.lit(None).cast("string")), "en", "src5", d.where("lang = 'en' and source = 'src5'").count())


@_query("""WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1)
SELECT user_id, event_id AS revision_no, 'neural' AS origin, false AS reviewed, event_type AS competencies, NULL::BIGINT AS parent_no FROM events
UNION ALL SELECT user_id, last + row_number() OVER w, 'user_override', true, o_orderpriority, last + row_number() OVER w - 1 FROM l JOIN orders ON o_custkey = user_id WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY user_id ORDER BY o_orderkey)""")
def profile_overrides(t):
    profiles = t("events").select("user_id", F.col("event_id").alias("revision_no"), F.lit("neural").alias("origin"), F.lit(False).alias("reviewed"), F.array("event_type").alias("competencies"))
    edits = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.array("o_orderpriority").alias("competencies"), F.col("o_orderkey").alias("at"))
    return rv.override_profile(profiles, edits, "at").withColumn("competencies", F.array_join("competencies", ","))


@_query("""SELECT p_type AS term, count(*) AS occurrences FROM part GROUP BY 1 HAVING count(*) % 2 = 1 AND min(p_size) % 3 <> 0""")
def legacy_promotions(t):
    terms = t("part").groupBy(F.col("p_type").alias("term")).agg(
        F.count("*").alias("occurrences"), F.when(F.count("*") % 2 == 1, "promoted").otherwise("pending").alias("status"), F.when(F.min("p_size") % 3 == 0, "known").alias("concept_id")
    )
    return ln.legacy_promotions(terms).select("term", "occurrences")


@_query("""SELECT doc_id, lang AS language, 0 AS n_competencies, 0.0 AS confidence, 'no extractor for candidates is configured' AS warning, n_chars > 5000 AS truncated FROM documents""")
def candidate_profile(t):
    made = pf.candidate_profile(F.col("lang"), F.col("n_chars") > 5000)
    d = t("documents").select("doc_id", made.alias("p"))
    return d.select("doc_id", "p.language", F.size("p.competencies").alias("n_competencies"), "p.confidence", F.col("p.warnings")[0].alias("warning"), "p.truncated")


@_query("""SELECT doc_id, unnest(list_filter([CASE WHEN n_chars % 3 <> 0 AND n_chars % 4 = 0 THEN 'span bounds' END, CASE WHEN n_chars % 2 = 0 AND n_chars % 3 = 0 THEN 'explicit without evidence' END,
CASE WHEN n_chars % 5 = 0 THEN 'unknown kind' END], lambda r: r IS NOT NULL)) AS rule FROM documents""")
def profile_checks(t):
    n = F.col("n_chars")
    span = F.when(n % 3 != 0, F.struct(F.lit(0).alias("start"), (n % 4).cast("int").alias("end")))
    kind = F.when(n % 5 == 0, "hobby").otherwise("experience")
    one = F.struct(kind.alias("kind"), F.lit("required").alias("necessity"), (n % 2 == 0).alias("explicit"), span.alias("evidence"))
    return t("documents").select("doc_id", F.explode(pf.profile_violations(one)).alias("rule"))


@_query("SELECT label AS model, len(embedding) AS dimensions, count(*) AS rows FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2")
def dimension_report(t):
    return mt.dimension_report(t("embeddings").where("embedding is not null").withColumnRenamed("label", "model"), "model", "embedding")


@_query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS n_chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS n_blanks, NULL::VARCHAR AS error FROM documents")
def embedded_texts(t):
    def embedder(texts: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(x.count(" "))] for x in texts]

    made = bt.embed_texts(t("documents"), "doc_id", "text", embedder)
    return made.select("doc_id", F.col("vector")[0].alias("n_chars"), F.col("vector")[1].alias("n_blanks"), "error")


_SPANS = """s AS (SELECT doc_id, n_chars, CASE WHEN n_chars % 5 = 0 THEN 'bare' WHEN length(text) < 4 THEN 'out of bounds' WHEN n_chars % 7 = 0 THEN 'misquoted' ELSE 'kept' END AS outcome
FROM documents WHERE text IS NOT NULL AND n_chars % 4 <> 0)"""


def _competencies(t) -> DataFrame:
    d = t("documents").where("text is not null and n_chars % 4 <> 0")
    quote = F.when(F.col("n_chars") % 5 == 0, "").when(F.col("n_chars") % 7 == 0, "~~~~").otherwise(F.substring("text", 1, 4))
    label = F.element_at(F.array(*map(F.lit, ("tool", "Tool", "professional skill"))), (F.col("n_chars") % 3 + 1).cast("int"))
    spans = d.select("doc_id", label.alias("label"), F.lit(0).alias("start_char"), F.lit(4).alias("end_char"), quote.alias("quote"), (F.col("n_chars") % 3 / 1.5).alias("confidence"))
    return pf.competencies(pf.verified_spans(d, spans))


@_query(f"""WITH {_SPANS} SELECT doc_id, CASE WHEN outcome = 'kept' THEN ['tool', 'other', 'professional_skill'][n_chars % 3 + 1] END AS category,
CASE WHEN outcome = 'kept' THEN least(n_chars % 3 / 1.5::DOUBLE, 1.0::DOUBLE) END AS confidence, nullif(outcome, 'kept') AS rejected FROM s""")
def span_competencies(t):
    return _competencies(t).select("doc_id", F.get("kept.category", 0).alias("category"), F.get("kept.confidence", 0).alias("confidence"), F.get("rejected.reason", 0).alias("rejected"))


@_query(f"""WITH {_SPANS} SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'structural' ELSE 'neural' END AS origin, s.doc_id IS NULL AS review FROM documents d LEFT JOIN s USING (doc_id)""")
def structural_fallback(t):
    return pf.with_fallback(t("documents"), _competencies(t)).select("doc_id", "origin", "review")


@_query(f"""WITH {_SPANS} SELECT doc_id, CASE WHEN d.n_chars % 9 = 0 THEN 'not parsed: failed' ELSE 'extracted' END AS outcome, CASE WHEN d.n_chars % 9 = 0 THEN NULL WHEN s.doc_id IS NULL THEN 'structural' ELSE 'neural' END AS origin,
CASE WHEN d.n_chars % 9 <> 0 AND outcome = 'kept' THEN 1 ELSE 0 END AS n_competencies FROM documents d LEFT JOIN (SELECT doc_id, outcome FROM s) s USING (doc_id)""")
def extraction_run(t):
    status = F.when(F.col("n_chars") % 9 == 0, "failed").otherwise("parsed")
    return pf.extraction_run(t("documents").select("doc_id", status.alias("status")), _competencies(t))


@_query("""SELECT event_id, status, published_at FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 30 THEN 'published' ELSE 'pending' END AS status, ts AS published_at FROM events)
WHERE status <> 'published' OR published_at >= TIMESTAMP '2024-01-15'""")
def purge_published(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 30, "published").otherwise("pending")
    e = t("events").select("event_id", status.alias("status"), F.col("ts").alias("published_at"))
    return st.purge_published(e, F.lit("2024-01-15").cast("timestamp_ntz"))


@_query("SELECT doc_id, lang AS language, CAST(n_chars AS VARCHAR) AS n_chars, coalesce(n_chars % 2 = 0, false) AS is_even FROM documents")
def field_snapshot(t):
    """Facts frozen as JSON with a revision, and read from it again."""
    raw = F.to_json(render.snapshot({"language": F.col("lang"), "n_chars": F.col("n_chars"), "even": F.col("n_chars") % 2 == 0}))
    d = t("documents").select("doc_id", raw.alias("facts"))
    path = lambda p: F.get_json_object("facts", p)
    return d.select("doc_id", path("$.language").alias("language"), path("$.n_chars").alias("n_chars"), tx.json_flag(F.col("facts"), "$.even").alias("is_even"))


@_query("""SELECT p_partkey, p_brand AS required, CASE WHEN lower(p_name) = lower(p_brand) THEN p_name ELSE p_name || '; ' || p_brand END AS preferred, p_type AS other FROM part""")
def competency_lists(t):
    one = lambda need, name: F.struct(F.lit(need).cast("string").alias("necessity"), name.alias("name"))
    items = F.array(
        one("required", F.col("p_brand")), one("required", F.lower("p_brand")), one("preferred", F.col("p_name")), one("preferred", F.col("p_brand")),
        one("optional", F.col("p_type")), one(None, F.upper("p_type")), one(None, F.lit(" ")),
    )
    return t("part").select("p_partkey", *(c.alias(n) for n, c in render.competency_lists(items).items()))


@_query("SELECT doc_id, 'Which posting fits?' || chr(10) || chr(10) || substr(text, 1, 50) AS query FROM documents")
def rerank_queries(t):
    return t("documents").select("doc_id", render.rerank_query("Which posting fits?", F.substring("text", 1, 50)).alias("query"))


@_query("""SELECT DISTINCT concept_id, label FROM (SELECT p_partkey AS concept_id, p_type AS label FROM part UNION ALL SELECT l_partkey, l_returnflag FROM lineitem UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 20)""")
def merged_labels(t):
    part = t("part")
    imported = part.select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("label"))
    used = t("lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_returnflag").alias("label"))
    return ln.merge_labels(imported, used, part.where("p_size > 20").select(F.col("p_partkey").alias("concept_id"), F.col("p_brand").alias("label")))


@_query("""SELECT 'a' AS source, page_id AS id, 'Senior page ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Kyiv|Lviv' END AS places, 'senior' AS seniority, page_id % 2 = 0 AS remote FROM pages
UNION ALL SELECT 'b', doc_id, 'Junior cook', 'Kyiv, Lviv', 'junior', true FROM documents""")
def posting_union(t):
    """Two sources in one schema: pages with a title of their own, documents with that of their listing."""
    none = F.lit(None).cast("string")

    def parsed(df: DataFrame, key: str, title, location, remote) -> DataFrame:
        given = {"title": title, "listing_title": F.lit("Junior cook"), "location": location, "remote": remote, "external_id": F.col(key).cast("string")}
        empty = dict.fromkeys(("url", "company", "description", "listing_description", "experience", "salary"), none)
        return df.select(*(c.alias(n) for n, c in {**given, **empty}.items()))

    key = F.col("page_id")
    landed = {
        "a": parsed(t("pages"), "page_id", F.concat(F.lit("Senior page "), key.cast("string")), F.when(key % 3 != 0, "Kyiv, Lviv, Віддалено"), key % 2 == 0),
        "b": parsed(t("documents"), "doc_id", F.lit(" "), F.lit("Kyiv, Lviv"), F.lit(True)),
    }
    union = po.all_sources({"a": lambda df: po.normalized(df, "a"), "b": lambda df: po.normalized(df, "b", split_places=False)}, landed)
    return union.select("source", F.col("external_id").cast("long").alias("id"), "title", F.array_join("places", "|").alias("places"), "seniority", "remote")


@_stream_query("events", "SELECT props AS term, count(*) AS occurrences, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events WHERE props IS NOT NULL GROUP BY 1")
def stream_counts(stream):
    return st.stream_counts(stream.withColumnRenamed("props", "term"), "term", "event_id")
