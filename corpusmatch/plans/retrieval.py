"""Queries of retrieval, fusion, requirement coverage and the whole matching pass, in batch and on triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmatch.operators import graph as gr
from corpusmatch.operators import lexical as lx
from corpusmatch.operators import passes as ps
from corpusmatch.operators import requirements as rq
from corpusmatch.operators.matching import MatchConfig
from corpusmatch.operators.storage import shared_folder
from corpusmatch.plans.registry import query
from corpusmatch.streaming import matching as sm

_WORDS = r"[\p{L}\p{N}_]+"
#: Every document against every benchmark text: idf in thousandths, parts of scores in millionths.
_LEXICAL = rf"""lw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents),
ln AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS usual FROM lw),
lp AS (SELECT doc_id, term, len AS length, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w)::DOUBLE AS len, unnest(w) AS term FROM lw) GROUP BY ALL),
ls AS (SELECT term, floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 1000.0::DOUBLE + 0.5::DOUBLE) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM lp GROUP BY 1), ln),
lq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS term FROM benchmark),
lt AS (SELECT query_id, doc_id, CAST(sum(CAST(floor(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / usual))) * 1000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS score
 FROM lq JOIN ls USING (term) JOIN lp USING (term), ln GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM lt) WHERE rank <= 50)"""


def _lexical(t) -> DataFrame:
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lx.lexical_topk(asked, lx.lexical_index(t("documents"), asked=asked), 50)


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, score, rank FROM lexical")
def lexical_topk(t):
    return _lexical(t)


#: A user for each benchmark text: the vector of twenty times its id.
_DENSE = """dq AS (SELECT vec_id // 20 AS user_id, vec_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0 AND vec_id // 20 IN (SELECT item_id FROM benchmark)),
ds AS (SELECT dq.user_id, e.vec_id AS item_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), qv) AS similarity FROM dq, embeddings e),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM ds) WHERE rank <= 50)"""


@query(f"""WITH {_LEXICAL}, {_DENSE}, f AS (SELECT coalesce(d.user_id, l.query_id) AS user_id, coalesce(d.item_id, l.doc_id) AS item_id, d.rank AS dense_rank, l.rank AS lexical_rank,
 coalesce(1.0::DOUBLE / (60.0::DOUBLE + d.rank), 0) + coalesce(0.5::DOUBLE / (60.0::DOUBLE + l.rank), 0) AS score FROM dense d FULL JOIN lexical l ON l.query_id = d.user_id AND l.doc_id = d.item_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM f) WHERE rank <= 75""")
def fused_ranking(t):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = t("benchmark").select(F.col("item_id").alias("user_id"))
    users = e.where("vec_id % 20 = 0").select(F.expr("vec_id div 20").alias("user_id"), "vector").join(asked, "user_id", "left_semi")
    found = ps.retrieved(users, e.withColumnRenamed("vec_id", "item_id"), MatchConfig(retrieval_limit=50))
    dense = found.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), "item_id")))
    lexical = _lexical(t).select(F.col("query_id").alias("user_id"), F.col("doc_id").alias("item_id"), "rank")
    return lx.fused({"dense": (dense, 1.0), "lexical": (lexical, 0.5)}, limit=75)


#: Concepts 0 to 399, each under the one of a quarter of its number.
_COVERAGE = """h AS (SELECT DISTINCT p_partkey % 400 AS node, p_partkey % 400 // 4 AS ancestor, 1 AS distance FROM part WHERE p_partkey % 400 > 0),
a AS (SELECT * FROM h UNION ALL SELECT node, node // 16, 2 FROM (SELECT DISTINCT node FROM h WHERE node >= 4) UNION ALL SELECT node, node // 64, 3 FROM (SELECT DISTINCT node FROM h WHERE node >= 16)
 UNION ALL SELECT node, node // 256, 4 FROM (SELECT DISTINCT node FROM h WHERE node >= 64) UNION ALL SELECT node, 0, 5 FROM (SELECT DISTINCT node FROM h WHERE node >= 256)),
r AS (SELECT p_partkey AS posting_id, p_partkey * 3 + k AS requirement_id, (p_partkey * 7 + k * 31) % 400 AS concept_id, CASE (p_size + k) % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'unspecified' END AS necessity, (p_size + k) % 10 = 0 AS negated FROM part, range(0, 3) AS s(k)),
e AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, o_custkey AS user_id, l_partkey % 400 AS concept_id, l_returnflag <> 'R' AS has, l_linestatus = 'F' AS confirmed, l_discount AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS posting_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
q AS (SELECT * FROM p JOIN r USING (posting_id)),
f AS (SELECT q.user_id, q.posting_id, requirement_id, evidence_id, confidence, CASE WHEN has = negated THEN 0 WHEN confirmed THEN 1 ELSE 2 END AS ord, 0 AS distance FROM q JOIN e ON e.user_id = q.user_id AND e.concept_id = q.concept_id
 UNION ALL SELECT q.user_id, q.posting_id, requirement_id, evidence_id, confidence, 3, a.distance FROM q JOIN a ON a.ancestor = q.concept_id JOIN e ON e.user_id = q.user_id AND e.concept_id = a.node WHERE has AND NOT negated
 UNION ALL SELECT q.user_id, q.posting_id, requirement_id, evidence_id, confidence, 4, a.distance FROM q JOIN a ON a.node = q.concept_id JOIN e ON e.user_id = q.user_id AND e.concept_id = a.ancestor WHERE has AND NOT negated),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, posting_id, requirement_id ORDER BY ord, distance, confidence DESC, evidence_id) AS nth FROM f) WHERE nth = 1),
statuses AS (SELECT q.user_id, q.posting_id, q.requirement_id, necessity, CASE ord WHEN 0 THEN 'conflicting' WHEN 1 THEN 'satisfied' WHEN 2 THEN 'satisfied' WHEN 3 THEN 'partial' WHEN 4 THEN 'partial' ELSE 'unknown' END AS status,
 ['denied', 'confirmed', 'concept', 'narrower', 'broader'][ord + 1] AS method, evidence_id FROM q LEFT JOIN b USING (user_id, posting_id, requirement_id))"""


def _statuses(t) -> DataFrame:
    part, node = t("part"), F.col("p_partkey") % 400
    edges = part.where(node > 0).select(node.alias("child"), F.expr("(p_partkey % 400) div 4").alias("parent"))
    each = part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    turn = F.col("p_size") + F.col("k")
    needs = each.select(
        F.col("p_partkey").alias("posting_id"), (F.col("p_partkey") * 3 + F.col("k")).alias("requirement_id"), ((F.col("p_partkey") * 7 + F.col("k") * 31) % 400).alias("concept_id"),
        F.when(turn % 3 == 0, "required").when(turn % 3 == 1, "preferred").otherwise("unspecified").alias("necessity"), (turn % 10 == 0).alias("negated"),
    )
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    evidence = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("o_custkey").alias("user_id"), (F.col("l_partkey") % 400).alias("concept_id"),
        (F.col("l_returnflag") != "R").alias("has"), (F.col("l_linestatus") == "F").alias("confirmed"), F.col("l_discount").alias("confidence"),
    )
    pairs = lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("posting_id"))
    return rq.requirement_statuses(pairs, needs, evidence, gr.ancestors(edges))


@query(f"WITH {_COVERAGE} SELECT user_id, posting_id, requirement_id, necessity, status, method, evidence_id FROM statuses")
def requirement_statuses(t):
    return _statuses(t)


@query(f"""WITH {_COVERAGE}, v AS (SELECT *, CASE status WHEN 'satisfied' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.65::DOUBLE WHEN 'unknown' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS v FROM statuses),
c AS (SELECT user_id, posting_id, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'conflicting') AS conflicting,
 avg(v) FILTER (necessity = 'required') AS required_coverage, avg(v) FILTER (necessity = 'preferred') AS preferred_coverage, avg(CASE WHEN status = 'unknown' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS evidence_completeness FROM v GROUP BY 1, 2)
SELECT user_id, posting_id, satisfied, partial, unknown, conflicting, floor(required_coverage * 1000000 + 0.5) / 1000000 AS required_coverage, floor(preferred_coverage * 1000000 + 0.5) / 1000000 AS preferred_coverage,
 floor(evidence_completeness * 1000000 + 0.5) / 1000000 AS evidence_completeness, floor((coalesce(3.0::DOUBLE * required_coverage, 0) + coalesce(preferred_coverage, 0)) /
 nullif(CASE WHEN required_coverage IS NULL THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END + CASE WHEN preferred_coverage IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 0) * 1000000 + 0.5) / 1000000 AS requirement_coverage FROM c""")
def requirement_coverage(t):
    out = rq.coverage(_statuses(t))
    shares = ("required_coverage", "preferred_coverage", "evidence_completeness", "requirement_coverage")
    return out.withColumns({c: F.floor(F.col(c) * 1000000.0 + 0.5) / 1000000.0 for c in shares})


_CONFIG = MatchConfig(retrieval_limit=50)
_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_PASS = rf"""u AS (SELECT vec_id AS user_id, CAST(embedding AS DOUBLE[]) AS qv, p_name || ' ' || p_type AS query, CASE WHEN vec_id % 60 = 0 THEN lower(p_brand) END AS listed, CASE WHEN vec_id % 40 = 0 THEN 35.0::DOUBLE END AS most, 950.0::DOUBLE AS wanted
 FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 20 = 0),
i AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, p_name || ' ' || p_type AS document, p_brand, p_size, p_retailprice FROM embeddings JOIN part ON p_partkey = vec_id),
s AS (SELECT u.*, i.*, list_cosine_similarity(v, qv) AS similarity FROM u, i),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) AS near FROM s) WHERE near <= 50),
m AS (SELECT *, {_TOKENS.format('query')} AS q, {_TOKENS.format('document')} AS d, concat_ws('; ', CASE WHEN lower(trim(p_brand)) = listed THEN 'company "' || p_brand || '" is blacklisted' END,
 CASE WHEN p_size > most THEN 'requires ' || CAST(p_size AS DOUBLE) || '+ years, candidate caps at ' || most END,
 CASE WHEN p_retailprice < wanted THEN 'salary tops out at ' || CAST(p_retailprice AS DOUBLE) || ' USD, below desired ' || CAST(wanted AS BIGINT) || ' USD' END) AS reasons FROM k),
r AS (SELECT *, CASE WHEN reasons = '' THEN len(list_intersect(q, d))::DOUBLE / nullif(len(q), 0) END AS relevance FROM m),
b AS (SELECT *, CASE WHEN reasons <> '' THEN 0.0 WHEN relevance IS NULL THEN floor(least(greatest(similarity, 0.0), 1.0) * 100 * 10 + 0.5) / 10
 ELSE floor((0.7::DOUBLE * least(greatest(relevance, 0.0), 1.0) + (1 - 0.7::DOUBLE) * least(greatest(similarity, 0.0), 1.0)) * 100 * 10 + 0.5) / 10 END AS score FROM r)
SELECT user_id, item_id, reasons, relevance, score, CASE WHEN relevance IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC NULLS LAST, item_id) AS INTEGER) END AS rerank_position,
 CASE WHEN reasons <> '' THEN 'skip' WHEN score >= 70 THEN 'apply' WHEN score >= 45 THEN 'consider' ELSE 'skip' END AS recommendation FROM b"""


def _sides(t) -> tuple[DataFrame, DataFrame]:
    both = t("embeddings").join(t("part"), F.col("vec_id") == F.col("p_partkey")).withColumn("vector", F.col("embedding").cast("array<double>"))
    none = F.expr("cast(array() as array<string>)")
    text = F.concat("p_name", F.lit(" "), "p_type")
    listed = F.when(F.col("vec_id") % 60 == 0, F.array(F.lower("p_brand"))).otherwise(none)
    users = both.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("user_id"), "vector", text.alias("query"), F.lit("overlap").alias("model"), listed.alias("blacklist"), none.alias("blocked"),
        F.when(F.col("vec_id") % 40 == 0, 35.0).alias("max_years"), F.lit(950.0).alias("desired_salary"), none.alias("formats"), none.alias("locations"),
    )
    postings = both.select(
        F.col("vec_id").alias("item_id"), "vector", text.alias("document"), F.col("p_brand").alias("company"), F.col("p_size").cast("double").alias("years"), F.col("p_retailprice").alias("salary_max"),
        F.lit("USD").alias("currency"), F.lit(True).alias("remote"), none.alias("places"),
    )
    return users, postings


def _shown(out: DataFrame) -> DataFrame:
    return out.select("user_id", "item_id", F.array_join("reasons", "; ").alias("reasons"), "relevance", "score", "rerank_position", "recommendation")


@query("WITH " + _PASS)
def whole_pass(t):
    """All in one: retrieval, filters with the users' own wishes, relevance kept from before for a third of the pairs and made for the others, blend, bands."""
    users, postings = _sides(t)
    # Relevances of an earlier pass for a third of the pairs, half of them of another text, so not to be used.
    own = F.when(F.col("item_id") % 2 == 0, F.sha2("document", 256)).otherwise(F.lit("other"))
    known = ps.retrieved(users, postings, _CONFIG).where("item_id % 3 = 0").join(users.select("user_id", "query", "model"), "user_id").join(postings.select("item_id", "document"), "item_id")
    score = F.when(F.col("item_id") % 2 == 0, ps.token_overlap(F.col("query"), F.col("document"))).otherwise(0.123)
    stored = known.select("user_id", "item_id", "model", F.sha2("query", 256).alias("query_hash"), own.alias("doc_hash"), score.alias("relevance"))
    return _shown(ps.whole_pass(users, postings, stored, _CONFIG))


@query("WITH " + _PASS)
def stream_whole_pass(t):
    """The same rows after two triggers: first users with other wishes and two thirds of the postings, some with another vector, then what changed."""
    users, postings = _sides(t)
    spark, folder = users.sparkSession, shared_folder(users.sparkSession, "matching")
    turned = F.when(F.col("item_id") % 5 == 0, F.reverse("vector")).otherwise(F.col("vector"))
    early = postings.where("item_id % 3 <> 1").withColumns({"vector": turned, "salary_max": F.when(F.col("item_id") % 7 == 0, 1.0).otherwise(F.col("salary_max"))})
    first = sm.changes_of(users.withColumn("max_years", F.when(F.col("user_id") % 40 == 0, 10.0)), early, 1)
    late = postings.where("item_id % 3 = 1 or item_id % 5 = 0 or item_id % 7 = 0")
    out = None
    for name, changes in (("a", first), ("b", sm.changes_of(users.where("user_id % 40 = 0"), late, 2))):
        changes.write.parquet(f"{folder}/in/{name}")
        stream = spark.readStream.schema(sm.CHANGE).parquet(f"{folder}/in/*")
        out = sm.stream_matching(stream, f"{folder}/state", _CONFIG)
    return _shown(out)
