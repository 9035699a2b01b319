"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusmatch.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        number = not isinstance(v, (bool, str)) and hasattr(v, "__float__") and type(v).__name__ not in ("Timestamp", "bool_")
        return f"{float(v):.9g}" if number else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    if name in plans.oracle_sql():
        want = duck.execute(plans.oracle_sql()[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_unmapped_terms_know_phrases_of_eight_words(spark, tmp_path):
    """Forms of more than two words were unknown, so the last word of a longer phrase counted as a term without a concept."""
    texts = ["one two three four five six seven green", "aaa bbb green", *(f"green x{k}" for k in range(30))]
    docs = [(1, texts[0], "de"), (2, "Aaa, bbb green!", "de"), (3, "so green", "de"), (4, "aaa bbb green\nof nothing known\nGreen", "en"), (5, None, "de")]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["unmapped_terms"](spark, str(tmp_path))
    want = {("green", 2, "green", 3, 4), ("of nothing known", 1, "of nothing known", 4, 4)}
    assert {(r.form, r.occurrences, r.sample, r.first_seen, r.last_seen) for r in got.collect()} == want
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    said = con.execute(f"select form, occurrences, sample, first_seen, last_seen from ({plans.oracle_sql()['unmapped_terms']})").fetchall()
    assert set(said) == want and len(said) == 2


def test_requirement_statuses_broadcast_no_requirements(spark):
    """Three requirements a part, each with its concept's ancestors, are not sent whole to the driver, however small their tables are taken for."""
    plan = plans.queries()["requirement_statuses"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [posting_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_entry(spark):
    assert entry.entry(spark).count() > 0
