"""Corpus pipeline: from raw documents to packed sequences, in stages that each run on what the one before kept.

Toxic documents go, one document of each group of near copies stays, personal data gets surrogates, sources are mixed
to their weights, and what is taken is packed. Every stage handles null and empty texts, repeated rows and empty
tables as its operator says; extra columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmatch.llm import jaccard, mixing, packing, pii, toxicity
from corpusmatch.llm.common import free_name, materialize, table
from corpusmatch.llm.queries import tokenizer_file, toxicity_model

#: Every stage of it needs a trained model, surrogates or a packing, none of which SQL can express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no more likely toxic than not. The model learns from the labels of the input that it may see.

    Null and empty texts score what the bias gives and stay where labels are mostly 0; repeated rows score alike; an
    empty table stays empty; other columns of any name pass.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, replace(model, params=replace(model.params, threshold=0.5)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one with the smallest doc_id.

    Documents without words are linked with nothing and all stay; of rows with the same doc_id one stays. Rows
    with a null doc_id can't be told apart and stay.
    """
    groups = jaccard.near_duplicates(docs, jaccard.Params(words=5, percent=80))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first, nth = Window.partitionBy("doc_id").orderBy(*docs.columns), free_name(docs, "nth")
    own = docs.join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first))
    own = own.where(F.col(nth) == 1).select(*docs.columns)
    return own.unionByName(docs.where("doc_id is null"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text.

    A null text stays null; repeated rows get the same text; an empty table stays empty; other columns of any name pass.
    """
    out = pii.replace_entities(docs, pii.key_of(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: twice, once or not at all. Those without words cost nothing and stay.

    A null source is a source of its own, the last; rows of one doc_id are taken as often as the one taken most; an
    empty table stays empty; other columns of any name pass.
    """
    key, times, copy = (free_name(docs, c) for c in ("key", "times", "copy"))
    taken = mixing.mix(docs)
    each = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    counts = taken.groupBy(F.col("doc_id").alias(key)).agg(F.max(each).alias(times))
    joined = docs.join(counts, F.col("doc_id").eqNullSafe(F.col(key))).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and its place there.

    Null and empty texts take one place; repeated rows are packed each for itself; an empty table gives no rows; other
    columns are left out.
    """
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
