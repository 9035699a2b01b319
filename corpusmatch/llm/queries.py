"""Queries of the thirteen operators with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmatch.llm import ann, common, divergence, gam, jaccard, language_id, licenses, mixing, packing, phrases, pii, quality, sql, suffix_dedup, toxicity
from corpusmatch.llm.common import crc_mod, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    filters = language_id.fit(docs.where(crc_mod("doc_id", 5) > 0))
    return language_id.predict(docs, filters).select("doc_id", held, "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Model from the labelled documents that aren't held out."""
    own = labels.where(crc_mod("doc_id", 3) != 1).where("toxic is not null").select("doc_id", "toxic")
    return toxicity.fit(docs.select("doc_id", "text").join(own, "doc_id"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, pii.key_of(docs))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Params(words=4, percent=85))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.to_json("notices"))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) > 0))
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return gam.score(docs, model).select("doc_id", held, "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@cache
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing,
        op2_suffix_dedup,
        op3_language_id,
        op4_quality_rules,
        op5_multi_index,
        op6_source_mix,
        op7_toxicity,
        op8_pii_surrogates,
        op9_jaccard_join,
        op10_license_scan,
        op11_quality_model,
        op12_source_divergence,
        op13_phrase_collocations,
        pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mix": sql.OP6_SQL, "op12_source_divergence": sql.OP12_SQL, "op13_phrase_collocations": sql.OP13_SQL}
