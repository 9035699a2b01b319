"""Linking anew after the taxonomy changed, of those documents only whose forms changed.

A word index (token, doc_id) of the corpus is kept with the links. Two alias indexes are compared; a form that came, went
or changed can touch only documents that have all its words, found from its rarest word. All other documents would be
linked as before, since a scan of a text asks for forms of the text's own words and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.operators.linking import link_rows, tokenize
from corpusmatch.operators.storage import written


def word_index(docs: DataFrame) -> DataFrame:
    """(token, doc_id): each word of each document once, cut and lower-cased as the scan does. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words, rows = [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    own = {w for w, _, _ in tokenize(text)}
                    words += own
                    rows += [row] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column("doc_id").take(pa.array(rows, pa.int64()))], ["token", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"token string, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def changed_forms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(form, change): forms of two alias indexes that were added or removed, or whose concepts or specificity changed."""
    one = lambda df: df.select("form", F.struct("concept_ids", "specificity").alias("now"))
    both = one(old).withColumnRenamed("now", "was").join(one(new), "form", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("form", change.alias("change")).where("change is not null")


def touched_documents(words: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_id of every document that has all words of some changed form.

    Of each form the rarest word looks up documents, and the other words are then asked for in these alone; a form
    with a word that no document has touches none.
    """
    parts = changed.select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("token"))
    # All that follows needs the words of changed forms only, a small share of the corpus: they are looked up once.
    words = written(words.join(parts.select("token").distinct(), "token", "left_semi"), "changed-words")
    uses = words.groupBy("token").agg(F.count("*").alias("uses"))
    known = parts.join(uses, "token", "left")
    first = known.groupBy("form").agg(F.min_by("token", F.struct("uses", "token")).alias("token"), F.count("*").alias("n"), F.count("uses").alias("found"))
    first = first.where("found = n").select("form", "token", "n")
    near = first.join(words, "token")
    rest = near.where("n > 1").select("form", "doc_id", "n").join(parts, "form").join(words, ["token", "doc_id"], "left_semi")
    whole = rest.groupBy("form", "doc_id", "n").agg(F.count("*").alias("found")).where("found = n")
    return near.where("n = 1").select("doc_id").unionByName(whole.select("doc_id")).distinct()


def relink(rows: DataFrame, docs: DataFrame, spans: DataFrame, words: DataFrame, old: DataFrame, new: DataFrame, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows of `link_rows` as the new index gives them, documents touched).

    rows: what `link_rows` gave for all docs and spans with the old index; words: the `word_index` of docs. Spans are read
    from storage and not extracted again. Rows of documents that no changed form can touch are kept as they are.
    """
    touched = written(touched_documents(words, changed_forms(old, new)), "touched")
    again = link_rows(docs.join(touched, "doc_id", "left_semi"), spans.join(touched, "doc_id", "left_semi"), new, longest)
    return rows.join(touched, "doc_id", "left_anti").unionByName(again), touched
