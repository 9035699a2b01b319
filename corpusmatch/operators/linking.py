"""Concept linking: alias index, longest matches in text without overlaps, given spans, and the rows of a linked profile."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
_PARTS = re.compile(r"(\w+)")
_FOUND = ["start_char", "end_char", "start", "words", "raw_text", "form"]
_SCHEMA = "start_char int, end_char int, start int, words int, raw_text string, form string"


def normalize_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))


def alias_index(labels: DataFrame, shortest: int = 3) -> DataFrame:
    """form, words, n_concepts, concept_ids (sorted), concept_id (the smallest), specificity from (concept_id, label).

    A single word's specificity falls with the number of label occurrences that contain it; phrases have 1.
    """
    forms = labels.select("concept_id", normalize_label(F.col("label")).alias("form")).where(F.length("form") >= shortest)
    parts = forms.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    index = forms.groupBy("form").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))
    index = index.withColumns({"concept_id": F.col("concept_ids")[0], "n_concepts": F.size("concept_ids").cast("long"), "words": F.size(F.split("form", " "))})
    single = F.when(F.col("words") == 1, 1.0 / (1.0 + F.col("uses") / 20.0)).otherwise(1.0)
    return index.join(parts, F.col("form") == F.col("word"), "left").withColumn("specificity", F.coalesce(single, F.lit(1.0))).drop("word", "uses")


def merge_labels(*sets: DataFrame) -> DataFrame:
    """One (concept_id, label) set from several, each pair once."""
    out = sets[0].select("concept_id", "label")
    for one in sets[1:]:
        out = out.unionByName(one.select("concept_id", "label"))
    return out.distinct()


def link_status(n_concepts, specificity, least: float = 0.2):
    return F.when(specificity < least, "unmapped").when(n_concepts == 1, "linked").when(n_concepts > 1, "ambiguous").otherwise("unmapped")


def tokenize(text: str | None) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; words are runs of letters, digits and underscores."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]


class FormTrie:
    """Forms as a tree of their words: one walk from a word of a text finds the longest form that begins there.

    Only words that some form has are kept, each once, so a text's other words end a walk at the first look.
    """

    def __init__(self, forms, longest: int) -> None:
        self.root: dict[str, list] = {}
        for form in forms:
            words = form.split(" ")
            if len(words) <= longest:
                children = self.root
                for word in words:
                    node = children.setdefault(word, [{}, None])
                    children = node[0]
                node[1] = form

    def matches(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int], list[str], list[str]]:
        """Columns start_char, end_char, start, words, raw_text, form. From left to right the longest form wins and its words are used up."""
        low = (text or "").lower()
        if len(low) == len(text or ""):
            parts = _PARTS.split(low)
            words, ends = parts[1::2], list(itertools.accumulate(map(len, parts)))
            begins, ends = ends[0::2], ends[1::2]
        else:  # a letter that grows when it is lower-cased would shift all places after it
            words, begins, ends = map(list, zip(*tokenize(text), strict=True)) if _WORD.search(text) else ([], [], [])
        first, stops, forms = [], [], []
        root, at, n = self.root, 0, len(words)
        while at < n:
            node = root.get(words[at])
            if node is None:
                at += 1
                continue
            children, best = node
            stop, k = at + 1, at + 1
            while children and k < n:
                node = children.get(words[k])
                if node is None:
                    break
                k += 1
                children, form = node
                if form is not None:
                    best, stop = form, k
            if best is not None:
                first.append(at)
                stops.append(stop)
                forms.append(best)
            at = stop
        start, end = [begins[k] for k in first], [ends[k - 1] for k in stops]
        return start, end, first, [b - a for a, b in zip(first, stops, strict=True)], [text[a:b] for a, b in zip(start, end, strict=True)], forms


def _mapped(df: DataFrame, keys: list[str], text: str, each) -> DataFrame:
    """keys and the columns of matches that `each` finds in the text of every row, in one pass; memory is a part's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, out = [], ([], [], [], [], [], [])
                for row, one in enumerate(batch.column(text).to_pylist()):
                    found = each(one)
                    rows += [row] * len(found[0])
                    for column, values in zip(out, found, strict=True):
                        column += values
                owners = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
                columns = [pa.array(c, k) for c, k in zip(out, [pa.int32()] * 4 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*owners, *columns], [*keys, *_FOUND])

    owners = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{owners}, {_SCHEMA}")


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """df in at least as many parts as tasks can run at once, dealt by the columns, if any; a scan of texts costs more than dealing out a small table.

    To count the parts of what comes out of a shuffle Spark runs that shuffle, so only tables as they are read belong here.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *by) if df.rdd.getNumPartitions() < tasks else df


def scan_mentions(docs: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", longest: int = 8, most_forms: int = 1_000_000, spread: bool = True) -> DataFrame:
    """keys, start_char, end_char, start (word), words, raw_text, form: longest matches of index forms, without overlaps.

    Up to `most_forms` forms are broadcast as a tree of words and every text is walked in one pass. More forms than that stay where
    they are: all n-grams meet them by a join, and each text's hits are then told apart in order, with the same result. `spread` is for tables that no shuffle has dealt out.
    """
    keys_ = list(keys)
    forms = index.select("form").distinct()
    few = forms.limit(most_forms + 1).toPandas()["form"]
    if len(few) <= most_forms:
        known = docs.sparkSession.sparkContext.broadcast(FormTrie(few, longest))
        return _mapped(_spread(docs.select(*keys_, text)) if spread else docs, keys_, text, lambda one: known.value.matches(one))

    def grams(one: str | None) -> tuple[list, ...]:
        t = tokenize(one)
        rows = [
            (t[k][1], t[k + n - 1][2], k, n, one[t[k][1] : t[k + n - 1][2]], " ".join(w[0] for w in t[k : k + n]))
            for k in range(len(t)) for n in range(1, min(longest, len(t) - k) + 1)
        ]
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * 6

    hits = _mapped(docs, keys_, text, grams).join(forms, "form")
    # Of the hits at a word only the longest can count; those left are taken if they start where the last one taken ended, or later.
    hits = hits.groupBy(*keys_, "start").agg(F.max_by(F.struct(*_FOUND), "words").alias("hit"))
    ordered = hits.groupBy(*keys_).agg(F.sort_array(F.collect_list(F.struct("start", "hit"))).alias("hits"))
    none = F.expr(f"cast(array() as array<struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>>)")
    step = lambda s, h: F.when(
        h["start"] >= s["cursor"],
        F.struct((h["start"] + h["hit"]["words"]).alias("cursor"), F.concat(s["kept"], F.array(h["hit"])).alias("kept")),
    ).otherwise(s)
    kept = F.aggregate("hits", F.struct(F.lit(0).alias("cursor"), none.alias("kept")), step)["kept"]
    return ordered.select(*keys_, F.explode(kept).alias("m")).select(*keys_, "m.*")


def _span_forms(spans: DataFrame, index: DataFrame, longest: int, most_forms: int) -> DataFrame:
    """(doc_id, raw_text, form, start_char, end_char) of `link_spans`, without what the index says of a form."""
    # Dealt by place, as what is left without a form is told apart by that, too: long texts move once.
    place = ["doc_id", "start_char", "end_char"]
    own = spans.select("raw_text", *place).repartition(*place).distinct().withColumn("form", normalize_label(F.col("raw_text")))
    known = index.select("form")
    missed = own.join(known, "form", "left_anti")
    shifted = missed.select("doc_id", F.col("start_char").alias("shift"), F.col("end_char").alias("until"), "raw_text")
    inside = scan_mentions(shifted, index, ("doc_id", "shift", "until"), "raw_text", longest, most_forms, spread=False)
    places = {"start_char": F.col("start_char") + F.col("shift"), "end_char": F.col("end_char") + F.col("shift")}
    columns = ["doc_id", "raw_text", "form", "start_char", "end_char"]
    seen = inside.select("doc_id", F.col("shift").alias("start_char"), F.col("until").alias("end_char")).distinct()
    rest = missed.join(seen, place, "left_anti")
    whole = own.join(known, "form", "left_semi")
    return whole.select(columns).unionByName(inside.withColumns(places).select(columns)).unionByName(rest.select(columns))


def link_spans(spans: DataFrame, index: DataFrame, longest: int = 8, most_forms: int = 1_000_000) -> DataFrame:
    """Given spans to mentions: (doc_id, raw_text, form, start_char, end_char, concept_ids, specificity).

    spans: (doc_id, raw_text, start_char, end_char). The whole phrase first; else the forms inside it, at their places
    in the document; else the span itself without concepts.
    """
    none = F.array().cast(index.schema["concept_ids"].dataType)
    out = _span_forms(spans, index, longest, most_forms).join(index.select("form", "concept_ids", "specificity"), "form", "left")
    told = {"concept_ids": F.coalesce("concept_ids", none), "specificity": F.coalesce("specificity", F.lit(1.0))}
    return out.withColumns(told).select("doc_id", "raw_text", "form", "start_char", "end_char", "concept_ids", "specificity")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """The first mention of each form in a document."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "form").orderBy("start_char", "end_char"))
    return mentions.withColumn("nth", nth).where("nth = 1").drop("nth")


def link_rows(docs: DataFrame, spans: DataFrame, index: DataFrame, longest: int = 8) -> DataFrame:
    """Rows of linked profiles: doc_id, form, raw_text, start_char, end_char, status, concept_id, alternatives, link_score, confidence.

    docs: (doc_id, text); spans: (doc_id, raw_text, start_char, end_char, confidence). Documents with spans link those,
    others are scanned whole. One row a form, its first. Only linked ones have a concept, only ambiguous ones
    alternatives. The confidence is that of the span at the same place, 1 for what was found otherwise.
    """
    own = _spread(docs.select("doc_id", "text"), "doc_id").join(spans.select("doc_id").distinct(), "doc_id", "left_anti")
    scanned = scan_mentions(own, index, longest=longest, spread=False)
    given = _span_forms(spans, index, longest, 1_000_000)
    # A raw text that is its form goes along as a null: most are, and all mentions are moved.
    found = first_mentions(given.unionByName(scanned.select(*given.columns)).withColumn("raw_text", F.nullif("raw_text", "form")))
    sure = spans.groupBy("doc_id", "start_char", "end_char").agg(F.max("confidence").alias("confidence"))
    found = found.join(sure, ["doc_id", "start_char", "end_char"], "left")
    # What the index says of a form, its list of concepts above all, would be moved with every mention: it comes last.
    status = link_status(F.size("concept_ids"), F.col("specificity"))
    known = index.select(
        "form", status.alias("status"), F.when(status == "linked", F.col("concept_ids")[0]).alias("concept_id"),
        F.when(status == "ambiguous", F.col("concept_ids")).alias("alternatives"), F.col("specificity").alias("link_score"),
    )
    return found.join(known, "form", "left").select(
        "doc_id", "form", F.coalesce("raw_text", "form").alias("raw_text"), "start_char", "end_char", F.coalesce("status", F.lit("unmapped")).alias("status"), "concept_id", "alternatives",
        F.coalesce("link_score", F.lit(1.0)).alias("link_score"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def status_counts(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """linked, ambiguous and unmapped mentions of each profile."""
    return rows.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("linked", "ambiguous", "unmapped")))


def unmapped_counts(rows: DataFrame, seen: str = "doc_id") -> DataFrame:
    """form, occurrences, sample (the raw text seen first), first_seen, last_seen of mentions without a concept."""
    return rows.where("status = 'unmapped'").groupBy("form").agg(
        F.count("*").alias("occurrences"), F.min_by("raw_text", F.struct(seen, "start_char")).alias("sample"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")
    )


def review_queue(terms: DataFrame, least: int = 2, limit: int = 500) -> DataFrame:
    """Pending terms with enough occurrences, the most frequent first; at most 500."""
    pending = terms.where((F.col("status") == "pending") & (F.col("occurrences") >= least))
    return pending.orderBy(F.desc("occurrences"), "term").limit(min(limit, 500))


def legacy_promotions(terms: DataFrame) -> DataFrame:
    """Promoted terms that have no concept yet, the most frequent first."""
    return terms.where("status = 'promoted' and concept_id is null").orderBy(F.desc("occurrences"), "term")


def merge_language(concepts: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """concepts (concept_id, labels map<language, forms>) with one more language from (concept_id, forms).

    A language that a concept has is kept; labels of unknown concepts are passed over.
    """
    new = labels.groupBy("concept_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("new_forms"))
    both = concepts.join(new, "concept_id", "left")
    add = F.col("new_forms").isNotNull() & ~F.map_contains_key("labels", language)
    return both.withColumn("labels", F.when(add, F.map_concat("labels", F.create_map(F.lit(language), "new_forms"))).otherwise(F.col("labels"))).drop("new_forms")


def surface_forms(labels: Column) -> Column:
    """All forms of all languages of a concept."""
    return F.array_distinct(F.flatten(F.map_values(labels)))
