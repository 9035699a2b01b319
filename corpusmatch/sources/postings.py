"""Postings from pages and listings: rows of listing pages, fields of detail pages, one schema for all sources, capped ingests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmatch.functions.text import cities, experience_years, salary, seniority
from corpusmatch.operators.storage import written
from corpusmatch.sources.pages import elements, inner_html, text_of

POSTING = "source string, external_id string, url string, title string, company string, description string, remote boolean, places array<string>, salary struct<min:double,max:double,currency:string>, seniority string, years double, employment_type string"

# What tells the items of a sidebar apart.
PLACE_CLASS, REMOTE_MARK, EXPERIENCE_MARK, CURRENCY_SIGNS = "location-text", "віддалено", "досвід", "[$€₴£]"


def _pages_to_rows(pages: DataFrame, key: str, html: str, columns: dict[str, str], parse: Callable[[str], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for row, source in enumerate(batch.column(1).to_pylist()):
                found = parse(source or "")
                owners += [row] * len(found)
                out += found
            lists = list(zip(*out, strict=True)) or [()] * len(columns)
            kinds = [pa.list_(pa.string()) if k == "array<string>" else pa.string() for k in columns.values()]
            own = batch.column(0).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(lists, kinds, strict=True))], [key, *columns])

    schema = ", ".join(f"{n} {k}" for n, k in columns.items())
    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {schema}")


def listing_rows(pages: DataFrame, key: str, html: str, base_url: str, id_pattern: str) -> DataFrame:
    """(key, external_id, url, title) of the links of listing pages whose address has an id.

    Relative addresses get the base; links without text or id are left out; of repeated ids of a page the first stays.
    """
    import re

    pattern = re.compile(id_pattern)

    def parse(source: str) -> list[tuple]:
        found: dict[str, tuple] = {}
        for a in elements(source, "a"):
            href, title = a.attrs.get("href") or "", text_of(a)
            if title and (m := pattern.search(href)):
                url = href if "://" in href else f"{base_url.rstrip('/')}/{href.lstrip('/')}"
                found.setdefault(m[1], (m[1], url, title))
        return [*found.values()]

    return _pages_to_rows(pages, key, html, dict.fromkeys(("external_id", "url", "title"), "string"), parse)


def detail_fields(pages: DataFrame, key: str, html: str, selectors: dict[str, str]) -> DataFrame:
    """(key, a column a selector, items, places) of detail pages.

    A selector is `tag`, `tag.class` or `.class`; the first element that fits gives its text, or its inner markup if the
    name ends in `_html`. items and places: texts of the list items of the page's `aside`, and of the place named in each,
    for `sidebar`. What isn't there is null.
    """

    def place(item) -> str | None:
        return next((text_of(e) for e in elements(item) if PLACE_CLASS in (e.attrs.get("class") or "").split()), None)

    def parse(source: str) -> list[tuple]:
        out = []
        for name, selector in selectors.items():
            tag, _, wanted = selector.partition(".")
            one = next((e for e in elements(source, tag or None) if not wanted or wanted in (e.attrs.get("class") or "").split()), None)
            out.append(None if one is None else inner_html(one) if name.endswith("_html") else text_of(one) or None)
        aside = next(iter(elements(source, "aside")), None)
        items = list(elements(aside, "li")) if aside else []
        return [(*out, [text_of(e) for e in items], [place(e) for e in items])]

    return _pages_to_rows(pages, key, html, {**dict.fromkeys(selectors, "string"), "items": "array<string>", "places": "array<string>"}, parse)


def sidebar(items: Column, places: Column) -> Column:
    """struct<location, remote, experience, salary> from list items and the places in them; null or false without any.

    Each item goes to the first kind that fits: one with a place, then remote work, experience, an amount. The last of a
    kind stays.
    """
    other = F.transform(F.filter(F.arrays_zip(items.alias("text"), places.alias("place")), lambda i: i["place"].isNull()), lambda i: i["text"])
    has = lambda x, mark: F.contains(F.lower(x), F.lit(mark))
    last = lambda values, when: F.try_element_at(F.filter(values, when), F.lit(-1))
    plain = F.filter(other, lambda x: ~has(x, REMOTE_MARK))
    return F.struct(
        last(places, lambda p: p.isNotNull()).alias("location"),
        F.exists(other, lambda x: has(x, REMOTE_MARK)).alias("remote"),
        last(plain, lambda x: has(x, EXPERIENCE_MARK)).alias("experience"),
        last(plain, lambda x: ~has(x, EXPERIENCE_MARK) & F.rlike(x, F.lit(CURRENCY_SIGNS))).alias("salary"),
    )


def normalized(parsed: DataFrame, source: str, split_places: bool = True) -> DataFrame:
    """One schema from (external_id, url, title, listing_title, company, description, listing_description, location, experience, salary, remote) of a source.

    An empty title or description falls back to that of the listing; a blank line of places gives none. A
    source that names one place a posting doesn't have it split at commas. All postings count as full time.
    """
    one = F.filter(F.array(F.trim("location")), lambda p: F.coalesce(p, F.lit("")) != "")
    full = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.col(b))
    title = full("title", "listing_title")
    return parsed.select(
        F.lit(source).alias("source"), "external_id", "url", title.alias("title"), F.trim("company").alias("company"),
        full("description", "listing_description").alias("description"),
        F.coalesce("remote", F.lit(False)).alias("remote"), (cities(F.col("location")) if split_places else one).alias("places"),
        salary(F.col("salary")).alias("salary"), seniority(title).alias("seniority"), experience_years(F.col("experience")).alias("years"), F.lit("full_time").alias("employment_type"),
    )


def all_sources(registry: dict[str, Callable[[DataFrame], DataFrame]], landed: dict[str, DataFrame]) -> DataFrame:
    """The union of what each source's normalizer makes of its landed rows. Another source is another entry."""
    missing = set(landed) - set(registry)
    if missing:
        raise ValueError(f"no normalizer for {sorted(missing)}")
    return reduce(DataFrame.unionByName, (registry[name](df) for name, df in landed.items()))


def unknown(listings: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Listings that aren't stored yet, before any work on their details."""
    return listings.join(known.select(*keys), keys, "left_anti")


def capped(listings: DataFrame, known: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """What an ingest takes up: of the first `cap` listings of each source those not stored yet. The cap counts listings, known or not."""
    nth = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))
    first = listings.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")
    return unknown(first, known, keys)


def isolated(df: DataFrame, keys: list[str], column: str, parse: Callable[[str | None], dict], schema: str) -> DataFrame:
    """keys, the columns of schema and `error`: what parse makes of each row's text, or what it failed with; a bad row stops no other."""
    kinds = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(schema).fields, T.StructField("error", T.StringType())])
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part[column]:
                try:
                    made = parse(text)
                    out.append((*(made.get(n) for n in names), None))
                except Exception as failed:  # whatever a source's parser raises concerns this row alone
                    out.append((*[None] * len(names), f"{type(failed).__name__}: {failed}"[:500]))
            made = pd.DataFrame(out, columns=[*names, "error"], dtype=object)
            yield pd.concat([part[keys].reset_index(drop=True), made], axis=1)

    return df.select(*keys, column).mapInPandas(run, kinds)


def ingest(listings: DataFrame, known: DataFrame, keys: list[str], cap: int, column: str, parse: Callable[[str | None], dict], schema: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(parsed rows of `isolated`, (source, seen, new, errors) of the run): capped, known ones skipped, bad ones kept apart.

    seen counts the listings within the cap, known or not; new those parsed; errors those that couldn't be. The rows are
    written once, so both results come from one parse.
    """
    nth = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))
    first = listings.withColumn("nth_", nth).where(F.col("nth_") <= cap).drop("nth_")
    rows = written(isolated(unknown(first, known, keys), keys, column, parse, schema), "ingested")
    done = rows.groupBy(keys[0]).agg(F.count_if(F.col("error").isNull()).alias("new"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    seen = first.groupBy(keys[0]).agg(F.count("*").alias("seen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows, seen.join(done, keys[0], "left").select(F.col(keys[0]).alias("source"), "seen", zero("new"), zero("errors"))
