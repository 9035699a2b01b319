"""Edges between rows: ancestors of a hierarchy, and what a deletion takes along over a chain of foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.operators.storage import written


def ancestors(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, ancestor, distance) of edges (child, parent): the least number of steps up to each ancestor.

    Reach doubles with every round, so a hierarchy of depth d takes log2 d rounds. A shortest path longer than the reach has
    one middle at just that distance, from which the rest is known: of all pairs only those meet others that lie as far apart as
    the reach, every pair is found through few middles and written once. In a cycle every member is an ancestor of the others,
    and none of itself; edges with a null end and loops are passed over. Without a pair as far apart as the reach all are found.
    """
    own = edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct()
    last = known = written(own, "ancestors")
    for k in range(most_rounds):
        far = last.where(F.col("distance") == 2**k)
        if far.isEmpty():
            return known
        middles = far.select(F.col("ancestor").alias("node")).distinct()
        up = known.join(middles, "node", "left_semi").select(F.col("node").alias("middle"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        further = far.join(up, F.col("ancestor") == F.col("middle")).where("node <> top").select("node", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        further = further.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        last = written(further.join(known, ["node", "ancestor"], "left_anti"), "ancestors")
        known = known.unionByName(last)
    raise RuntimeError("the ancestors did not settle")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that links lead to. Every round a node takes the smallest label around
    it, and then the label of that label, so chains shrink by half at least; a hub's neighbours are never gathered."""
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    now, seen = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        now = now.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "least").alias("component"))
        now = written(now, "labels")
        up = now.select(F.col("node").alias("middle"), F.col("component").alias("top"))
        now = written(now.join(up, F.col("component") == F.col("middle")).select("node", F.least("component", "top").alias("component")), "labels")
    raise RuntimeError("the components did not settle")


@dataclass(frozen=True)
class Table:
    """A table of a cascade and the column that tells its rows apart."""

    rows: DataFrame
    key: str


@dataclass(frozen=True)
class Link:
    """Rows of `child` whose `column` names a parent go when the parent goes."""

    child: str
    column: str
    parent: str


@dataclass(frozen=True)
class Orphan:
    """Rows of `table` that `by`.`column` names go when the last row naming them is gone; rows never named stay."""

    table: str
    by: str
    column: str


def cascade(tables: dict[str, Table], seeds: dict[str, DataFrame], rules: list[Link | Orphan]) -> dict[str, DataFrame]:
    """Keys that go from each table, starting from seeds (the keys, under any name); one column, the table's key, each once.

    Rules are taken in their order, so those about a table come before those that follow from it. Each table's keys are
    written once and only semi-joined with the next, so no level is computed twice. Null keys go nowhere.
    """
    gone = {name: df.toDF("key").where("key is not null").distinct() for name, df in seeds.items()}
    for rule in rules:
        if isinstance(rule, Link):
            child = tables[rule.child]
            lost = child.rows.join(gone[rule.parent].withColumnRenamed("key", rule.column), rule.column, "left_semi")
            name, found = rule.child, lost.select(F.col(child.key).alias("key"))
        else:
            by = tables[rule.by]
            went = gone[rule.by].withColumnRenamed("key", by.key)
            named = by.rows.where(F.col(rule.column).isNotNull()).select(by.key, F.col(rule.column).alias("named"))
            left = named.join(went, by.key, "left_anti").select(F.col("named").alias("key"))
            known = tables[rule.table].rows.select(F.col(tables[rule.table].key).alias("key"))
            name, found = rule.table, named.join(went, by.key, "left_semi").select(F.col("named").alias("key")).join(left, "key", "left_anti").join(known, "key", "left_semi")
        found = found.where("key is not null")
        gone[name] = written((gone[name].unionByName(found) if name in gone else found).distinct(), f"gone-{name}")
    return {name: df.withColumnRenamed("key", tables[name].key) for name, df in gone.items()}


def cascade_counts(gone: dict[str, DataFrame]) -> DataFrame:
    """(entity, rows): how many keys go from each table, 0 for none."""
    spark = next(iter(gone.values())).sparkSession
    each = None
    for name, df in gone.items():
        one = df.select(F.lit(name).alias("entity"))
        each = one if each is None else each.unionByName(one)
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, gone))).alias("entity"))
    return names.join(each.groupBy("entity").agg(F.count("*").alias("rows")), "entity", "left").select("entity", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def survivors(tables: dict[str, Table], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of every table that stay."""
    return {name: t.rows.join(gone[name], t.key, "left_anti") if name in gone else t.rows for name, t in tables.items()}
