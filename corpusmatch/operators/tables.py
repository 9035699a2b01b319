"""Relational operators: latest per key, keyed upserts, anti-joins, constraint reports, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; `row_number` = 1 lets Spark cut groups before the shuffle."""
    nth = free_name(df.columns, "_nth")
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) == 1).drop(nth)


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in the given order, with `rank` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key, one row a key; columns in `keep` stay as first set.

    Of several new rows of a key the last in `order` counts (columns of new; then the greatest by its other columns, so the
    result never depends on partitions), and a kept column takes the first value that isn't null. A null key on either side
    has no row to replace: the job fails and says so.
    """
    loud = lambda k: F.coalesce(k, F.raise_error(F.lit(f"upsert: null in key {k}")).cast(old.schema[k].dataType)).alias(k)
    values = [c for c in old.columns if c not in keys]
    age = lambda df, which: F.struct(F.lit(which).alias("which"), *(F.col(c) if which and c in df.columns else F.lit(None).cast(new.schema[c].dataType) for c in order), *(F.col(c) for c in values))
    name = free_name(old.columns, "age")
    both = None
    for df, which in ((old, 0), (new, 1)):
        one = df.select(*(loud(k) for k in keys), *values, age(df, which).cast(age_type(old, new, order, values)).alias(name))
        both = one if both is None else both.unionByName(one)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(name))).alias(c)
    last = lambda c: F.max_by(c, name).alias(c)
    return both.groupBy(*keys).agg(*(first(c) if c in keep else last(c) for c in values), F.lit(1).alias(name)).select(*old.columns)


def age_type(old: DataFrame, new: DataFrame, order: tuple[str, ...], values: list[str]) -> T.StructType:
    """Type of what `upsert` orders rows by."""
    fields = [("which", T.IntegerType()), *((f"by{k}", new.schema[c].dataType) for k, c in enumerate(order)), *((f"v{k}", old.schema[c].dataType) for k, c in enumerate(values))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def free_name(columns: list[str], wish: str) -> str:
    """`wish`, or the same with underscores after it if a column has that name, whatever its capitals."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of each key that new has come from new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, checked, violations): a rule is violated where it is false; null passes, as in SQL."""
    counts = df.agg(F.count("*").alias("checked"), *(F.count_if(~c).alias(name) for name, c in rules.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("r")
    return counts.select("checked", each).select("r.rule", "checked", "r.violations")


def purge_counts(parents: DataFrame, children: DataFrame, key: str, seen: str, cutoff: Column) -> DataFrame:
    """What a retention run would delete: parents last seen before the cutoff, and their children."""
    gone = parents.groupBy(key).agg(F.max(seen).alias("seen")).where(F.col("seen") < cutoff).select(key)
    rows = lambda df, name: df.join(gone, key, "left_semi").agg(F.lit(name).alias("entity"), F.count("*").alias("purged"))
    return gone.agg(F.lit("keys").alias("entity"), F.count("*").alias("purged")).unionByName(rows(parents, "parents")).unionByName(rows(children, "children"))


def insert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(offered, added): how many rows `insert_absent` would get and keep."""
    added = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(F.lit(1).alias("added"))
    return new.select(F.lit(0).alias("added")).unionByName(added.select(F.lit(1).alias("added"))).agg(F.count_if(F.col("added") == 0).alias("offered"), F.count_if(F.col("added") == 1).alias("added"))


def recent(df: DataFrame, *order: Column, limit: int = 20) -> DataFrame:
    """The first rows in order; the limit is held within 1 and 100."""
    return df.orderBy(*order).limit(min(max(limit, 1), 100))


def repoint(pairs: DataFrame, owner: str, old: int | str, new: int | str, key: str) -> DataFrame:
    """pairs with those of `old` handed to `new`, but for keys that `new` has already, which stay."""
    taken = pairs.where(F.col(owner) == new).select(key).distinct().withColumn("taken", F.lit(True))
    moved = (F.col(owner) == old) & F.col("taken").isNull()
    out = pairs.join(taken, key, "left").withColumn(owner, F.when(moved, F.lit(new)).otherwise(F.col(owner)))
    return out.select(*pairs.columns)


def owned(df: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests that name a row of df, requests refused), for deletes that only owners may make."""
    rows = df.select(*keys)  # repeated rows change neither join, so no task keeps all keys to tell them apart
    return requests.join(rows, keys, "left_semi"), requests.join(rows, keys, "left_anti")


def judgements(pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs after the last decision on each, decisions refused).

    pairs: (pair_id, candidate, label, annotator, annotated_at); decisions: (pair_id, candidate, label, annotator, at). A
    null label clears label, annotator and time together. Decisions on pairs of another candidate are refused.
    """
    keys = ["pair_id", "candidate"]
    last = decisions.groupBy(*keys).agg(F.max_by(F.struct("label", "annotator", "at"), "at").alias("d"))
    set_ = F.col("d.label").isNotNull()
    pick = lambda new, old: F.when(F.col("d").isNull(), F.col(old)).when(set_, F.col(new)).alias(old)
    judged = pairs.join(last, keys, "left").select(*keys, pick("d.label", "label"), pick("d.annotator", "annotator"), pick("d.at", "annotated_at"))
    return judged, decisions.join(pairs.select(*keys), keys, "left_anti")


def activate(versions: DataFrame, namespace: str, version: str, concepts: int) -> DataFrame:
    """versions (namespace, version, status, concepts, error) after an import of `version` was counted.

    If the stored count is the one found it becomes active and the active one before it superseded; otherwise it fails
    and says so, and the active one stays. Other namespaces stay.
    """
    own = (F.col("namespace") == namespace) & (F.col("version") == version)
    right = versions.where(own & (F.col("concepts") == concepts)).limit(1).count() == 1
    if not right:
        said = F.concat(F.lit(f"found {concepts} concepts, expected "), F.col("concepts").cast("string"))
        return versions.withColumns({"status": F.when(own, "failed").otherwise(F.col("status")), "error": F.when(own, said).otherwise(F.col("error"))})
    status = F.when(own, "active").when((F.col("namespace") == namespace) & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return versions.withColumns({"status": status, "error": F.when(own, None).otherwise(F.col("error"))})


def run_metrics(run: Column, step: str, counts: dict[str, Column]) -> Column:
    """array of (run, step, metric, value), to be exploded and appended to the log of a run."""
    return F.array(*(F.struct(run.alias("run"), F.lit(step).alias("step"), F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in counts.items()))


def with_newest(owners: DataFrame, rows: DataFrame, key: str, columns: list[str], *order: Column) -> DataFrame:
    """owners with `columns` of the newest of their rows; null without any."""
    return owners.join(latest_per_key(rows, [key], *order).select(key, *columns), key, "left")


def status_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the rows of each table, and `blockers`, the names of the empty ones."""
    each = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("name")) for n, df in tables.items()))
    counts = each.agg(*(F.count_if(F.col("name") == n).alias(n) for n in tables))
    return counts.withColumn("blockers", F.array_compact(F.array(*(F.when(F.col(n) == 0, F.lit(n)) for n in tables))))


def missing_categories(history: DataFrame, categories: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """keys and the last time of each category; null for those that never ran."""
    last = history.groupBy(*keys).agg(F.max(seen).alias("last"))
    return categories.select(*keys).distinct().join(last, keys, "left")


def resolved_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (a, b) whose ends are both known; the others are left out."""
    return edges.join(sources.select("a").distinct(), "a", "left_semi").join(targets.select("b").distinct(), "b", "left_semi").select("a", "b").distinct()


def reset_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(entity, rows): what a reset of a scope would delete from each table, by the condition given for it; 0 for none."""
    each = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("entity"), F.coalesce(c, F.lit(False)).alias("gone")) for n, (df, c) in tables.items()))
    found = each.groupBy("entity").agg(F.count_if("gone").alias("rows"))
    # A table without rows has a line, too.
    names = F.explode(F.array(*map(F.lit, tables))).alias("entity")
    return each.sparkSession.range(1).select(names).join(found, "entity", "left").select("entity", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def generation_counts(concepts: DataFrame) -> DataFrame:
    """(namespace, version, concepts, active) of concepts (namespace, version, active)."""
    return concepts.groupBy("namespace", "version").agg(F.count("*").alias("concepts"), F.count_if("active").alias("active"))


def resolved_owners(events: DataFrame, integrations: DataFrame, chat: str, user: str) -> DataFrame:
    """events with the user of their chat; null for an unknown chat, the smallest if several have it.

    Spark broadcasts the integrations while they are below its limit, and sorts both sides beyond it.
    """
    return events.join(integrations.where(F.col(chat).isNotNull()).groupBy(chat).agg(F.min(user).alias(user)), chat, "left")


def posting_details(postings: DataFrame, matches: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """postings with their match (null without one) and `members`, how many source records stand behind each."""
    counts = members.groupBy(key).agg(F.count("*").alias("members"))
    return postings.join(matches, key, "left").join(counts, key, "left").withColumn("members", F.coalesce("members", F.lit(0)).cast("long"))


def edge_report(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(kept, unknown_source, unknown_target, unknown_both): what `resolved_edges` does with the distinct (a, b)."""
    known = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"has_{c}", F.lit(True))
    both = edges.select("a", "b").distinct().join(known(sources, "a"), "a", "left").join(known(targets, "b"), "b", "left")
    a, b = F.col("has_a").isNotNull(), F.col("has_b").isNotNull()
    return both.agg(F.count_if(a & b).alias("kept"), F.count_if(~a & b).alias("unknown_source"), F.count_if(a & ~b).alias("unknown_target"), F.count_if(~a & ~b).alias("unknown_both"))


def run_history(log: DataFrame) -> DataFrame:
    """(run, status, started_at, finished_at, steps, seen, errors, error), one row a run, of log (run, at, kind, step, seen, errors, error).

    A run starts, takes steps and finishes, each a row that is only ever appended. It is running until it finishes, and
    failed if it says with what error; a second finish of a run (a job run again) counts like the last one. A run whose
    start was lost starts at its first row.
    """
    is_ = lambda k: F.col("kind") == k
    steps = F.array_sort(F.collect_list(F.when(is_("step"), F.struct("at", "step"))))
    out = log.groupBy("run").agg(
        F.coalesce(F.min(F.when(is_("start"), F.col("at"))), F.min("at")).alias("started_at"), F.max(F.when(is_("finish"), F.col("at"))).alias("finished_at"),
        F.transform(steps, lambda s: s["step"]).alias("steps"), F.coalesce(F.sum(F.when(is_("step"), F.col("seen"))), F.lit(0)).alias("seen"), F.coalesce(F.sum(F.when(is_("step"), F.col("errors"))), F.lit(0)).alias("errors"),
        F.max_by(F.struct("error"), F.when(is_("finish"), F.col("at"))).alias("end"),
    )
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("end.error").isNotNull(), "failed").otherwise("succeeded")
    return out.select("run", status.alias("status"), "started_at", "finished_at", "steps", "seen", "errors", F.col("end.error").alias("error"))


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(a page of df in order, (total) of all rows); the limit is held within 1 and 200."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 200)), df.agg(F.count("*").alias("total"))


def next_category(categories: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, category, last): of each source's (source, category, position) the one that never ran, first by position, or else ran longest ago.

    runs: (source, category, at).
    """
    last = runs.groupBy("source", "category").agg(F.max("at").alias("last"))
    both = categories.join(last, ["source", "category"], "left")
    return latest_per_key(both, ["source"], F.asc_nulls_first("last"), F.asc("position"), F.asc("category")).select("source", "category", "last")


def import_release(versions: DataFrame, namespace: str, version: str, language: str, expected: int, found: int | None, activate_: bool = False) -> tuple[DataFrame, str]:
    """(versions after the import of a release's language, what it came to) of (namespace, version, languages, status, concepts, error).

    Called before the write with `found` null, it notes the version as importing; after it, with what was counted in the
    written rows, as ready, or active (then the active one is superseded), or failed with both numbers, which stays to be
    seen. A language that a finished version has is `unchanged`, another one is `merged` into it; the table stays one row a version.
    """
    own = (F.col("namespace") == namespace) & (F.col("version") == version)
    row = versions.where(own).first()
    if row is not None and row.status in ("ready", "active"):
        if language in row.languages:
            return versions, "unchanged"
        if found is None or found != expected:
            return versions, "importing" if found is None else "failed"
        return versions.withColumn("languages", F.when(own, F.array_sort(F.array_union("languages", F.array(F.lit(language))))).otherwise(F.col("languages"))), "merged"
    status = "importing" if found is None else "failed" if found != expected else "active" if activate_ else "ready"
    error = f"found {found} concepts, expected {expected}" if status == "failed" else None
    made = versions.sparkSession.createDataFrame([(namespace, version, [language], status, found, error)], "namespace string, version string, languages array<string>, status string, concepts long, error string")
    rest = versions.where(~own)
    if status == "active":
        before = (F.col("namespace") == namespace) & (F.col("status") == "active")
        rest = rest.withColumn("status", F.when(before, "superseded").otherwise(F.col("status")))
    return rest.unionByName(made.select(*versions.columns)), status


#: Rules of stored rows, by table: a rule is broken where it is false.
def mention_rules() -> dict[str, Column]:
    """A linked mention has its concept, an ambiguous one several, and confidences lie within 0 and 1."""
    return {
        "linked has a concept": (F.col("status") != "linked") | F.col("concept_id").isNotNull(), "others have none": (F.col("status") == "linked") | F.col("concept_id").isNull(),
        "confidence": F.col("confidence").between(0, 1), "places": (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")),
    }


def revision_rules() -> dict[str, Column]:
    """Exactly one owner, of the kind that the row names."""
    job, user = F.col("source_record_id").isNotNull(), F.col("user_id").isNotNull()
    return {"exactly one owner": job != user, "kind matches owner": F.when(F.col("entity_kind") == "job", job).when(F.col("entity_kind") == "candidate", user).otherwise(False)}


def judgement_rules() -> dict[str, Column]:
    """Labels from 0 to 3, and a time exactly where there is a label."""
    return {"label range": F.col("label").between(0, 3), "label iff annotated": F.col("label").isNotNull() == F.col("annotated_at").isNotNull()}


def profile_rules() -> dict[str, Column]:
    """A profile by a model names it, others don't."""
    neural = F.col("origin") == "neural_extraction"
    return {"origin names its model": ~neural | F.col("extractor_model_id").isNotNull(), "others name none": neural | F.col("extractor_model_id").isNull()}
