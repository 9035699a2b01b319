"""Document revisions and status histories, from ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def revisions(df: DataFrame, owner: str, order: str, content: str) -> DataFrame:
    """The rows with content_hash, revision_no, is_new and reverted.

    A text new to its owner founds the next revision; one seen before keeps its number, and is a reversal if it
    isn't the newest text at that moment. Numbers follow the first sight of each text.
    """
    by_owner = Window.partitionBy(owner).orderBy(order)
    first = Window.partitionBy(owner, "content_hash").orderBy(order)
    hashed = df.withColumn("content_hash", F.sha2(F.col(content), 256))
    hashed = hashed.withColumn("is_new", F.row_number().over(first) == 1)
    hashed = hashed.withColumn("newest", F.sum(F.col("is_new").cast("int")).over(by_owner.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.first("newest").over(first.rowsBetween(Window.unboundedPreceding, 0))
    hashed = hashed.withColumn("revision_no", number.cast("long"))
    return hashed.withColumn("reverted", ~F.col("is_new") & (F.col("revision_no") < F.col("newest"))).drop("newest")


def transitions(df: DataFrame, owner: str, order: str, status: str, allowed: DataFrame) -> DataFrame:
    """(owner, order, from_status, to_status, legal); the first row of an owner is its birth and legal, whatever it says.

    allowed: (from_status, to_status), a small table of edges. A null status later on is on neither end of an edge.
    """
    by_owner = Window.partitionBy(owner).orderBy(order)
    steps = df.select(owner, order, F.lag(status).over(by_owner).alias("from_status"), F.col(status).alias("to_status"), (F.row_number().over(by_owner) == 1).alias("legal"))
    edges = allowed.select("from_status", "to_status", F.lit(True).alias("edge"))
    joined = steps.join(edges, ["from_status", "to_status"], "left")
    return joined.withColumn("legal", F.col("legal") | F.coalesce("edge", F.lit(False))).drop("edge")


def lifecycle(requests: DataFrame, owner: str, order: str, allowed: dict[str, tuple[str, ...]], birth: str, failed: str = "failed") -> DataFrame:
    """Requests with from_status, legal, status, failure_code and failure_detail as they are after each, and `reason` of the audit row.

    requests: (owner, order, target, code, detail, reason). An owner begins at `birth`. A request that `allowed` (from ->
    targets) doesn't have is refused and changes nothing, so the next one starts from where the owner still is. Only
    going to `failed` sets the failure, with its code and detail; every other move clears both. The reason of a move is the
    one given, or else its code; a refused request has none. Requests of an owner stream through one task in order,
    with one status in memory.
    """
    columns = [owner, order, "target", "code", "detail", "reason"]
    own = requests.select(*columns)
    more = ("from_status", "status", "failure_code", "failure_detail")
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.StringType()) for c in more), T.StructField("legal", T.BooleanType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), (birth, None, None)
        for part in parts:
            out, said = [], []
            for who, target, code, detail, reason in zip(*(part.column(c).to_pylist() for c in (owner, "target", "code", "detail", "reason")), strict=True):
                if who != now:
                    now, state = who, (birth, None, None)
                before, legal = state[0], target in allowed.get(state[0], ())
                if legal:
                    state = (target, code, detail) if target == failed else (target, None, None)
                out.append((before, *state, legal))
                said.append((code if reason is None else reason) if legal else None)
            added = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), [pa.string()] * 4 + [pa.bool_()], strict=True)]
            columns_ = [pa.array(said, pa.string()) if c == "reason" else part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns_, *added], [*columns, *more, "legal"])

    return own.where(F.col(owner).isNotNull()).repartition(owner).sortWithinPartitions(owner, order).mapInArrow(run, schema)


def seed_revisions(owners: DataFrame, owner: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Revision 1 of every owner with the hash of its text, and the transition of its birth."""
    first = owners.select(F.col(owner).alias("owner"), F.lit(1).cast("long").alias("revision_no"), F.sha2(F.col(text), 256).alias("content_hash"), F.lit("received").alias("status"))
    return first, first.select("owner", "revision_no", F.lit(None).cast("string").alias("from_status"), F.col("status").alias("to_status"), F.lit("seeded").alias("reason"))


def unparsed(revisions_: DataFrame, limit: int, *order: str) -> DataFrame:
    """Revisions without parsed text that haven't failed, the oldest first."""
    return revisions_.where("parsed_text is null and status <> 'failed'").orderBy(*order).limit(limit)


def override_profile(profiles: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """profiles (user_id, revision_no, origin, reviewed, competencies) with a new revision for each edit (user_id, competencies), and parent_no.

    It replaces the competencies whole, counts as reviewed, its origin is the user's override, and its parent the revision
    before it. Several edits of a user are numbered one after another, by their column `order` (or else by what they say).
    Edits of users without a profile are passed over. Revisions from elsewhere have no parent here.
    """
    newest = profiles.groupBy("user_id").agg(F.max("revision_no").alias("last"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(order or "competencies"))
    number = F.col("last") + nth
    made = edits.join(newest, "user_id").select(
        "user_id", number.alias("revision_no"), F.lit("user_override").alias("origin"), F.lit(True).alias("reviewed"), "competencies", (number - 1).alias("parent_no")
    )
    old = profiles.withColumn("parent_no", F.lit(None).cast("long"))
    return old.select(*made.columns).unionByName(made)
