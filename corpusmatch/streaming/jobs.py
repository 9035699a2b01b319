"""Streams over files that end when all is read: revisions, decisions, and relayed events.

Output goes to a new folder in `spark.checkpoint.dir`, which driver and executors share; a batch that is run again
replaces its own files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from corpusmatch.operators.storage import shared_folder

MAX_ATTEMPTS = 10  # fixed value


def _folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"stream-{name}")


def _run(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    job = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/log")
    query = job.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_revisions(stream: DataFrame, owner: str, order: str, content: str) -> DataFrame:
    """`revisions` of a stream: (owner, order, content_hash, revision_no, is_new, reverted).

    Each owner's texts are kept as state (hash -> number), so a batch reads nothing that earlier ones wrote; a task holds
    one owner's rows of a batch. Texts known from earlier batches keep their number. Late rows get numbers as they come
    and never renumber others. A null owner is an owner of its own.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, "revisions")
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    fields = [(owner, kinds[owner]), (order, kinds[order]), ("content_hash", T.StringType()), ("revision_no", T.LongType()), ("is_new", T.BooleanType()), ("reverted", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    state_type = T.StructType([T.StructField("hashes", T.ArrayType(T.StringType()))])
    hashed = stream.select(F.col(owner).alias("owner_"), F.col(order).alias("order_"), F.sha2(F.col(content), 256).alias("hash_"))

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The place of a hash is its number; a null text is a text of its own.
        hashes = list(state.get[0]) if state.exists else []
        known = {h: k + 1 for k, h in enumerate(hashes)}
        rows = pd.concat(list(parts)).sort_values("order_", kind="stable")
        out = []
        for text in rows["hash_"]:
            text = None if pd.isna(text) else text
            is_new = text not in known
            if is_new:
                hashes.append(text)
                known[text] = len(hashes)
            out.append((known[text], is_new, known[text] < len(hashes)))
        state.update((hashes,))
        numbers, new, reverted = zip(*out, strict=True)
        yield pd.DataFrame({owner: rows["owner_"].to_numpy(), order: rows["order_"].to_numpy(), "content_hash": rows["hash_"].to_numpy(), "revision_no": numbers, "is_new": new, "reverted": reverted})

    found = hashed.groupBy("owner_").applyInPandasWithState(number, schema, state_type, "append", "NoTimeout")
    _run(found, folder, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/{n}"), "append")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def decisions(data: Column) -> Column:
    """struct<action, target> from `match:<approve or reject>:<id>`, null for anything else."""
    form = r"^match:(approve|reject):(.*)$"
    return F.when(F.regexp_like(data, F.lit(form)), F.struct(F.regexp_extract(data, form, 1).alias("action"), F.regexp_extract(data, form, 2).alias("target")))


def stream_decisions(stream: DataFrame, user: str, data: str, order: list[str]) -> DataFrame:
    """(user, target, action): the last decision of each user on each target; unknown forms are ignored."""
    folder = _folder(stream.sparkSession, "decisions")
    parsed = stream.select(user, *order, decisions(F.col(data)).alias("d")).where("d is not null")
    last = parsed.groupBy(user, F.col("d.target").alias("target")).agg(F.max_by("d.action", F.struct(*order)).alias("action"))
    _run(last, folder, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows"), "complete")
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def relay(events: DataFrame, kind: str, attempts: Column, errors: dict[str, Column]) -> DataFrame:
    """Events with status and attempts: each kind has a handler, a column that is null or says what failed.

    Kinds without a handler are done as `unhandled`; a failed event counts an attempt and blocks no other; after
    the last allowed attempt it is `dead` and not tried again.
    """
    none = F.lit(None).cast("string")
    error = none
    for name, handler in errors.items():
        error = F.when(F.col(kind) == name, handler.cast("string")).otherwise(error)
    dead, known = attempts >= MAX_ATTEMPTS, F.col(kind).isin(*errors)
    tried = events.withColumn("error", F.when(~dead, F.substring(error, 1, 500)))
    status = F.when(dead, "dead").when(~F.coalesce(known, F.lit(False)), "unhandled").when(F.col("error").isNotNull(), "failed").otherwise("published")
    return tried.withColumn("status", status).withColumn("attempts", (attempts + F.col("error").isNotNull().cast("int")).cast("long"))


def stream_relay(stream: DataFrame, kind: str, attempts: Column, errors: dict[str, Column], key: str) -> DataFrame:
    """`relay` over a stream: every event with its last status and the attempts so far.

    An event that is delivered again, in this batch or a later one, is known by its key in the stream's state and counts
    once. Failed events are carried to the next batch and tried again there, until they succeed or are dead; those that
    failed in the last batch stay failed.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, "relay")
    columns = stream.columns

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("attempts_", attempts.cast("long"))
        if number:
            waiting = spark.read.parquet(f"{folder}/failed/{number - 1}")
            fresh = fresh.unionByName(waiting.select(*columns, F.col("attempts").alias("attempts_")))
        done = relay(fresh, kind, F.col("attempts_"), errors).drop("attempts_")
        done.write.mode("overwrite").partitionBy("status").parquet(f"{folder}/tried/{number}")
        tried = spark.read.schema(done.schema).parquet(f"{folder}/tried/{number}")
        tried.where("status = 'failed'").write.mode("overwrite").parquet(f"{folder}/failed/{number}")
        tried.where("status <> 'failed'").write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        last.append(number)

    last: list[int] = []
    _run(stream.dropDuplicates([key]), folder, write, "append")
    done = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    return done.unionByName(spark.read.parquet(f"{folder}/failed/{max(last)}"))


def purge_published(events: DataFrame, before: Column) -> DataFrame:
    """What is left of events (status, published_at): published ones before the time go, undelivered ones never."""
    return events.where(~F.coalesce((F.col("status") == "published") & (F.col("published_at") < before), F.lit(False)))


def stream_counts(stream: DataFrame, term: str, seen: str) -> DataFrame:
    """(term, occurrences, first_seen, last_seen): running counters of unmapped terms, kept as state."""
    folder = _folder(stream.sparkSession, "counts")
    counts = stream.where(F.col(term).isNotNull()).groupBy(term).agg(F.count("*").alias("occurrences"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))
    _run(counts, folder, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows"), "complete")
    return stream.sparkSession.read.parquet(f"{folder}/rows")
