"""The matching pass on a timer: each trigger takes in changed users and postings and passes over what they can change.

State is kept as logs in the shared folder: a trigger writes only rows of what changed, under its own number, and a
trigger that is run again overwrites just these. The newest number of a key counts. Every 16th trigger writes its logs whole, so no
read goes over more than 16 of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmatch.operators.matching import MatchConfig, token_overlap
from corpusmatch.operators.passes import COLUMNS, POSTING, USER, decided, nearest, retrieved

#: A change: what it is of, its order, and the columns of users and postings; those of the other kind are null.
CHANGE = f"kind string, seq long, {USER}, {', '.join(c for c in POSTING.split(', ') if not c.startswith('vector'))}"
_WHOLE = 16


def changes_of(users: DataFrame, postings: DataFrame, seq: int) -> DataFrame:
    """Users and postings as rows of CHANGE."""
    names = [c.split()[0] for c in CHANGE.split(", ")]
    both = users.withColumn("kind", F.lit("user")).unionByName(postings.withColumn("kind", F.lit("posting")), allowMissingColumns=True)
    return both.withColumn("seq", F.lit(seq).cast("long")).select(*names)


class _Log:
    """Rows of `key`, which may have several; a key whose only row is a mark (`gone`) has none."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder, key, f"{schema}, gone boolean, v int"

    def before(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.schema).drop("gone", "v")
        first = _WHOLE * ((number - 1) // _WHOLE)
        paths = [f"{self.folder}/v={v}" for v in range(first, number)]
        rows = self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*paths)
        newest = F.max("v").over(Window.partitionBy(self.key))
        return rows.withColumn("newest", newest).where("v = newest and not gone").drop("gone", "v", "newest")

    def last(self) -> int:
        """The number written last, -1 before the first."""
        try:
            found = self.spark.read.schema(self.schema).parquet(self.folder).agg(F.max("v")).first()[0]
        except AnalysisException:  # no such folder yet
            return -1
        return -1 if found is None else found

    def write(self, number: int, keys: DataFrame, rows: DataFrame) -> None:
        """The rows of `keys` are now `rows`; of all keys, if this number's log is a whole one."""
        if number and number % _WHOLE == 0:
            old = self.before(number)
            rows, keys = old.join(keys, self.key, "left_anti").unionByName(rows), old.select(self.key).unionByName(keys).distinct()
        empty = keys.join(rows.select(self.key).distinct(), self.key, "left_anti")
        marks = empty.select(*(F.col(c) if c == self.key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns), F.lit(True).alias("gone"))
        rows.withColumn("gone", F.lit(False)).unionByName(marks).write.mode("overwrite").parquet(f"{self.folder}/v={number}")


_MATCH = "user_id long, item_id long, similarity double, eligible boolean, reasons array<string>, model string, query_hash string, doc_hash string, relevance double, score double, rerank_position int, recommendation string"


def stream_matching(changes: DataFrame, folder: str, config: MatchConfig, scorer: Callable[[Column, Column], Column] = token_overlap, timer: str | None = None) -> DataFrame:
    """COLUMNS of all users after the changes (CHANGE) that are there; the rows `whole_pass` gives over the newest state.

    A trigger passes whole over users that changed and users one of whose retrieved postings did. For all others only
    the changed postings can come in: these are compared, and only users whose nearest postings change are decided
    anew. folder keeps the state and what was read, so a later call goes on from there; `timer` is a processing time for
    a job that goes on, null reads what is there and ends.
    """
    spark = changes.sparkSession
    users_log, postings_log = _Log(spark, f"{folder}/users", "user_id", USER), _Log(spark, f"{folder}/postings", "item_id", POSTING)
    matches_log, done = _Log(spark, f"{folder}/matches", "user_id", _MATCH), []

    def newest(batch: DataFrame, kind: str, key: str, schema: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        own = batch.where((F.col("kind") == kind) & F.col(key).isNotNull()).withColumn("nth", nth).where("nth = 1")
        return own.select(*(c.split()[0] for c in schema.split(", ")))

    def again(name: str, number: int, df: DataFrame) -> DataFrame:
        """df written under the trigger's number, so what is used several times is computed once."""
        df.write.mode("overwrite").parquet(f"{folder}/step/{number}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/step/{number}/{name}")

    def step(batch: DataFrame, number: int) -> None:
        for log, kind, schema in ((users_log, "user", USER), (postings_log, "posting", POSTING)):
            rows = newest(batch, kind, log.key, schema)
            log.write(number, rows.select(log.key), rows)
        read = lambda log, v: spark.read.schema(log.schema).parquet(f"{log.folder}/v={v}").where("not gone").select(log.key)
        if number and number % _WHOLE == 0:  # these logs hold all rows, so what changed is told by the batch
            new_users, new_items = newest(batch, "user", "user_id", USER).select("user_id"), newest(batch, "posting", "item_id", POSTING).select("item_id")
        else:
            new_users, new_items = read(users_log, number), read(postings_log, number)
        users, postings, old = users_log.before(number + 1), postings_log.before(number + 1), matches_log.before(number)
        hit = old.join(new_items, "item_id", "left_semi").select("user_id")
        whole = new_users.unionByName(hit).distinct()
        others = users.join(whole, "user_id", "left_anti")
        kept = old.join(whole, "user_id", "left_anti").select("user_id", "item_id", "similarity")
        fresh = retrieved(others, postings.join(new_items, "item_id", "left_semi"), config)
        # Of the others only users that a changed posting comes near to.
        came = again("came", number, nearest(kept.unionByName(again("fresh", number, fresh)), config.retrieval_limit))
        moved = came.join(new_items, "item_id", "left_semi").select("user_id").distinct()
        found = again("whole", number, retrieved(users.join(whole, "user_id", "left_semi"), postings, config)).unionByName(came.join(moved, "user_id", "left_semi"))
        stored = old.where("relevance is not null").select("user_id", "item_id", "model", "query_hash", "doc_hash", "relevance")
        matches_log.write(number, whole.unionByName(moved).distinct(), decided(found, users, postings, stored, config, scorer))
        done.append(number)

    job = changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
    query = (job.trigger(processingTime=timer) if timer else job.trigger(availableNow=True)).start()
    query.awaitTermination()
    return matches_log.before((max(done) if done else matches_log.last()) + 1).select(*COLUMNS)
