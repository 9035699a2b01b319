"""Helpers shared by the training-data operators: shared storage, table access, components."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rule of the contracts for splitting words: everything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`, or an own one where it is unset (tests).

    A folder of this machine serves only where all tasks run on it, so on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusmatch-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back, which cuts the lineage.

    The files live under one folder of the application; `clean_up` removes it.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Remove what `materialize` wrote in this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusmatch-{spark.sparkContext.applicationId}"


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a value's decimal text, modulo n; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, or the same with underscores after it if df has such a column, whatever its capitals."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def least_hashes(cuts: DataFrame, group: str, cut: str, bound: int) -> DataFrame:
    """The `bound` least distinct hashes of each group (or fewer, see below), with `nth`, their place.

    Hashes are spread evenly, so of n distinct ones those under the share (2 * bound + 1000) / n of their range are about
    2 * bound + 1000, and the least `bound` are among them but for chances that don't count. Only these are sorted, so a
    task gets as many of any group, whatever its share of the rows. The number of each group comes to the driver.
    """
    cuts = cuts.select(group, cut).where(F.col(group).isNotNull()).distinct()
    counts = {r[0]: r[1] for r in cuts.groupBy(group).count().collect()}
    shares = {g: min(1.0, (2 * bound + 1000) / n) for g, n in counts.items()}
    limits = [x for g, share in shares.items() for x in (F.lit(g), F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))]
    few = cuts.where(F.col(cut) <= F.try_element_at(F.create_map(*limits), F.col(group))) if limits else cuts
    nth = F.row_number().over(Window.partitionBy(group).orderBy(cut))
    return few.withColumn("nth", nth).where(F.col("nth") <= bound)


def sample_cut(df: DataFrame, ids: Column, bound: int, group: str | None = None) -> DataFrame:
    """At most `bound` rows (of each value of `group`, if there is one), those with the smallest hashes of their ids.

    A bounded, repeatable sample to fit a model on. Rows with equal hashes at the limit all stay. Hashes alone are
    shuffled. The limit of each group, one number, comes to the driver and goes back as a literal, so the rows
    themselves are only filtered.
    """
    cuts = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.xxhash64(ids).alias("cut"))
    limits = {r.g: r.cut for r in least_hashes(cuts, "g", "cut", bound).groupBy("g").agg(F.max("cut").alias("cut")).collect()}
    if not limits:
        return df.where("false")
    if group is None:
        return df.where(F.xxhash64(ids) <= limits[0])
    known = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    return df.where(F.xxhash64(ids) <= F.try_element_at(known, F.col(group)))


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs as (node, component), the component being its smallest node.

    Alternates large-star and small-star rounds, each written to the shared folder, until no edge changes.
    A hub's neighbours are never gathered: every round takes a minimum per node and joins it back.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, label)
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


@dataclass(frozen=True)
class Bitmap:
    """Which hashes a column has, in 2^bits bits whatever their number; it may say yes to others, never no to its own.

    Small enough to broadcast at any size of the corpus. It only spares later joins rows that find no partner.
    Each hash has a bit for each of `probes` parts of it, at most 4, and all have to be there.
    """

    bits: np.ndarray
    probes: int = 1

    @classmethod
    def of(cls, df: DataFrame, hashed: Column, bits: int = 26, probes: int = 1) -> Bitmap:
        place = F.pmod(hashed, F.lit(1 << bits))
        if probes > 1:
            parts = [F.pmod(F.shiftrightunsigned(hashed, 12 * k), F.lit(1 << bits)) for k in range(probes)]
            df, place = df.select(F.explode(F.array(*parts)).alias("place")), F.col("place")
        words = df.select(F.shiftright(place, 5).cast("int").alias("word"), F.expr("1L").alias("one"), (place % 32).cast("int").alias("at"))
        words = words.select("word", F.call_function("shiftleft", "one", "at").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        out = np.zeros(1 << (bits - 5), np.uint32)
        out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
        return cls(out, probes)

    def has(self, hashed: np.ndarray) -> np.ndarray:
        hashed, most = hashed.astype(np.int64), len(self.bits) * 32 - 1
        found = self._bit(hashed & most)
        for k in range(1, self.probes):
            there = np.flatnonzero(found)
            found[there] = self._bit((hashed[there].view(np.uint64) >> np.uint64(12 * k)).view(np.int64) & most)
        return found

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 > 0
