"""Summaries kept as day states, refreshed from the days whose files changed (SRC3, ALL3).

The facts lie under ``<data>/day=<day>/``. The store under ``<state>`` has states of days
(``generations/generation=<g>``) and a log (``days``) with a row per recomputed day: generation and
a fingerprint of the day's files (paths, lengths, modification times). A refresh finds the days
whose fingerprint isn't the log's, reads only their folders, writes their states as a new
generation, and appends the generation to the log as one file: that is the commit. States count
only for a day's last committed generation, so a run that dies leaves nothing visible, and a
retry overwrites what it left. One refresh runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_DAYS = 32
LOG = "generation long, day string, print string"


def fingerprints(spark: SparkSession, data: str) -> DataFrame:
    """(day, print) of the data folder, from file listings only; none for a missing folder."""
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
                 .load(data).select("path", "length", "modificationTime"))
    except AnalysisException:
        return spark.createDataFrame([], "day string, print string")
    h = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return files.groupBy(F.regexp_extract("path", "/day=([^/]+)/", 1).alias("day")).agg(
        F.concat_ws(":", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).alias("print"))


def committed(spark: SparkSession, state: str) -> DataFrame:
    """(day, generation, print): each day's last committed generation."""
    try:
        log = spark.read.schema(LOG).parquet(f"{state}/days")
    except AnalysisException:
        log = spark.createDataFrame([], LOG)
    return log.groupBy("day").agg(F.max(F.struct("generation", "print")).alias("x")).select("day", "x.*")


def stale_days(spark: SparkSession, data: str, state: str) -> DataFrame:
    """(day, print) of the days whose files changed, came or went (print: null) since the last refresh."""
    known = committed(spark, state).select("day", F.col("print").alias("was"))
    both = fingerprints(spark, data).join(known, "day", "full_outer")
    return both.where(~F.col("print").eqNullSafe(F.col("was"))).select("day", "print")


def refresh(spark: SparkSession, data: str, state: str, partial: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Recompute the stale days; returns them. ``partial`` maps facts (with ``day``) to states with a ``day`` column."""
    stale = {r["day"]: r["print"] for r in stale_days(spark, data, state).collect()}   # a row per changed day
    if not stale:
        return []
    generation = 1 + (committed(spark, state).agg(F.max("generation")).first()[0] or 0)
    present = [d for d, p in sorted(stale.items()) if p is not None]
    if present:
        reader = spark.read.option("basePath", data)
        if len(present) <= FEW_DAYS:   # only their folders are listed
            facts = reader.parquet(*[f"{data}/day={d}" for d in present])
        else:
            facts = reader.parquet(data).where(F.col("day").cast("string").isin(present))
        partial(facts.withColumn("day", F.col("day").cast("string"))).write.mode("overwrite").parquet(f"{state}/generations/generation={generation}")
    rows = [(generation, d, p) for d, p in sorted(stale.items())]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{state}/days")
    return sorted(stale)


def day_states(spark: SparkSession, state: str) -> DataFrame | None:
    """The valid states of all days; None before the first refresh."""
    valid = committed(spark, state).where("print IS NOT NULL")
    used = [r.generation for r in valid.select("generation").distinct().collect()]
    if not used:
        return None
    states = spark.read.option("basePath", f"{state}/generations").parquet(*[f"{state}/generations/generation={g}" for g in sorted(used)])
    days = valid.select("day", F.col("generation").alias("g"))
    return states.join(F.broadcast(days), (states["day"] == days["day"]) & (F.col("generation") == F.col("g"))).drop(days["day"]).drop("g", "generation")
