"""Verdicts of equal texts, made once: within a frame, and across calls for as long as they are kept."""

from __future__ import annotations

import warnings
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .scan import ScanPlan
from .verdict import for_cache


def cache_key(plan: ScanPlan, text: Column, prefix: str = "verdict") -> Column:
    """Tells direction, policy (by what it does, not by its name alone) and text apart."""
    return F.concat_ws(":", F.lit(prefix), F.lit(plan.policy.name), F.lit(plan.policy.fingerprint()), F.lit(plan.direction), F.md5(text))


def _free(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _once(df: DataFrame, text: str) -> DataFrame:
    """(digest, text) of each different text: rows of one digest collapse map-side before anything is shuffled."""
    given = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return given.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))


def scan_distinct(plan: ScanPlan, df: DataFrame, text: str = "text") -> DataFrame:
    """apply() with each different text scanned once and joined back; every row keeps its own verdict, for its own audit.

    The way back is a join by digest, which AQE splits where one text is very common.
    """
    name = _free(df, "digest")
    made = plan.apply(_once(df, text)).select(F.col("digest").alias(name), "verdict", "verdict_signals")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("verdict", "verdict_signals")]
    return df.select(*keep, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias(name)).join(made, name).drop(name)


def cached_rows(plan: ScanPlan, df: DataFrame, text: str = "text") -> DataFrame:
    """(key, verdict) as they may be kept."""
    made = plan.apply(_once(df, text))
    return made.select(cache_key(plan, F.col("text")).alias("key"), for_cache(F.col("verdict")).alias("verdict"))


class VerdictStore:
    """Verdicts in a folder of Parquet files, each good for `seconds` from when it was made.

    Verdicts that minted a vault are never kept, and none are looked up where the caller brings one.
    """

    def __init__(self, path: str, seconds: int = fixed.CACHE_SECONDS, prefix: str = "verdict") -> None:
        self.path, self.seconds, self.prefix = path, seconds, prefix

    def rows(self, spark: SparkSession, now: datetime) -> DataFrame | None:
        """(key, verdict, verdict_signals, made) of what is still good, the latest of each key; None where nothing was ever kept."""
        try:
            kept = spark.read.parquet(self.path)
        except AnalysisException:
            return None
        age = F.lit(now).cast("timestamp").cast("double") - F.col("made").cast("double")
        good = kept.filter((age >= 0) & (age < self.seconds))
        latest = good.groupBy("key").agg(F.max("made").alias("made"))
        return good.join(latest, ["key", "made"]).dropDuplicates(["key"])

    def scan(self, plan: ScanPlan, df: DataFrame, text: str = "text", now: datetime | None = None) -> DataFrame:
        """The frame with verdict, verdict_signals and cache_hit: texts whose verdict is kept aren't scanned again.

        A hit carries the verdict as it was kept, without original text or contexts. Every row, hit or not, has its
        verdict, so that all of them can be audited. The new verdicts are written before this returns.
        """
        spark, now = df.sparkSession, now or datetime.now()
        name = _free(df, "key")
        keyed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("verdict", "verdict_signals", "cache_hit")]).withColumn(name, cache_key(plan, F.coalesce(F.col(f"`{text}`"), F.lit("")), self.prefix))
        known = self.rows(spark, now)
        asked = keyed.select(F.col(name).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        misses = asked if known is None else asked.join(known.select("key"), "key", "left_anti")
        made = plan.apply(misses)
        stored = made.withColumn("made", F.lit(now).cast("timestamp")).select("key", for_cache(F.col("verdict")).alias("verdict"), "verdict_signals", "made", F.size("verdict.vault").alias("minted"))
        stored.filter("minted = 0").drop("minted").write.mode("append").parquet(self.path)
        fresh = made.select(F.col("key").alias(name), "verdict", "verdict_signals", F.lit(False).alias("cache_hit"))
        if known is None:
            return keyed.join(fresh, name).drop(name)
        hits = known.select(F.col("key").alias(name), "verdict", "verdict_signals", F.lit(True).alias("cache_hit"))
        return keyed.join(fresh.unionByName(hits), name).drop(name)

    def compact(self, spark: SparkSession, into: str, now: datetime | None = None) -> VerdictStore:
        """A store at another path with what is still good; the old folder can then go."""
        kept = self.rows(spark, now or datetime.now())
        if kept is None:
            warnings.warn(f"nothing is kept at {self.path}", stacklevel=2)
        else:
            kept.write.mode("append").parquet(into)
        return VerdictStore(into, self.seconds, self.prefix)


def hit_rate(scanned: DataFrame) -> DataFrame:
    """(n, hits, rate) of what VerdictStore.scan returned."""
    hit = F.col("cache_hit").cast("int")
    return scanned.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("hits"), F.round(F.avg(hit), 6).alias("rate"))
