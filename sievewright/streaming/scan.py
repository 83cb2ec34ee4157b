"""Streams: the same plans, and cross-call state with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.records import audited
from ..plans.scan import ScanPlan


def scan_stream(stream: DataFrame, plan: ScanPlan, text: str = "text") -> DataFrame:
    """Verdicts of a stream; there is no state, so any source and output mode will do."""
    return plan.apply(stream, text)


def audit_stream(stream: DataFrame, plan: ScanPlan, text: str = "text") -> DataFrame:
    """Audit records of a stream, for a writer that appends."""
    return audited(scan_stream(stream, plan, text), plan.direction)


def blocked_by_window(scanned: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Scanned and refused texts by window and severity, of rows that come no later than the watermark allows."""
    rows = scanned.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col("verdict.severity").alias("severity"))
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.sum((~F.col("verdict.valid")).cast("long")).alias("blocked"))


def first_seen(stream: DataFrame, key: str, time: str, seconds: int = fixed.CACHE_SECONDS) -> DataFrame:
    """The first row of each key within the time to live: what a verdict cache would have to scan."""
    return stream.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])
