"""Where audit records go."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

Sink = Callable[[DataFrame], None]
LEVELS = {"info": logging.INFO, "warning": logging.WARNING}


def null_sink(records: DataFrame) -> None:
    """Nowhere."""
    records.write.format("noop").mode("overwrite").save()


def table_sink(path: str, fmt: str = "parquet") -> Sink:
    """Appended to files, parted by level."""

    def write(records: DataFrame) -> None:
        records.write.mode("append").partitionBy("level").format(fmt).save(path)

    return write


def log_sink(logger: str = "sievewright.audit", set_up: Callable[[], None] | None = None) -> Sink:
    """One JSON line a record, at the record's level, to a logger of the executors' Python processes.

    set_up runs first in each of them, to give the logger its handlers: those of the driver don't reach an executor.
    """

    def tell(rows: Iterator[Row]) -> None:
        if set_up:
            set_up()
        log = logging.getLogger(logger)
        for row in rows:
            log.log(LEVELS.get(row.level, logging.WARNING), "audit %s", row.line)

    def write(records: DataFrame) -> None:
        records.select("level", F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("line")).foreachPartition(tell)

    return write


def each_batch(sink: Sink) -> Callable[[DataFrame, int], None]:
    """A sink for writeStream.foreachBatch."""
    return lambda records, batch: sink(records)


class Sinks:
    """By name; null if auditing is off or names nothing."""

    def __init__(self) -> None:
        self._sinks: dict[str, Sink] = {"null": null_sink, "log": log_sink()}

    def bind(self, name: str, sink: Sink) -> Sinks:
        self._sinks[name] = sink
        return self

    def choose(self, enabled: bool, name: str | None) -> Sink:
        return self._sinks.get(name or "null", null_sink) if enabled else null_sink
