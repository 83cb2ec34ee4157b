"""Reversible pseudonyms: minting them for a table of values, and restoring them in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import replace_matches


def mint(values: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, type, value, ordinal, placeholder) for rows (key, type, value, start).

    The different values of a type are numbered from 1 by their first place within a key; never across keys.
    """
    first = values.groupBy(key, "type", "value").agg(F.min("start").alias("start"))
    ordinal = F.row_number().over(W.partitionBy(key, "type").orderBy("start", "value"))
    return first.select(key, "type", "value", ordinal.cast("long").alias("ordinal")).withColumn("placeholder", F.format_string("<%s_%d>", "type", "ordinal"))


def as_maps(vault: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, vault) with a placeholder's value in a map."""
    return vault.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("vault"))


def restored(text: Column, vault: Column) -> Column:
    """Placeholders in the vault give way to their values, in one pass: what was restored isn't looked at again."""
    done = replace_matches(text, fixed.PLACEHOLDER, lambda m: F.coalesce(F.try_element_at(vault, m), m))
    return F.when(vault.isNull() | (F.size(vault) == 0), text).otherwise(done)


def restored_spans(text: Column, vault: Column) -> Column:
    """Byte places (start, end) of the restored values in the restored text."""
    kind = "array<struct<start:int,end:int>>"
    pairs = F.filter(
        F.zip_with(F.split(text, fixed.PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(fixed.PLACEHOLDER), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("m"), F.try_element_at(vault, m).alias("value"))),
        lambda x: x["m"].isNotNull(),
    )
    spans = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.octet_length(x["gap"]) + F.octet_length(F.coalesce(x["value"], x["m"]))).alias("at"),
            F.when(x["value"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.octet_length(x["gap"])).alias("start"), (acc["at"] + F.octet_length(x["gap"]) + F.octet_length(x["value"])).alias("end")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(vault.isNull() | (F.size(vault) == 0), F.expr(f"cast(array() as {kind})")).otherwise(spans)
