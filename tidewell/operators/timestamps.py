"""Normalised instants and dates of raw feed strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.times import iso_instant, to_utc_micros, to_written_day
from tidewell.operators.bounded import join_bounded


def normalised_times(rows: DataFrame, feeds: DataFrame, *, table_name: str, record_id: str,
                     instants: list[str], dates: list[str], feed: str = "feed") -> DataFrame:
    """(table_name, record_id, field_name, norm_value): one row for each readable value.

    ``instants`` become UTC instants in microseconds, ``dates`` the day as
    written.  The feed's ``tz_name`` and ``date_order`` settle what a string
    leaves open; a row without a known feed is read as UTC and year first.
    Resent records count once; nulls, blanks, placeholders and impossible
    values give no row.
    """
    zones = feeds.groupBy(F.col("feed").alias("__feed")).agg(F.max("tz_name").alias("__zone"), F.max("date_order").alias("__order"))
    raw = rows.select(
        F.col(record_id).cast("long").alias("record_id"), F.col(feed).alias("__feed"),
        *[F.col(c).cast("string").alias(f"__v{i}") for i, c in enumerate([*instants, *dates])],
    )
    known = join_bounded(raw, zones, "__feed")
    found = []
    for i, name in enumerate([*instants, *dates]):
        value, order = F.col(f"__v{i}"), F.col("__order")
        norm = iso_instant(to_utc_micros(value, F.col("__zone"), order)) if name in instants else to_written_day(value, order).cast("string")
        found.append(F.struct(F.lit(name).alias("field_name"), norm.alias("norm_value")))
    return (
        known.where("record_id is not null")
        .select("record_id", F.explode(F.array(*found)).alias("f"))
        .select(F.lit(table_name).alias("table_name"), "record_id", "f.*")
        .where("norm_value is not null").distinct()
    )
