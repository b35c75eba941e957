"""Interval algebra and sequences: merging, cooldowns, runs, capacities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, *, key: str, start: str, stop: str, label: str) -> DataFrame:
    """(key, start, stop, labels, spans): overlapping or touching closed spans of a key as one."""
    order = Window.partitionBy(key).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.where(F.col(start) <= F.col(stop)).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(key, "__run").agg(
        F.min(start).alias(start), F.max(stop).alias(stop),
        F.array_join(F.array_sort(F.collect_set(label)), "+").alias("labels"), F.count(F.lit(1)).alias("spans"),
    ).drop("__run")


def cooldown(rows: DataFrame, *, key: str, day: str, ident: str, days: int) -> DataFrame:
    """(key, day, ident) of rows at least ``days`` after the last kept row of their key.

    Keeping depends on what was kept before, so each key is walked once in
    order; the walk streams over sorted partitions and holds one day per task.
    """
    rows = rows.select(F.col(key).cast("string").alias("k"), F.unix_date(F.to_date(day)).alias("d"), F.col(ident).cast("long").alias("i")).where("k is not null and d is not null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            take = []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    now, kept = k, None
                ok = kept is None or d - kept >= days
                if ok:
                    kept = d
                take.append(ok)
            yield batch.filter(pa.array(take, pa.bool_()))

    ordered = rows.repartition("k").sortWithinPartitions("k", "d", "i")
    return ordered.mapInArrow(walk, "k string, d int, i long").select(F.col("k").alias(key), F.date_from_unix_date("d").alias(day), F.col("i").alias(ident))


def collapsed_runs(rows: DataFrame, *, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before them."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("__keep", first | ~before.eqNullSafe(F.col(value))).where("__keep").drop("__keep")


def slots(signals: DataFrame, *, lane: str, day: str, ident: str, hold_days: int, capacity: int) -> DataFrame:
    """(lane, ident, taken): first come, first served with ``capacity`` slots that free up after ``hold_days``."""
    rows = signals.select(F.col(lane).cast("string").alias("k"), F.unix_date(F.to_date(day)).alias("d"), F.col(ident).cast("long").alias("i")).where("k is not null and d is not null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, []
        for batch in batches:
            taken = []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    now, ends = k, []
                ends = [e for e in ends if e > d]
                ok = len(ends) < capacity
                if ok:
                    ends.append(d + hold_days)
                taken.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(taken, pa.bool_())], names=["k", "i", "taken"])

    ordered = rows.repartition("k").sortWithinPartitions("k", "d", "i")
    return ordered.mapInArrow(walk, "k string, i long, taken boolean").select(F.col("k").alias(lane), F.col("i").alias(ident), "taken")
