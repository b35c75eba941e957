"""Panels by entity and period: flows, stages, cohorts, availability, attribution, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flows(rows: DataFrame, *, keys: Sequence[str], order: str, delta: str, weight: str, stage: str) -> DataFrame:
    """(keys, gain, n, mean_weight, last_delta, stages): sum of positive changes, rows, mean, last change, and the distinct stages in order."""
    return rows.groupBy(*keys).agg(
        F.sum(F.greatest(F.col(delta), F.lit(0.0))).alias("gain"), F.count(F.lit(1)).alias("n"), F.avg(weight).alias("mean_weight"), F.max_by(delta, order).alias("last_delta"),
        F.array_join(F.array_sort(F.collect_set(stage)), "+").alias("stages"))


def stage_changes(rows: DataFrame, *, keys: Sequence[str], stage: str, value: str, name: str) -> DataFrame:
    """The value less that of the stage before, within each key."""
    return rows.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(stage)))


def windowed_sums(daily: DataFrame, stages: DataFrame, *, key: str, day: str, stage: str, start: str, stop: str, value: str, above: float) -> DataFrame:
    """(key, stage, total, mean, days): sums over the days of each stage window and how many lie above a bound; windows may overlap."""
    spans = stages.select(F.col(key).alias("__k"), stage, F.explode(F.sequence(F.to_date(start), F.to_date(stop))).alias("__d"))
    met = daily.join(spans, (F.col(key) == F.col("__k")) & (F.to_date(day) == F.col("__d")))
    return met.groupBy(key, stage).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count_if(F.col(value) > above).alias("days"))


def cohort_growth(rows: DataFrame, *, group: str, unit: str, period: str, size: str, back: int, k: int) -> DataFrame:
    """(group, period, units, growth): growth a period over ``back`` periods of the ``k`` units that were largest at the start of the interval."""
    then = rows.select(F.col(group).alias("__g"), F.col(unit).alias("__u"), (F.col(period) + back).alias("__p"), F.col(size).alias("__s"))
    pair = rows.join(then, (F.col(group) == F.col("__g")) & (F.col(unit) == F.col("__u")) & (F.col(period) == F.col("__p")))
    chosen = pair.withColumn("__k", F.row_number().over(Window.partitionBy(group, period).orderBy(F.desc("__s"), unit))).where(F.col("__k") <= k)
    ratio = F.sum(size) / F.nullif(F.sum("__s"), F.lit(0.0))
    return chosen.groupBy(group, period).agg(F.count(F.lit(1)).alias("units"), F.when(ratio > 0, F.pow(ratio, F.lit(1.0 / back)) - 1).alias("growth"))


def attribution(rows: DataFrame, *, period: str, amount: Column, name: str = "amount") -> DataFrame:
    """(period, amount, share, largest): sums by period, their share of the whole, and whether the period is the largest; one row a period is ranked."""
    sums = rows.groupBy(period).agg(F.sum(amount).alias(name))
    whole = Window.partitionBy()
    return sums.withColumn("share", F.col(name) / F.nullif(F.sum(name).over(whole), F.lit(0.0))).withColumn("largest", F.row_number().over(whole.orderBy(F.desc(name), period)) == 1)


def ranked_after(rows: DataFrame, *, entity: str, period: str, value: str, months: int, name: str) -> DataFrame:
    """(entity, available, name): percent rank of the value within its period, less a half, available ``months`` later; nulls have none."""
    w = Window.partitionBy(period)
    n = F.count(value).over(w)
    ties = F.count(value).over(Window.partitionBy(period, value))
    rank = F.rank().over(w.orderBy(F.asc_nulls_last(value))) + (ties - 1) / 2.0
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), rank / F.nullif(n, F.lit(0)) - 0.5)).select(entity, F.add_months(F.to_date(period), months).alias("available"), name)


def with_precedence(*sources: tuple[str, DataFrame], key: str) -> DataFrame:
    """(key, other columns, source): of several sources with the same columns the first one that has a key gives its row; ties within it the least row."""
    rest = [c for c in sources[0][1].columns if c != key]
    whole = None
    for place, (name, df) in enumerate(sources):
        part = df.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(place).alias("p"), *rest, F.lit(name).alias("source")).alias("__v"))
        whole = part if whole is None else whole.unionByName(part)
    first = whole.groupBy(key).agg(F.min("__v").alias("__v"))
    return first.select(key, *[F.col(f"__v.{c}").alias(c) for c in rest], "__v.source")


def complete_roles(rows: DataFrame, *, key: str, role: str, value: str, roles: Sequence[str]) -> DataFrame:
    """(key, a column for each role): means by role of the keys that have all of them."""
    wide = rows.where(F.col(role).isin(*roles)).groupBy(key).agg(*[F.avg(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles], F.countDistinct(role).alias("__n"))
    return wide.where(F.col("__n") == len(roles)).drop("__n")


def sensitivity(rows: DataFrame, *, group: str, value: str, flagged: Column) -> DataFrame:
    """(group, n, flagged, mean, mean_without): a mean with and without the flagged rows, in one pass."""
    marked = F.coalesce(flagged, F.lit(False))
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.count_if(marked & F.col(value).isNotNull()).alias("flagged"), F.avg(value).alias("mean"), F.avg(F.when(~marked, F.col(value))).alias("mean_without"))
