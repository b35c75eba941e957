"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_level(rows: DataFrame, *, outer: str, inner: str, value: str, red: Column) -> DataFrame:
    """Per outer key over its inner groups: mean of means, groups with any red row, and their bucket (four or more as 4)."""
    first = rows.groupBy(outer, inner).agg(F.avg(value).alias("m"), F.bool_or(red).alias("red"))
    return first.groupBy(outer).agg(
        F.avg("m").alias("mean_of_means"), F.count_if("red").alias("red_groups"), F.count(F.lit(1)).alias("groups"),
    ).withColumn("bucket", F.least("red_groups", F.lit(4)))


def upper_median(rows: DataFrame, *, key: str, value: str, name: str) -> DataFrame:
    """(key, name): element n // 2 of the sorted values, counted from 0: the upper one of two middle values.

    Values are counted before they are ranked, so that a hot key costs as many
    rows as it has distinct values; no group is collected.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(key).agg(F.sum("__n").alias("__t"))
    upto = F.sum("__n").over(Window.partitionBy(key).orderBy(value))
    ranked = counts.withColumn("__u", upto).join(total.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")))
    return ranked.where(F.col("__u") > F.floor(F.col("__t") / 2)).groupBy(key).agg(F.min(value).alias(name))


def with_total(rows: DataFrame, key: str, *aggregates: Column, total: str = "all") -> DataFrame:
    """Aggregates per key and over everything, in one pass."""
    return rows.rollup(key).agg(*aggregates, F.grouping_id().alias("__g")).withColumn(
        key, F.when(F.col("__g") == 1, total).otherwise(F.col(key))).drop("__g")


def compounded(value: str | Column) -> Column:
    """Product of one plus the values, less one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.product(1 + value) - 1


def weighted_mean(value: str, weight: str) -> Column:
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(both, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(both, F.col(weight))), F.lit(0.0))


def share_within(rows: DataFrame, *, group: str, part: str, value: str) -> DataFrame:
    """(group, part, total, share): sums per part and their share of the group."""
    sums = rows.groupBy(group, part).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.nullif(F.sum("total").over(Window.partitionBy(group)), F.lit(0.0)))


def consensus(rows: DataFrame, *, key: str, label: str, unsure: str = "uncertain") -> DataFrame:
    """The label all rows of a key agree on, else ``unsure``."""
    return rows.groupBy(key).agg(F.when(F.min(label) == F.max(label), F.min(label)).otherwise(unsure).alias("consensus"), F.count(F.lit(1)).alias("votes"))


def clusters(rows: DataFrame, *, key: str, actor: str, day: str, span_days: int, least: int = 2) -> DataFrame:
    """Keys acted on by ``least`` actors within ``span_days``, with the first and last day."""
    return rows.groupBy(key).agg(
        F.countDistinct(actor).alias("actors"), F.datediff(F.max(day), F.min(day)).alias("span"),
    ).where((F.col("actors") >= least) & (F.col("span") <= span_days))


def pivoted(rows: DataFrame, *, key: str, role: str, roles: Sequence[str], value: str, complete: bool) -> DataFrame:
    """One column per role; keys that lack a role are left out if ``complete``."""
    wide = rows.groupBy(key).pivot(role, list(roles)).agg(F.avg(value))
    return wide.dropna(subset=list(roles)) if complete else wide


def bucketed(rows: DataFrame, *, probability: str, outcome: str, buckets: int = 10) -> DataFrame:
    """(bucket, n, mean_p, hit_rate) by ``min(floor(p * buckets), buckets - 1)``."""
    b = F.least(F.floor(F.col(probability) * buckets), F.lit(buckets - 1)).cast("int")
    return rows.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_p"), F.avg(outcome).alias("hit_rate"))


def priority_event(rows: DataFrame, *, keys: Sequence[str], role: str, ranking: Sequence[str], flag: Column) -> DataFrame:
    """Many rows to one event: the role of highest priority, all roles, any and all of a flag."""
    place = F.array_position(F.array(*map(F.lit, ranking)), F.col(role))
    place = F.when(place > 0, place).otherwise(len(ranking) + 1)
    return rows.groupBy(*keys).agg(
        F.min_by(role, F.struct(place, F.col(role))).alias("first_role"), F.array_join(F.array_sort(F.collect_set(role)), "+").alias("roles"),
        F.bool_or(flag).alias("any_flag"), F.bool_and(flag).alias("all_flag"))
