"""As-of, offset, interval and fallback joins as compositions of equi-joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tidewell.operators.bounded import hot_slices


def _number(rows: DataFrame, column: str) -> Column:
    """A time, date or number as a number that rises with it."""
    kind = rows.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if isinstance(kind, DateType) else F.col(column)


def asof(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, values: Sequence[str],
         direction: str = "backward", exact: bool = True, slice_rows: int = 1_000_000) -> DataFrame:
    """``left`` with the nearest earlier (or later) row of ``right`` per key.

    Both sides are united and sorted once; the last known row is carried
    along.  ``exact`` lets equal times match.  Rows of ``left`` without match
    keep nulls, so do those with a null key; of several right rows at one time the greatest values count.

    A key with more than ``slice_rows`` rows is cut into slices of time, whose
    last rows are carried into the later ones: no key fills a task.  Keys are
    counted when the operator is called.
    """
    kept = F.struct(F.col(right_time).alias("__at"), *values)
    turn = 0 if exact else 2
    sign = 1 if direction == "backward" else -1
    marked = right.select(F.col(key), (sign * _number(right, right_time)).alias("__t"), F.lit(turn).alias("__turn"), kept.alias("__r"), F.lit(None).alias("__l"))
    probe = left.select(F.col(key), (sign * _number(left, left_time)).alias("__t"), F.lit(1).alias("__turn"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"))
    both = marked.where(F.col("__t").isNotNull() & F.col(key).isNotNull()).unionByName(probe)
    cuts = hot_slices(both.select(key, "__t"), key, "__t", slice_rows)
    slices = [] if cuts is None else ["__slice"]
    if cuts is not None:
        place = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: F.col("__t") > b)))
        both = both.join(F.broadcast(cuts), key, "left").withColumn("__slice", place)  # at most about 40,000 cut points
    order = Window.partitionBy(key, *slices).orderBy("__t", "__turn", F.col("__r"))
    found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if cuts is not None:
        ends = both.where("bounds is not null").groupBy(key, "__slice").agg(F.max(F.when(F.col("__r").isNotNull(), F.struct("__t", "__turn", "__r"))).alias("__m"))
        before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(key, "__slice", F.last("__m", ignorenulls=True).over(before).alias("__c"))
        found = found.join(F.broadcast(carried), [key, "__slice"], "left").withColumn("__f", F.coalesce("__f", "__c.__r"))
    return found.where("__turn = 1").select("__l.*", F.col("__f.__at").alias(f"matched_{right_time}"), *[F.col(f"__f.{v}").alias(f"matched_{v}") for v in values])


def nth_forward(left: DataFrame, calendar: DataFrame, *, key: str, day: str, same_day: Column, calendar_day: str, values: Sequence[str], delay: int = 0) -> DataFrame:
    """``left`` with the row of its key's calendar at which it can first act, ``delay`` rows later.

    The first calendar day at or after ``day`` counts where ``same_day`` holds,
    the first one after it elsewhere.  Rows whose calendar ends before keep
    nulls.  Calendar days are distinct per key.
    """
    numbered = calendar.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(calendar_day)))
    start = left.withColumn("__from", F.when(same_day, F.to_date(day)).otherwise(F.date_add(F.to_date(day), 1)))
    first = asof(start, numbered, key=key, left_time="__from", right_time=calendar_day, values=["__n"], direction="forward")
    want = first.withColumn("__n", F.col("matched___n") + delay).drop("__from", f"matched_{calendar_day}", "matched___n")
    found = numbered.select(key, "__n", F.col(calendar_day).alias(f"entry_{calendar_day}"), *[F.col(v).alias(f"entry_{v}") for v in values])
    return want.join(found, [key, "__n"], "left").drop("__n")


def near(left: DataFrame, right: DataFrame, *, key: str, left_day: str, right_day: str, reach: int) -> DataFrame:
    """(all of left, ``near`` count, ``nearest`` signed days): rows of the other table at most ``reach`` days away; of two equally near the earlier one.

    Days are cut into buckets of ``reach`` + 1 days; a right row is repeated in
    its own bucket and its neighbours, so that the join is an equi-join.
    """
    wide = reach + 1
    number = lambda c: F.unix_date(F.to_date(c))
    other = right.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), number(right_day).alias("__r"))
    other = other.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__r") / wide) - 1, F.floor(F.col("__r") / wide) + 1)))
    probe = left.withColumn("__row", F.struct(*left.columns)).withColumn("__l", number(left_day)).withColumn("__c", F.floor(F.col("__l") / wide))
    delta = F.col("__r") - F.col("__l")
    met = probe.join(other, (F.col(key) == F.col("__k")) & (F.col("__c") == F.col("__b")) & (F.abs(delta) <= reach), "left")
    found = met.groupBy("__row").agg(F.count("__r").alias("near"), F.min_by(delta, F.struct(F.abs(delta), delta)).alias("nearest"))
    return found.select("__row.*", "near", "nearest")


def overlapping_lists(left: DataFrame, right: DataFrame, *, left_list: str, right_list: str, left_id: str, right_id: str, condition: Column) -> DataFrame:
    """(left_id, right_id, shared): pairs whose lists share elements and for which ``condition`` holds, with the number of elements shared."""
    a = left.withColumn("__x", F.explode(F.array_distinct(left_list))).where("__x is not null")
    b = right.withColumn("__x", F.explode(F.array_distinct(right_list))).where("__x is not null")
    return a.join(b, "__x").where(condition).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("shared"))


def offset_rows(series: DataFrame, *, key: str, order: str, value: str, rows: int, name: str) -> DataFrame:
    """Each row with the value ``rows`` rows later on its own calendar."""
    return series.withColumn(name, F.lead(value, rows).over(Window.partitionBy(key).orderBy(order)))


def within(points: DataFrame, spans: DataFrame, *, key: str, point: str, start: str, stop: str, bucket_days: int = 30) -> DataFrame:
    """Points that lie in a closed span of their key, each once.

    Days are cut into buckets; spans are repeated in each bucket they touch,
    so that the join is an equi-join on (key, bucket).
    """
    day = lambda c: F.unix_date(F.to_date(c))
    cut = spans.select(key, start, stop, F.explode(F.sequence(F.floor(day(start) / bucket_days), F.floor(day(stop) / bucket_days))).alias("__b"))
    probe = points.withColumn("__b", F.floor(day(point) / bucket_days))
    other = cut.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), F.col(start).alias("__s"), F.col(stop).alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c")) & (F.col(point) >= F.col("__s")) & (F.col(point) <= F.col("__e"))
    return probe.join(other, inside, "left_semi").drop("__b")


def with_fallback(left: DataFrame, right: DataFrame, first: str, second: str, right_key: str, value: str, name: str) -> DataFrame:
    """Left join by one key, and by another where that finds nothing."""
    lookup = right.groupBy(F.col(right_key).alias("__k")).agg(F.min(value).alias("__v"))
    one = left.join(lookup, F.col(first) == F.col("__k"), "left").withColumnRenamed("__v", "__one").drop("__k")
    two = one.join(lookup, F.col("__one").isNull() & (F.col(second) == F.col("__k")), "left").drop("__k")
    return two.withColumn(name, F.coalesce("__one", "__v")).drop("__one", "__v")


def latest_with_ties(rows: DataFrame, key: str, time: str, until: Column) -> DataFrame:
    """All rows at the latest time of their key that is not after ``until``."""
    known = rows.where(F.col(time) <= until)
    return known.join(known.groupBy(key).agg(F.max(time).alias(time)), [key, time], "left_semi")
