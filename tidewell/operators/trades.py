"""Exits, contracts, curves, bonds, and the positions that signals lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import asof


def exits(entries: DataFrame, closes: DataFrame, *, key: str, entry_day: str, entry_price: str, day: str, close: str, hold: int) -> DataFrame:
    """Entries with the first close ``hold`` days on or later: ``exit_day``, ``exit``, and the return.

    Where the series ends before (``gap``), ``low`` takes the exit as worth
    nothing and ``high`` as the last close known; elsewhere both are the return.
    """
    due = entries.withColumn("__due", F.date_add(F.to_date(entry_day), hold))
    met = asof(due, closes.select(key, F.col(day).alias("__d"), F.col(close).alias("__c")), key=key, left_time="__due", right_time="__d", values=["__c"], direction="forward")
    last = closes.groupBy(F.col(key).alias("__k")).agg(F.max_by(close, day).alias("__last"))
    found = met.join(last, F.col(key) == F.col("__k"), "left").withColumnsRenamed({"matched___d": "exit_day", "matched___c": "exit"})
    price = F.nullif(F.col(entry_price), F.lit(0.0))
    return found.withColumn("gap", F.col("exit_day").isNull()).withColumn("low", F.coalesce("exit", F.lit(0.0)) / price - 1).withColumn(
        "high", F.coalesce("exit", "__last") / price - 1).drop("__due", "__k", "__last")


def carry(rows: DataFrame, *, key: str, day: str, expiry: str, price: str, least_days: int) -> DataFrame:
    """(key, day, carry): yearly log slope from the front to the next contract, of those at least ``least_days`` from expiry."""
    live = rows.where((F.datediff(expiry, day) >= least_days) & (F.col(price) > 0))
    two = live.withColumn("__n", F.row_number().over(Window.partitionBy(key, day).orderBy(expiry))).where("__n <= 2")
    pair = two.groupBy(key, day).agg(*[F.max(F.when(F.col("__n") == n, F.col(c))).alias(f"__{c}{n}") for n in (1, 2) for c in (price, expiry)])
    gap = F.datediff(f"__{expiry}2", f"__{expiry}1")
    return pair.where(gap > 0).select(key, day, (F.log(F.col(f"__{price}1") / F.col(f"__{price}2")) * 365.25 / gap).alias("carry"))


def same_contract_returns(rows: DataFrame, *, key: str, day: str, contract: str, expiry: str, price: str, least_days: int) -> DataFrame:
    """(key, day, ret, rolled): the front contract of a day held to the key's next day in the same contract.

    ``rolled`` tells that another contract is the front then; both are null on the last day.
    """
    front = rows.where(F.datediff(expiry, day) >= least_days).groupBy(key, day).agg(F.min_by(contract, expiry).alias("__c"), F.min_by(price, expiry).alias("__p"))
    w = Window.partitionBy(key).orderBy(day)
    held = front.withColumn("__next", F.lead(day).over(w)).withColumn("__then", F.lead("__c").over(w))
    later = rows.select(F.col(key).alias("__k"), F.col(day).alias("__d"), F.col(contract).alias("__x"), F.col(price).alias("__q"))
    met = held.join(later, (F.col(key) == F.col("__k")) & (F.col("__next") == F.col("__d")) & (F.col("__c") == F.col("__x")), "left")
    return met.select(key, day, (F.col("__q") / F.nullif(F.col("__p"), F.lit(0.0)) - 1).alias("ret"), (F.col("__c") != F.col("__then")).alias("rolled"))


def interpolated(points: DataFrame, anchors: DataFrame, *, key: str, at: str, anchor: str, value: str, name: str) -> DataFrame:
    """Points with the value on the line between the anchors before and after them, level beyond the ends."""
    before = asof(points, anchors, key=key, left_time=at, right_time=anchor, values=[value]).withColumnsRenamed({f"matched_{anchor}": "__t0", f"matched_{value}": "__y0"})
    both = asof(before, anchors, key=key, left_time=at, right_time=anchor, values=[value], direction="forward").withColumnsRenamed({f"matched_{anchor}": "__t1", f"matched_{value}": "__y1"})
    line = F.col("__y0") + (F.col("__y1") - F.col("__y0")) * (F.col(at) - F.col("__t0")) / F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0))
    return both.withColumn(name, F.coalesce(line, "__y0", "__y1")).drop("__t0", "__y0", "__t1", "__y1")


def bond(coupon: Column, yield_: Column, years: Column, face: float = 100.0) -> tuple[Column, Column]:
    """(price, modified duration) of a bond with yearly coupons: sums over its payments."""
    terms = F.sequence(F.lit(1), years.cast("int"))
    paid = lambda t: (face * coupon + F.when(t == years.cast("int"), face).otherwise(0.0)) / F.pow(1 + yield_, t.cast("double"))
    add = lambda a, x: a + x
    price = F.aggregate(F.transform(terms, paid), F.lit(0.0), add)
    weighted = F.aggregate(F.transform(terms, lambda t: t * paid(t)), F.lit(0.0), add)
    return price, weighted / F.nullif(price, F.lit(0.0)) / (1 + yield_)


def monthly_held(rows: DataFrame, *, key: str, day: str, value: str, name: str) -> DataFrame:
    """Each row with the last value of the key's month before."""
    month = F.trunc(day, "month")
    ends = rows.groupBy(key, month.alias("__m")).agg(F.max_by(value, day).alias("__v"))
    late = ends.withColumn(name, F.lag("__v").over(Window.partitionBy(key).orderBy("__m"))).select(F.col(key).alias("__k"), "__m", name)
    return rows.withColumn("__o", month).join(late, (F.col(key) == F.col("__k")) & (F.col("__o") == F.col("__m"))).drop("__o", "__k", "__m")
