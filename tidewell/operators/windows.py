"""Causal, rolling, seasonal and cross-sectional windows."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.bounded import hot_slices


def _strictly_before(key: str, micros: Column):
    return Window.partitionBy(key).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)


class RunningQuantile:
    """Linear-interpolation quantile of a growing sample: two heaps around its position."""

    def __init__(self, q: float) -> None:
        self.q, self.low, self.high = q, [], []

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def add(self, x: float) -> None:
        if self.low and x < -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        want = int((len(self) - 1) * self.q) + 1
        while len(self.low) < want:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > want:
            heapq.heappush(self.high, -heapq.heappop(self.low))

    @property
    def value(self) -> float:
        at = (len(self) - 1) * self.q
        part = at - int(at)
        low = -self.low[0]
        return low if not part else low + (self.high[0] - low) * part


_THRESHOLDS = "i long, threshold double, prior_count long, selected boolean"


def _threshold_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    types = (pa.int64(), pa.float64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["i", "threshold", "prior_count", "selected"])


class SlicedQuantile:
    """Linear-interpolation quantile of a growing sample of which only the values near the quantile are at hand.

    ``known`` are (value, times) in order, ``below`` the number of values under
    them and ``prior`` that of all earlier ones; values added later are kept.
    """

    def __init__(self, q: float, known: list[tuple[float, int]], below: int, prior: int) -> None:
        self.q, self.below, self.prior, self.added = q, below, prior, []
        self.values = [v for v, _ in known]
        self.upto = list(accumulate(n for _, n in known))

    def __len__(self) -> int:
        return self.prior + len(self.added)

    def add(self, x: float) -> None:
        insort(self.added, x)

    def _at(self, place: int) -> float:
        """The value with ``place`` values before it: the least one, of both lists, up to which there are enough."""
        want = place + 1 - self.below
        a = bisect_left(range(len(self.values)), want, key=lambda k: self.upto[k] + bisect_right(self.added, self.values[k]))

        def upto(k: int) -> int:
            at = bisect_right(self.values, self.added[k])
            return k + 1 + (self.upto[at - 1] if at else 0)

        b = bisect_left(range(len(self.added)), want, key=upto)
        return min(self.values[a] if a < len(self.values) else math.inf, self.added[b] if b < len(self.added) else math.inf)

    @property
    def value(self) -> float:
        at = (len(self) - 1) * self.q
        low = self._at(int(at))
        part = at - int(at)
        return low if not part else low + (self._at(int(at) + 1) - low) * part


def causal_threshold(rows: DataFrame, *, key: str, time: str, ident: str, score: str, fraction: float = 0.1, warmup: int = 50, slice_rows: int = 200_000) -> DataFrame:
    """(ident, threshold, prior_count, selected): the top ``fraction`` judged by strictly earlier scores alone.

    Rows of one instant never inform each other.  Null and NaN scores neither
    inform nor pass.  The exact expanding quantile costs O(log n) a row.

    A key with more than ``slice_rows`` rows is cut into slices of time that are
    walked side by side.  Within a slice of m rows the wanted rank among the
    earlier scores moves by at most m, so a slice is given the counts of the
    earlier scores and, one by one, only those near that rank; the result is
    the same.  Keys are counted when the operator is called.
    """
    q = 1 - fraction
    data = rows.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(ident).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    data = data.where("k is not null and t is not null and s is not null and not isnan(s)")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, waiting, seen = None, None, [], RunningQuantile(q)
        for batch in batches:
            out = []
            for k, t, i, s in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    now, at, waiting, seen = k, t, [], RunningQuantile(q)
                if t != at:
                    for x in waiting:
                        seen.add(x)
                    at, waiting = t, []
                limit = seen.value if len(seen) >= warmup and len(seen) else None
                out.append((i, limit, len(seen), limit is not None and s >= limit))
                waiting.append(s)
            yield _threshold_rows(out)

    whole = lambda df: df.repartition("k").sortWithinPartitions("k", "t", "i").mapInArrow(walk, _THRESHOLDS)
    cuts = hot_slices(data.select("k", "t"), "k", "t", slice_rows)
    if cuts is None:
        return whole(data).withColumnRenamed("i", ident)

    def walk_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, waiting, known, seen, start = None, None, [], [], None, (0, 0)
        for batch in batches:
            out = []
            for k, j, t, i, s, n, below, prior in zip(*[c.to_pylist() for c in batch.columns]):
                if (k, j) != now:
                    now, at, waiting, known, seen, start = (k, j), None, [], [], None, (0, 0)
                if t is None:  # what is known of earlier slices comes first
                    known.append((s, n))
                    start = (below, prior)
                    continue
                if seen is None:
                    seen = SlicedQuantile(q, known, *start)
                if t != at:
                    for x in waiting:
                        seen.add(x)
                    at, waiting = t, []
                limit = seen.value if len(seen) >= warmup and len(seen) else None
                out.append((i, limit, len(seen), limit is not None and s >= limit))
                waiting.append(s)
            yield _threshold_rows(out)

    grid = data.join(F.broadcast(cuts.select("k")), "k").groupBy("k").agg(F.array_distinct(F.percentile_approx("s", [i / 200 for i in range(1, 200)], 10_000)).alias("g"))
    hot = data.join(F.broadcast(cuts), "k").join(F.broadcast(grid), "k")  # a row with at most 200 numbers for each hot key
    hot = hot.select("k", "t", "i", "s", F.size(F.filter("bounds", lambda x: F.col("t") > x)).alias("j"), F.size(F.filter("g", lambda x: F.col("s") > x)).alias("b"))
    counts = hot.groupBy("k", "j", "b").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("k", "j").agg(F.sum("n").alias("m")).withColumn("prior", F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = sizes.join(counts.select("k", "b").distinct(), "k").join(counts, ["k", "j", "b"], "left")  # slices by ranges of a key
    cells = cells.withColumn("p", F.coalesce(F.sum("n").over(Window.partitionBy("k", "b").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("below", F.coalesce(F.sum("p").over(Window.partitionBy("k", "j").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first, last = F.floor((F.col("prior") - 1) * q) - F.col("m"), F.floor((F.col("prior") + F.col("m") - 1) * q) + 1
    touched = cells.where((F.col("p") > 0) & (F.col("below") <= last) & (F.col("below") + F.col("p") > first)).select("k", "j", "b", "below", "prior")
    base = touched.groupBy("k", "j").agg(F.min("below").alias("below"), F.max("prior").alias("prior"))
    values = hot.groupBy("k", F.col("j").alias("e"), "b", "s").agg(F.count(F.lit(1)).alias("n"))
    near = touched.select("k", "j", "b").join(values, ["k", "b"]).where("e < j").groupBy("k", "j", "s").agg(F.sum("n").alias("n")).join(base, ["k", "j"])
    no = lambda kind: F.lit(None).cast(kind)
    feed = near.select("k", "j", no("long").alias("t"), no("long").alias("i"), "s", "n", "below", "prior").unionByName(
        hot.select("k", "j", "t", "i", "s", no("long").alias("n"), no("long").alias("below"), no("long").alias("prior")))
    sliced = feed.repartition("k", "j").sortWithinPartitions("k", "j", F.asc_nulls_first("t"), "i", "s").mapInArrow(walk_slice, _THRESHOLDS)
    return whole(data.join(F.broadcast(cuts.select("k")), "k", "left_anti")).unionByName(sliced).withColumnRenamed("i", ident)


def lookback_threshold(rows: DataFrame, *, key: str, time: str, ident: str, score: str, fraction: float, warmup: int, lookback: int) -> DataFrame:
    """(ident, threshold, prior_count, selected): as ``causal_threshold``, judged by the last ``lookback`` strictly earlier scores.

    Of earlier scores at one instant those with the greater id are the later ones.
    """
    data = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    w = Window.partitionBy(key).orderBy(F.col(time), F.col(ident))
    # The strictly earlier rows end where the ties of the instant begin.
    placed = data.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.min("__n").over(Window.partitionBy(key, time)))
    recent = placed.withColumn("__near", F.collect_list(F.struct("__n", score)).over(w.rowsBetween(-lookback, -1)))
    ties = F.max(F.col("__n") - F.col("__first")).over(Window.partitionBy(key, time))
    known = recent.withColumn("__ties", ties).withColumn("__own", F.slice(F.array_sort(F.transform(F.filter("__near", lambda x: x["__n"] < F.col("__first")), lambda x: x[score])), 1, lookback))
    # Later rows of an instant borrow the list of its first row.
    shared = known.withColumn("__use", F.first("__own").over(Window.partitionBy(key, time).orderBy(ident).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n = F.size("__use")
    at = (n - 1) * (1 - fraction)
    low = F.floor(at).cast("int")
    value = F.col("__use")[low] + (F.col("__use")[F.least(low + 1, n - 1)] - F.col("__use")[low]) * (at - low)
    limit = F.when((n >= warmup) & (n > 0), value)
    return shared.select(ident, limit.alias("threshold"), n.alias("prior_count"), F.coalesce(F.col(score) >= limit, F.lit(False)).alias("selected"))


def causal_z(rows: DataFrame, *, key: str, time: str, fields: dict[str, int], name: str, least: int = 2, population: bool = False) -> DataFrame:
    """Mean of signed z-scores against strictly earlier rows; a field counts 0 with too few priors or no spread.

    With ``population`` the deviation is that of the population, a deviation
    of 0 counts as 1, and the score is null before ``least`` priors.
    """
    before = _strictly_before(key, F.unix_micros(F.col(time).cast("timestamp")))
    parts = []
    for field, sign in fields.items():
        n, mean, sd = (f(field).over(before) for f in (F.count, F.avg, F.stddev_pop if population else F.stddev_samp))
        if population:
            parts.append(F.when(n >= least, sign * (F.col(field) - mean) / F.when(sd > 0, sd).otherwise(1.0)))
        else:
            parts.append(F.when((n >= least) & (sd > 0), sign * (F.col(field) - mean) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))
    return rows.withColumn(name, sum(parts[1:], parts[0]) / len(parts))


def average_rank(value: Column, group: Sequence[str | Column], order: str) -> Column:
    """Rank with ties averaged, among non-null values."""
    base = Window.partitionBy(*group)
    ties = F.count(value).over(Window.partitionBy(*group, value))
    return F.when(value.isNotNull(), F.rank().over(base.orderBy(F.col(order).asc_nulls_last())) + (ties - 1) / 2.0)


def percent_rank_avg(rows: DataFrame, *, group: Sequence[str], value: str, name: str, missing: float = 0.5) -> DataFrame:
    """Average rank over the number of non-null values of the group; nulls get ``missing``."""
    n = F.count(value).over(Window.partitionBy(*group))
    return rows.withColumn(name, F.coalesce(average_rank(F.col(value), group, value) / F.nullif(n, F.lit(0)), F.lit(missing)))


def seasonal_z(rows: DataFrame, *, key: str, season: str, order: str, value: str, name: str, least: int = 5, clip: float = 4.0) -> DataFrame:
    """z against earlier periods of the same season."""
    before = Window.partitionBy(key, season).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean, sd = F.count(value).over(before), F.avg(value).over(before), F.stddev_samp(value).over(before)
    z = (F.col(value) - mean) / F.nullif(sd, F.lit(0.0))
    return rows.withColumn(name, F.when(n >= least, F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def rolling_z(rows: DataFrame, *, key: str, order: str, value: str, name: str, length: int, least: int, sign: int = -1) -> DataFrame:
    """Signed z of a value against its trailing ``length`` rows, itself included."""
    trail = Window.partitionBy(key).orderBy(order).rowsBetween(1 - length, 0)
    n, mean, sd = F.count(value).over(trail), F.avg(value).over(trail), F.stddev_samp(value).over(trail)
    return rows.withColumn(name, F.when(n >= least, sign * (F.col(value) - mean) / F.nullif(sd, F.lit(0.0))))


def gross_normalised(rows: DataFrame, *, date: str, value: str, name: str, demean: bool) -> DataFrame:
    """Divided by the sum of magnitudes of the date, after taking off the mean if asked."""
    day = Window.partitionBy(date)
    x = F.col(value) - F.avg(value).over(day) if demean else F.col(value)
    held = rows.withColumn("__x", x)
    return held.withColumn(name, F.col("__x") / F.nullif(F.sum(F.abs("__x")).over(day), F.lit(0.0))).drop("__x")


def momentum(rows: DataFrame, *, key: str, order: str, value: str, name: str, skip: int, look: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn(name, F.lag(value, skip).over(w) / F.nullif(F.lag(value, skip + look).over(w), F.lit(0.0)) - 1)


def expanding_trend(rows: DataFrame, *, key: str, x: str, y: str, name: str, least: int) -> DataFrame:
    """Least-squares line through strictly earlier points, read at the current one."""
    before = Window.partitionBy(key).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    n, sx, sy = F.count(y).over(before), F.sum(x).over(before), F.sum(y).over(before)
    sxx, sxy = F.sum(F.col(x) * F.col(x)).over(before), F.sum(F.col(x) * F.col(y)).over(before)
    slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0))
    return rows.withColumn("__n", n).withColumn("__b", slope).withColumn("__sx", sx).withColumn("__sy", sy).withColumn(
        name, F.when(F.col("__n") >= least, (F.col("__sy") - F.col("__b") * F.col("__sx")) / F.col("__n") + F.col("__b") * F.col(x))
    ).drop("__n", "__b", "__sx", "__sy")


def drawdown(rows: DataFrame, *, key: str, order: str, value: str, name: str) -> DataFrame:
    """Value over its running maximum, less one."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.col(value) / F.nullif(F.max(value).over(upto), F.lit(0.0)) - 1)


def worst_run(rows: DataFrame, *, key: str, order: str, value: str, length: int) -> DataFrame:
    """(key, mean, first, last): the ``length`` consecutive rows with the lowest mean."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = w.rowsBetween(0, length - 1)
    runs = rows.select(key, F.col(order).alias("first"), F.avg(value).over(ahead).alias("mean"), F.count(F.lit(1)).over(ahead).alias("n"), F.last(order).over(ahead).alias("last"))
    return runs.where(F.col("n") == length).groupBy(key).agg(F.min(F.struct("mean", "first", "last")).alias("w")).select(key, "w.mean", "w.first", "w.last")


def last_valid(rows: DataFrame, *, key: str, order: str, valid: Column, value: str, name: str) -> DataFrame:
    """The value of the nearest earlier row that is valid."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(valid, F.col(value)), ignorenulls=True).over(before))


def ewm(rows: DataFrame, *, key: str, order: str, value: str, name: str, halflife: float, least: int = 1) -> DataFrame:
    """Exponentially weighted mean of the past in adjusted form (weights add up to one).

    The terms of a row are its own block's running sum and the whole sum of
    the block before; a block lasts 60 half-lives, so what is left out
    weighs less than the last bit, and within a block weights are scaled to
    its start and cannot overflow.
    """
    decay = 0.5 ** (1.0 / halflife)
    length = max(1, int(60 * halflife))
    w = Window.partitionBy(key).orderBy(order)
    placed = rows.withColumn("__n", F.row_number().over(w) - 1)
    placed = placed.withColumn("__b", F.floor(F.col("__n") / length)).withColumn("__i", F.col("__n") % length)
    up = F.pow(F.lit(1.0 / decay), F.col("__i").cast("double"))
    x = F.col(value).cast("double")
    inside = Window.partitionBy(key, "__b").orderBy("__n")
    run = placed.withColumn("__s", F.sum(x * up).over(inside)).withColumn("__c", F.sum(F.when(x.isNotNull(), up)).over(inside))
    near = run.withColumn("__k", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.groupBy(key, F.col("__b").alias("__e")).agg(F.sum(x * up).alias("__t"), F.sum(F.when(x.isNotNull(), up)).alias("__u"))
    met = near.join(ends.select(F.col(key).alias("__y"), (F.col("__e") + 1).alias("__z"), "__t", "__u"), F.col(key).eqNullSafe(F.col("__y")) & (F.col("__b") == F.col("__z")), "left")
    fade = F.pow(F.lit(decay), F.lit(float(length)))
    top = F.coalesce(F.col("__s"), F.lit(0.0)) + F.coalesce(F.col("__t"), F.lit(0.0)) * fade
    bottom = F.coalesce(F.col("__c"), F.lit(0.0)) + F.coalesce(F.col("__u"), F.lit(0.0)) * fade
    mean = top / F.nullif(bottom, F.lit(0.0))
    return met.withColumn(name, F.when(F.col("__k") >= least, mean)).drop("__n", "__b", "__i", "__s", "__c", "__k", "__y", "__z", "__t", "__u")


def lagged_demeaned(rows: DataFrame, *, key: str, order: str, value: str, name: str, lag: int, clip: float | None = None) -> DataFrame:
    """The value ``lag`` rows back, clipped, less the mean of its date, over the sum of magnitudes of the date."""
    late = F.lag(value, lag).over(Window.partitionBy(key).orderBy(order))
    if clip is not None:
        late = F.greatest(F.lit(-clip), F.least(F.lit(clip), late))
    held = rows.withColumn("__v", late)
    return gross_normalised(held, date=order, value="__v", name=name, demean=True).drop("__v")


def smoothed_level(rows: DataFrame, *, key: str, order: str, value: str, name: str, long: int, short: int, weight: float = 0.75, lag: int = 0) -> DataFrame:
    """``weight`` of the long trailing mean and the rest of the change of the short one over its own length, ``lag`` rows late."""
    w = Window.partitionBy(key).orderBy(order)
    level, recent = F.avg(value).over(w.rowsBetween(1 - long, 0)), F.avg(value).over(w.rowsBetween(1 - short, 0))
    held = rows.withColumn("__l", level).withColumn("__r", recent)
    mixed = held.withColumn("__m", weight * F.col("__l") + (1 - weight) * (F.col("__r") - F.lag("__r", short).over(w)))
    return mixed.withColumn(name, F.lag("__m", lag).over(w) if lag else F.col("__m")).drop("__l", "__r", "__m")


def rolling_sharpe(rows: DataFrame, *, key: str, order: str, value: str, name: str, length: int, per_year: int) -> DataFrame:
    """Annualised mean over deviation of the trailing ``length`` rows; null before they are there or without spread."""
    trail = Window.partitionBy(key).orderBy(order).rowsBetween(1 - length, 0)
    n, mean, sd = F.count(value).over(trail), F.avg(value).over(trail), F.stddev_samp(value).over(trail)
    return rows.withColumn(name, F.when(n >= length, mean / F.nullif(sd, F.lit(0.0)) * per_year**0.5))


def blended(frames: list[tuple[float, DataFrame]], *, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Weighted sum of frames aligned on their keys; what one lacks counts nothing."""
    parts = [df.select(*keys, (w * F.col(value)).alias("__w")) for w, df in frames]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.sum("__w").alias(name))


def haircut(rows: DataFrame, *, signal: str, outlook: str, share: float, scale: float, name: str) -> DataFrame:
    """The signal less ``share`` of it, in proportion to the outlook up to ``scale``, where the two have opposite signs."""
    against = F.signum(signal) * F.signum(outlook) < 0
    cut = 1 - share * F.least(F.abs(outlook) / scale, F.lit(1.0))
    return rows.withColumn(name, F.col(signal) * F.when(against, cut).otherwise(1.0))


def mechanical(rows: DataFrame, *, key: str, day: str, close: str, volume: str) -> DataFrame:
    """Each row with features of the rows up to it: drawdown from the high of 253, momentum over 21, 126 and 252,
    population deviation of 63 log returns a year, log price and log mean turnover of 63; null with fewer than 64 rows."""
    w = Window.partitionBy(key).orderBy(day)
    back = lambda n: w.rowsBetween(1 - n, 0)
    base = rows.withColumn("__r", F.log(F.col(close) / F.nullif(F.lag(close).over(w), F.lit(0.0)))).withColumn("__n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ready = F.col("__n") >= 64
    out = base.withColumn("drawdown", F.when(ready, F.col(close) / F.max(close).over(back(253)) - 1))
    for n in (21, 126, 252):
        out = out.withColumn(f"mom{n}", F.when(ready, F.col(close) / F.nullif(F.lag(close, n).over(w), F.lit(0.0)) - 1))
    return out.withColumn("vol63", F.when(ready, F.stddev_pop("__r").over(back(63)) * 252**0.5)).withColumn("log_price", F.when(ready, F.log(close))).withColumn(
        "log_turnover", F.when(ready, F.log(F.avg(F.col(close) * F.col(volume)).over(back(63))))).drop("__r", "__n")


def forward_path(rows: DataFrame, *, key: str, day: str, close: str, bench: str, days: int, up: float, down: float) -> DataFrame:
    """Each row with what follows within ``days``: relative return over the benchmark at the end, lowest return on the
    way (0 at first), and the first days on which the relative return reaches ``up`` and the plain one ``down``."""
    number = F.unix_date(F.to_date(day))
    ahead = Window.partitionBy(key).orderBy(number).rangeBetween(1, days)
    path = rows.withColumn("__p", F.collect_list(F.struct(F.col(day).alias("d"), F.col(close).alias("c"), F.col(bench).alias("b"))).over(ahead))  # at most ``days`` rows
    stock, rel = (lambda x: x["c"] / F.col(close) - 1), (lambda x: (x["c"] / F.col(close)) / (x["b"] / F.col(bench)) - 1)
    last = F.try_element_at("__p", F.lit(-1))
    return path.withColumn("relative", rel(last)).withColumn("lowest", F.least(F.lit(0.0), F.array_min(F.transform("__p", stock)))).withColumn(
        "first_up", F.get(F.filter("__p", lambda x: rel(x) >= up), F.lit(0))["d"]).withColumn("first_down", F.get(F.filter("__p", lambda x: stock(x) <= down), F.lit(0))["d"]).drop("__p")
