"""Correlation, discrimination, calibration, serial-correlation tests, resampling and walk-forward fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.windows import average_rank


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson from sums over rows where both are given; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(F.sqrt(spread), F.lit(0.0)))


def spearman(rows: DataFrame, *, group: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, rho): rank correlation with averaged ties; groups under ``least`` rows or without spread have null."""
    data = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = data.select(group, average_rank(F.col("__x"), [group], "__x").alias("rx"), average_rank(F.col("__y"), [group], "__y").alias("ry"))
    found = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho"))
    return found.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def auc(rows: DataFrame, *, group: str, score: str, label: Column) -> DataFrame:
    """(group, positives, negatives, auc) by rank sums, ties count half."""
    data = rows.where(F.col(score).isNotNull()).select(group, F.col(score).alias("__s"), label.cast("int").alias("__y")).where("__y is not null")
    ranked = data.withColumn("__r", average_rank(F.col("__s"), [group], "__s"))
    sums = ranked.groupBy(group).agg(F.sum("__y").alias("positives"), F.sum(1 - F.col("__y")).alias("negatives"), F.sum(F.when(F.col("__y") == 1, F.col("__r"))).alias("__u"))
    u = F.col("__u") - F.col("positives") * (F.col("positives") + 1) / 2.0
    return sums.withColumn("auc", _over(u, (F.col("positives") * F.col("negatives")).cast("double"))).drop("__u")


def brier(rows: DataFrame, *, group: str, probability: str, outcome: str) -> DataFrame:
    """(group, n, brier, skill): skill against always saying the group's base rate."""
    p, y = F.col(probability), F.col(outcome).cast("double")
    found = rows.where(p.isNotNull() & y.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("__b"))
    return found.withColumn("skill", 1 - _over(F.col("brier"), F.col("__b") * (1 - F.col("__b")))).drop("__b")


def calibration_error(rows: DataFrame, *, probability: str, outcome: str, ident: str, group: str, bins: int = 10) -> DataFrame:
    """(group, ece): mean gap of probability and frequency over bins of equal count, ties in order of ``ident``."""
    binned = rows.withColumn("__b", F.ntile(bins).over(Window.partitionBy(group).orderBy(probability, ident)))
    each = binned.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(probability) - F.avg(F.col(outcome).cast("double"))).alias("gap"))
    return each.groupBy(group).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a share."""
    p = _over(hits.cast("double"), n.cast("double"))
    centre, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - width) / (1 + z * z / n), (centre + width) / (1 + z * z / n)


def hac_mean(rows: DataFrame, *, key: str, order: str, value: str, lags: int) -> DataFrame:
    """(key, n, mean, t): mean with its Newey-West t value, Bartlett weights."""
    w = Window.partitionBy(key).orderBy(order)
    centred = rows.where(F.col(value).isNotNull()).select(key, order, value).withColumn("c", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    products = centred.select(key, value, (F.col("c") * F.col("c")).alias("g0"), *[(F.col("c") * F.lag("c", k).over(w)).alias(f"g{k}") for k in range(1, lags + 1)])
    total = F.sum("g0")
    for k in range(1, lags + 1):
        total = total + 2.0 * (1 - k / (lags + 1.0)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0))
    found = products.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), total.alias("__v"))
    return found.withColumn("t", F.when(F.col("__v") > 0, F.col("mean") / F.nullif(F.sqrt(F.col("__v")) / F.col("n"), F.lit(0.0)))).drop("__v")


def series_metrics(rows: DataFrame, *, key: str, value: str, per_year: int) -> DataFrame:
    """(key, n, annual_mean, vol, sharpe, sortino, hit): downside deviation over all rows."""
    down = F.least(F.col(value), F.lit(0.0))
    found = rows.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(value) * per_year).alias("annual_mean"), (F.stddev_samp(value) * per_year**0.5).alias("vol"),
        (F.sqrt(F.avg(down * down)) * per_year**0.5).alias("__d"), F.avg((F.col(value) > 0).cast("double")).alias("hit"))
    return found.withColumn("sharpe", _over(F.col("annual_mean"), F.col("vol"))).withColumn("sortino", _over(F.col("annual_mean"), F.col("__d"))).drop("__d")


def full_metrics(rows: DataFrame, *, key: str, day: str, value: str, bench: str, free: str, lags: int = 20) -> DataFrame:
    """(key, n, years, total, cagr, vol, sharpe, sortino, drawdown, ir, beta, alpha, hac_t, hac_p) of daily returns.

    Years are days over 365.25, one day at least; Sharpe is of the excess over
    the free rate, Sortino divides by the root mean square of losses over all
    days, beta and alpha are of excesses over the free rate, the information
    ratio and the HAC test of the difference to the benchmark.
    """
    data = rows.where(F.col(value).isNotNull() & F.col(bench).isNotNull())
    up = Window.partitionBy(key).orderBy(day)
    wealth = F.exp(F.sum(F.log1p(value)).over(up))
    peak = F.greatest(F.lit(1.0), F.max("__v").over(up))
    series = data.withColumn("__v", wealth).withColumn("__dd", F.col("__v") / peak - 1).withColumn("__e", F.col(value) - F.coalesce(F.col(free), F.lit(0.0)))
    series = series.withColumn("__b", F.col(bench) - F.coalesce(F.col(free), F.lit(0.0))).withColumn("__x", F.col(value) - F.col(bench))
    loss = F.least(F.col(value), F.lit(0.0))
    year = 252.0
    found = series.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.greatest(F.datediff(F.max(day), F.min(day)), F.lit(1)) / 365.25).alias("years"), (F.exp(F.sum(F.log1p(value))) - 1).alias("total"),
        (F.stddev_samp(value) * year**0.5).alias("vol"), (F.avg("__e") * year).alias("__me"), (F.stddev_samp("__e") * year**0.5).alias("__se"), (F.sqrt(F.avg(loss * loss)) * year**0.5).alias("__d"),
        F.min("__dd").alias("drawdown"), (F.avg("__x") * year).alias("__mx"), (F.stddev_samp("__x") * year**0.5).alias("__sx"), F.covar_samp("__e", "__b").alias("__c"), F.var_samp("__b").alias("__vb"), (F.avg("__b") * year).alias("__mb"))
    tested = hac_mean(series, key=key, order=day, value="__x", lags=lags).select(F.col(key).alias("__k"), F.col("t").alias("hac_t"))
    out = found.join(tested, F.col(key) == F.col("__k"), "left").withColumn("beta", _over(F.col("__c"), F.col("__vb")))
    return out.select(
        key, "n", "years", "total", (F.pow(1 + F.col("total"), 1 / F.col("years")) - 1).alias("cagr"), "vol", _over(F.col("__me"), F.col("__se")).alias("sharpe"), _over(F.col("__me"), F.col("__d")).alias("sortino"),
        "drawdown", _over(F.col("__mx"), F.col("__sx")).alias("ir"), "beta", (F.col("__me") - F.col("beta") * F.col("__mb")).alias("alpha"), "hac_t", two_sided(F.col("hac_t")).alias("hac_p"))


def two_sided(t: Column) -> Column:
    """Two-sided normal p value by the rational approximation of erfc (absolute error below 1.2e-7)."""
    z = F.abs(t) / 2.0**0.5
    u = 1 / (1 + 0.5 * z)
    # Coefficients of the Chebyshev fit of erfc, from the highest power down.
    terms = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = F.lit(terms[0])
    for c in terms[1:]:
        poly = poly * u + c
    return u * F.exp(-z * z + poly)


def ordinal_spearman(rows: DataFrame, *, group: str, x: str, y: str, ident: str) -> DataFrame:
    """(group, n, rho): rank correlation where ties keep the order of ``ident``; 0 under three rows."""
    data = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(c, ident)).cast("double")
    ranked = data.select(group, place(x).alias("rx"), place(y).alias("ry"))
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) < 3, 0.0).otherwise(correlation(F.col("rx"), F.col("ry"))).alias("rho"))


def basket(value: str, win: float = 0.0) -> list[Column]:
    """n, mean, median, share above nought and share at or above ``win``, as aggregates."""
    x = F.col(value)
    share = lambda test: F.avg(F.when(x.isNotNull(), test.cast("double")))
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), share(x > 0).alias("positive"), share(x >= win).alias("success")]


def top_quantile(rows: DataFrame, *, group: str, score: str, q: float) -> DataFrame:
    """Rows at or above their group's exact quantile of the score."""
    cut = rows.groupBy(F.col(group).alias("__g")).agg(F.percentile(score, q).alias("__c"))
    return rows.join(cut, F.col(group) == F.col("__g")).where(F.col(score) >= F.col("__c")).drop("__g", "__c")


def correlation_test(rows: DataFrame, *, value: str, group: str | None = None) -> DataFrame:
    """(group, n, mean, t) of period correlations: mean over its standard error; null for one period."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    grouped = rows.groupBy(group) if group else rows.groupBy()
    return grouped.agg(n.alias("n"), mean.alias("mean"), (mean / F.nullif(sd / F.sqrt(n), F.lit(0.0))).alias("t"))


def exact_mean(rows: DataFrame, *, key: str, value: str, replicates: int) -> DataFrame:
    """(key, mean): means of exactly ``replicates`` numeric values a key; raises for any other number when the rows are read."""
    found = rows.groupBy(key).agg(F.count(value).alias("__n"), F.avg(value).alias("mean"))
    right = F.when(F.col("__n") == replicates, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong number of replicates of "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(right).select(key, "mean")


def fit_quality(rows: DataFrame, *, group: str, predicted: str, actual: str) -> DataFrame:
    """(group, n, r2, rmse, direction): share of variance explained, root mean square error, share of equal signs."""
    data = rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    error = F.col(actual) - F.col(predicted)
    found = data.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("__m"), F.var_pop(actual).alias("__v"), F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("direction"))
    return found.select(group, "n", (1 - _over(F.col("__m"), F.col("__v"))).alias("r2"), F.sqrt("__m").alias("rmse"), "direction")


def walk_forward_line(rows: DataFrame, *, period: str, x: str, y: str, least: int = 30) -> DataFrame:
    """Each row with the prediction of a line fitted on strictly earlier periods.

    Sums per period are added up before the periods are joined back: the rows
    are aggregated once whatever the number of fits.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    sums = rows.where(ok).groupBy(period).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    before = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    past = sums.select(period, *[F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = _over(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = past.withColumn("slope", F.when(F.col("n") >= least, slope)).withColumn("level", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    return rows.join(F.broadcast(fit.select(period, "slope", "level")), period, "left").withColumn("predicted", F.col("level") + F.col("slope") * F.col(x)).drop("slope", "level")


def quintile_spread(rows: DataFrame, *, group: Sequence[str], score: str, outcome: str) -> DataFrame:
    """(top, bottom, spread): mean outcome above the 80th and up to the 20th percent rank within groups."""
    from tidewell.operators.windows import percent_rank_avg

    ranked = percent_rank_avg(rows.where(F.col(score).isNotNull()), group=group, value=score, name="__q")
    found = ranked.agg(F.avg(F.when(F.col("__q") > 0.8, F.col(outcome))).alias("top"), F.avg(F.when(F.col("__q") <= 0.2, F.col(outcome))).alias("bottom"))
    return found.withColumn("spread", F.col("top") - F.col("bottom"))
