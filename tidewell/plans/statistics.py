"""Correlation, discrimination, calibration, resampling, walk-forward fits."""

from pyspark.sql import functions as F

from tidewell.operators import stats as S
from tidewell.plans.registry import Registry
from tidewell.plans.windowing import panel
from tidewell.sources import load

plans = Registry()

_RANKED = """
    WITH r AS (SELECT event_type, value, user_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM events)
"""


@plans.query("pearson", "SELECT event_type, round(corr(value, user_id), 6) AS r FROM events GROUP BY event_type")
def pearson(spark, folder):
    return load(spark, folder, "events").groupBy("event_type").agg(F.round(S.correlation(F.col("value"), F.col("user_id").cast("double")), 6).alias("r"))


@plans.query("spearman", _RANKED + "SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type")
def spearman(spark, folder):
    return S.spearman(load(spark, folder, "events"), group="event_type", x="value", y="user_id").withColumn("rho", F.round("rho", 6))


@plans.query("monthly_ic", """
    WITH s AS (SELECT DISTINCT signal_id, strftime(entry_date, '%Y-%m') AS month, downside_probability AS x, stock_return AS y FROM p_plus20_current WHERE downside_probability IS NOT NULL AND stock_return IS NOT NULL AND entry_date IS NOT NULL),
    r AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY x) + (count(*) OVER (PARTITION BY month, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY month ORDER BY y) + (count(*) OVER (PARTITION BY month, y) - 1) / 2.0 AS ry FROM s)
    SELECT month, count(*) AS n, round(CASE WHEN count(*) >= 8 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM r GROUP BY month""")
def monthly_ic(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("entry_date is not null").select("signal_id", F.date_format("entry_date", "yyyy-MM").alias("month"), "downside_probability", "stock_return").distinct()
    return S.spearman(rows, group="month", x="downside_probability", y="stock_return", least=8).withColumn("rho", F.round("rho", 6))


@plans.query("auc_by_segment", """
    WITH b AS (SELECT event_type, value, (user_id > 50)::INTEGER AS y, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events),
    s AS (SELECT event_type, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, sum(r) FILTER (y = 1) AS u FROM b GROUP BY 1)
    SELECT event_type, positives, negatives, round((u - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 6) AS auc FROM s""")
def auc_by_segment(spark, folder):
    return S.auc(load(spark, folder, "events"), group="event_type", score="value", label=F.col("user_id") > 50).withColumn("auc", F.round("auc", 6))


_P = "WITH e AS (SELECT event_id, event_type, value / 100 AS p, (user_id > 50)::INTEGER AS y FROM events) "


def _scored(spark, folder):
    return load(spark, folder, "events").select("event_id", "event_type", (F.col("value") / 100).alias("p"), (F.col("user_id") > 50).cast("int").alias("y"))


@plans.query("brier_skill", _P + """
    SELECT event_type, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(1 - avg((p - y) * (p - y)) / nullif(avg(y) * (1 - avg(y)), 0), 6) AS skill FROM e GROUP BY event_type""")
def brier_skill(spark, folder):
    rows = S.brier(_scored(spark, folder), group="event_type", probability="p", outcome="y")
    return rows.select("event_type", "n", F.round("brier", 6).alias("brier"), F.round("skill", 6).alias("skill"))


@plans.query("calibration_error", _P + """
    , b AS (SELECT *, ntile(10) OVER (PARTITION BY event_type ORDER BY p, event_id) AS b FROM e), g AS (SELECT event_type, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY event_type, b)
    SELECT event_type, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY event_type""")
def calibration_error(spark, folder):
    return S.calibration_error(_scored(spark, folder), probability="p", outcome="y", ident="event_id", group="event_type").withColumn("ece", F.round("ece", 6))


@plans.query("wilson_bounds", """
    WITH c AS (SELECT event_type, sum((value > 50)::INTEGER)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1), q AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM c)
    SELECT event_type, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM q""")
def wilson_bounds(spark, folder):
    counts = load(spark, folder, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return counts.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@plans.query("hac_mean", """
    WITH p AS (SELECT event_type AS asset, ts::DATE AS d, sum(value) / 1000 AS v FROM events GROUP BY 1, 2), c AS (SELECT *, v - avg(v) OVER (PARTITION BY asset) AS c FROM p),
    g AS (SELECT asset, v, c * c AS g0, c * lag(c, 1) OVER w AS g1, c * lag(c, 2) OVER w AS g2, c * lag(c, 3) OVER w AS g3 FROM c WINDOW w AS (PARTITION BY asset ORDER BY d)),
    s AS (SELECT asset, count(*) AS n, avg(v) AS mean, sum(g0) + 2 * 0.75::DOUBLE * coalesce(sum(g1), 0) + 2 * 0.5::DOUBLE * coalesce(sum(g2), 0) + 2 * 0.25::DOUBLE * coalesce(sum(g3), 0) AS q FROM g GROUP BY asset)
    SELECT asset, n, round(mean, 6) AS mean, round(CASE WHEN q > 0 THEN mean / (sqrt(q) / n) END, 4) AS t FROM s""")
def hac_mean(spark, folder):
    rows = S.hac_mean(panel(spark, folder), key="asset", order="d", value="v", lags=3)
    return rows.select("asset", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@plans.query("series_metrics", """
    WITH m AS (SELECT event_type, count(*) AS n, avg(value - 50) * 252 AS a, stddev_samp(value - 50) * sqrt(252) AS s, sqrt(avg(least(value - 50, 0) * least(value - 50, 0))) * sqrt(252) AS d, avg((value > 50)::INTEGER) AS hit FROM events GROUP BY 1)
    SELECT event_type, n, round(a, 3) AS annual_mean, round(s, 3) AS vol, round(a / nullif(s, 0), 6) AS sharpe, round(a / nullif(d, 0), 6) AS sortino, round(hit, 6) AS hit FROM m""")
def series_metrics(spark, folder):
    rows = S.series_metrics(load(spark, folder, "events").withColumn("x", F.col("value") - 50), key="event_type", value="x", per_year=252)
    return rows.select("event_type", "n", F.round("annual_mean", 3).alias("annual_mean"), F.round("vol", 3).alias("vol"), *[F.round(c, 6).alias(c) for c in ("sharpe", "sortino", "hit")])


@plans.query("walk_forward_line", """
    WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, (o_custkey)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders),
    s AS (SELECT year, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM o GROUP BY year),
    p AS (SELECT a.year, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM s a JOIN s b ON b.year < a.year GROUP BY a.year),
    f AS (SELECT year, n, sx, sy, CASE WHEN n >= 30 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS b FROM p)
    SELECT o_orderkey, round((sy - b * sx) / n + b * x, 4) AS predicted FROM o LEFT JOIN f USING (year)""")
def walk_forward_line(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return S.walk_forward_line(rows, period="year", x="x", y="y").select("o_orderkey", F.round("predicted", 4).alias("predicted"))


@plans.query("quintile_spread", """
    WITH r AS (SELECT user_id, (rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type) AS q FROM events)
    SELECT round(avg(user_id) FILTER (q > 0.8::DOUBLE), 4) AS top, round(avg(user_id) FILTER (q <= 0.2::DOUBLE), 4) AS bottom, round(avg(user_id) FILTER (q > 0.8::DOUBLE) - avg(user_id) FILTER (q <= 0.2::DOUBLE), 4) AS spread FROM r""")
def quintile_spread(spark, folder):
    rows = S.quintile_spread(load(spark, folder, "events"), group=["event_type"], score="value", outcome="user_id")
    return rows.select(*[F.round(c, 4).alias(c) for c in ("top", "bottom", "spread")])
