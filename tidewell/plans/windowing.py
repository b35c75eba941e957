"""Causal, rolling, seasonal and cross-sectional windows over signals and a daily panel of events."""

from pyspark.sql import functions as F

from tidewell.operators import intervals as I
from tidewell.operators import windows as W
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

_PANEL = "WITH p AS (SELECT event_type AS asset, ts::DATE AS d, sum(value) / 1000 AS v, count(*) AS n FROM events GROUP BY 1, 2) "
_DAY = "strftime(d, '%Y-%m-%d') AS day"


def panel(spark, folder):
    """Value per asset and day."""
    return load(spark, folder, "events").groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("d")).agg((F.sum("value") / 1000).alias("v"), F.count(F.lit(1)).alias("n"))


def _out(rows, *columns):
    return rows.select("asset", F.date_format("d", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in columns])


@plans.query("causal_top_fraction", """
    WITH s AS (SELECT DISTINCT signal_id, source, epoch_us(loaded_at) AS t, score FROM (SELECT signal_id, source, score, min(loaded_at) AS loaded_at FROM p_plus20_current
               WHERE source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)),
    q AS (SELECT signal_id, score, quantile_cont(score, 0.9::DOUBLE) OVER w AS threshold, count(*) OVER w AS prior_count FROM s
          WINDOW w AS (PARTITION BY source ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT signal_id, prior_count, round(CASE WHEN prior_count >= 50 THEN threshold END, 6) AS threshold, prior_count >= 50 AND score >= threshold AS selected FROM q""")
def causal_top_fraction(spark, folder):
    signals = load(spark, folder, "p_plus20_current").where("not isnan(score)").groupBy("signal_id", "source", "score").agg(F.min("loaded_at").alias("loaded_at"))
    found = W.causal_threshold(signals, key="source", time="loaded_at", ident="signal_id", score="score", fraction=0.1, warmup=50)
    return found.select("signal_id", "prior_count", F.round("threshold", 6).alias("threshold"), "selected")


@plans.query("causal_z", """
    WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS t FROM events),
    z AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM e
          WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(CASE WHEN n >= 2 AND s > 0 THEN (value - m) / s ELSE 0 END, 4) AS z FROM z""")
def causal_z(spark, folder):
    rows = W.causal_z(load(spark, folder, "events").select("event_id", "event_type", "value", "ts"), key="event_type", time="ts", fields={"value": 1}, name="z")
    return rows.select("event_id", F.round("z", 4).alias("z"))


@plans.query("month_rank", """
    WITH s AS (SELECT DISTINCT signal_id, strftime(entry_date, '%Y-%m') AS month, stock_return AS x FROM p_plus20_current),
    r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY x ASC NULLS LAST) AS k, count(*) OVER (PARTITION BY month, x) AS ties, count(x) OVER (PARTITION BY month) AS n FROM s)
    SELECT signal_id, month, round(CASE WHEN x IS NULL THEN 0.5 ELSE (k + (ties - 1) / 2.0) / n END, 6) AS month_rank FROM r""")
def month_rank(spark, folder):
    rows = load(spark, folder, "p_plus20_current").select("signal_id", F.date_format("entry_date", "yyyy-MM").alias("month"), F.col("stock_return").alias("x")).distinct()
    return W.percent_rank_avg(rows, group=["month"], value="x", name="q").select("signal_id", "month", F.round("q", 6).alias("month_rank"))


@plans.query("seasonal_z", _PANEL + f"""
    , w AS (SELECT asset, d, v, count(v) OVER s AS n, avg(v) OVER s AS m, stddev_samp(v) OVER s AS sd FROM p
      WINDOW s AS (PARTITION BY asset, isodow(d) ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT asset, {_DAY}, round(CASE WHEN n >= 3 AND sd > 0 THEN greatest(-4, least(4, (v - m) / sd)) END, 6) AS z FROM w""")
def seasonal_z(spark, folder):
    rows = panel(spark, folder).withColumn("season", F.weekday("d"))
    return _out(W.seasonal_z(rows, key="asset", season="season", order="d", value="v", name="z", least=3), "z")


@plans.query("rolling_z", _PANEL + f"""
    , w AS (SELECT asset, d, v, count(v) OVER s AS n, avg(v) OVER s AS m, stddev_samp(v) OVER s AS sd FROM p WINDOW s AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT asset, {_DAY}, round(CASE WHEN n >= 5 THEN -(v - m) / nullif(sd, 0) END, 6) AS z FROM w""")
def rolling_z(spark, folder):
    return _out(W.rolling_z(panel(spark, folder), key="asset", order="d", value="v", name="z", length=10, least=5), "z")


@plans.query("gross_normalised", _PANEL + f"""
    , c AS (SELECT asset, d, v - avg(v) OVER (PARTITION BY d) AS x FROM p)
    SELECT asset, {_DAY}, round(x / nullif(sum(abs(x)) OVER (PARTITION BY d), 0), 6) AS weight FROM c""")
def gross_normalised(spark, folder):
    return _out(W.gross_normalised(panel(spark, folder), date="d", value="v", name="weight", demean=True), "weight")


@plans.query("gross_normalised_raw", _PANEL + f"SELECT asset, {_DAY}, round(v / nullif(sum(abs(v)) OVER (PARTITION BY d), 0), 6) AS weight FROM p")
def gross_normalised_raw(spark, folder):
    return _out(W.gross_normalised(panel(spark, folder), date="d", value="v", name="weight", demean=False), "weight")


@plans.query("momentum", _PANEL + f"""
    SELECT asset, {_DAY}, round(lag(v, 1) OVER w / nullif(lag(v, 6) OVER w, 0) - 1, 6) AS momentum FROM p WINDOW w AS (PARTITION BY asset ORDER BY d)""")
def momentum(spark, folder):
    return _out(W.momentum(panel(spark, folder), key="asset", order="d", value="v", name="momentum", skip=1, look=5), "momentum")


@plans.query("expanding_trend", _PANEL + f"""
    , i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d)::DOUBLE AS x FROM p),
    w AS (SELECT *, count(*) OVER s AS k, regr_slope(v, x) OVER s AS b, regr_intercept(v, x) OVER s AS a FROM i WINDOW s AS (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT asset, {_DAY}, round(CASE WHEN k >= 5 THEN a + b * x END, 4) AS trend FROM w""")
def expanding_trend(spark, folder):
    from pyspark.sql import Window

    rows = panel(spark, folder).withColumn("x", F.row_number().over(Window.partitionBy("asset").orderBy("d")).cast("double"))
    found = W.expanding_trend(rows, key="asset", x="x", y="v", name="trend", least=5)
    return found.select("asset", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("trend", 4).alias("trend"))


@plans.query("drawdown", _PANEL + f"SELECT asset, {_DAY}, round(v / max(v) OVER (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM p")
def drawdown(spark, folder):
    return _out(W.drawdown(panel(spark, folder), key="asset", order="d", value="v", name="drawdown"), "drawdown")


@plans.query("worst_run", _PANEL + """
    , r AS (SELECT asset, d, avg(v) OVER w AS m, count(*) OVER w AS n, last_value(d) OVER w AS e FROM p WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY m, d) AS rn FROM r WHERE n = 5)
    SELECT asset, round(m, 6) AS mean, strftime(d, '%Y-%m-%d') AS first_day, strftime(e, '%Y-%m-%d') AS last_day FROM k WHERE rn = 1""")
def worst_run(spark, folder):
    rows = W.worst_run(panel(spark, folder), key="asset", order="d", value="v", length=5)
    return rows.select("asset", F.round("mean", 6).alias("mean"), F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@plans.query("last_valid", _PANEL + f"""
    SELECT asset, {_DAY}, round(last_value(CASE WHEN n >= 60 THEN v END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS before FROM p""")
def last_valid(spark, folder):
    return _out(W.last_valid(panel(spark, folder), key="asset", order="d", valid=F.col("n") >= 60, value="v", name="before"), "before")


@plans.query("ewm", _PANEL + f"""
    , i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) AS r FROM p)
    SELECT a.asset, strftime(a.d, '%Y-%m-%d') AS day, round(sum(b.v * pow(0.5, (a.r - b.r) / 4.0)) / sum(pow(0.5, (a.r - b.r) / 4.0)), 6) AS ewm
    FROM i a JOIN i b ON b.asset = a.asset AND b.r <= a.r GROUP BY a.asset, a.d""")
def ewm(spark, folder):
    return _out(W.ewm(panel(spark, folder), key="asset", order="d", value="v", name="ewm", halflife=4.0), "ewm")


@plans.query("collapsed_runs", """
    SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    WHERE k = 1 OR b IS DISTINCT FROM event_type""")
def collapsed_runs(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return I.collapsed_runs(rows, key="user_id", order=["ts", "event_id"], value="event_type").select("event_id")


@plans.query("hourly_counts", "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, folder):
    from tidewell.streaming import hourly_counts as counts

    return counts(load(spark, folder, "events")).withColumn("total", F.round("total", 2))


@plans.query("sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, folder):
    from tidewell.streaming import late_tolerant_totals

    return late_tolerant_totals(load(spark, folder, "events"))
