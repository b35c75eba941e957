"""Resampling, permutation tests, walk-forward fits, measures of series and predictions."""

from pyspark.sql import functions as F

from tidewell.operators import learning as L
from tidewell.operators import resampling as Z
from tidewell.operators import stats as S
from tidewell.plans.markets import series
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()


def _hash(text):
    return f"('0x' || substr(sha256({text}), 1, 12))::BIGINT"


_TIMES = " + ".join(f"(u >= {p}::DOUBLE)::INTEGER" for p in Z._POISSON)
_DAILY = "SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY 1, 2"


def _daily(spark, folder):
    return load(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))


@plans.query("moving_blocks", f"""
    WITH s AS ({_DAILY}), u AS (SELECT event_type, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY event_type) AS n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY d)),
    e AS (SELECT event_type, i, s FROM u UNION ALL SELECT DISTINCT event_type, 0, 0 FROM u), c AS (SELECT DISTINCT event_type, n, least(7, n) AS z FROM u),
    p AS (SELECT event_type, n, z, draw, unnest(generate_series(0, ceil(n / z)::BIGINT - 1)) AS b FROM (SELECT *, unnest(generate_series(0, 199)) AS draw FROM c)),
    q AS (SELECT *, {_hash("'11:' || draw || ':' || b")} % (n - z + 1) AS a, least(z, n - b * z) AS len FROM p)
    SELECT q.event_type, draw, round(sum(y.s - x.s) / max(n), 6) AS mean FROM q JOIN e x ON x.event_type = q.event_type AND x.i = a JOIN e y ON y.event_type = q.event_type AND y.i = a + len GROUP BY 1, 2""")
def moving_blocks(spark, folder):
    found = Z.moving_blocks(_daily(spark, folder), key="event_type", order="d", value="v", block=7, draws=200, seed=11)
    return found.select("event_type", F.col("draw").cast("long").alias("draw"), F.round("mean", 6).alias("mean"))


_PAIRED = f"""
    WITH s AS (SELECT event_type, user_id, sum(value) AS sv, count(value) AS nv, sum((value > 50)::INTEGER) AS sh, count(*) AS nh FROM events GROUP BY 1, 2), d AS (SELECT *, unnest(generate_series(0, 199)) AS draw FROM s),
    w AS (SELECT *, {_hash("'3:' || draw || ':' || user_id")} / 281474976710656.0::DOUBLE AS u FROM d), t AS (SELECT *, {_TIMES} AS w FROM w),
    m AS (SELECT event_type, draw, sum(w * sv) / sum(w * nv) AS value, sum(w * sh) / sum(w * nh) AS high FROM t WHERE w > 0 GROUP BY 1, 2)
"""


@plans.query("paired_interval", _PAIRED + "SELECT event_type, round(quantile_cont(value / 100 - high, 0.025::DOUBLE), 6) AS low, round(quantile_cont(value / 100 - high, 0.975::DOUBLE), 6) AS high FROM m GROUP BY event_type")
def paired_interval(spark, folder):
    """Interval of the gap between two means that share their draws of whole users."""
    rows = load(spark, folder, "events").withColumn("high", (F.col("value") > 50).cast("double"))
    draws = Z.poisson_means(rows, group="event_type", unit="user_id", values=["value", "high"], draws=200, seed=3)
    found = Z.interval(draws, group="event_type", value=F.col("value") / 100 - F.col("high"))
    return found.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plans.query("permutation_p", f"""
    WITH a AS (SELECT item, min(cohort) AS cohort, min(excess) AS x, min(coalesce(ox_p20, 0)) >= 40 AS s FROM answer_key WHERE excess IS NOT NULL GROUP BY item), r AS (SELECT cohort, count(*) FILTER (s) AS k, avg(x) FILTER (s) AS o FROM a GROUP BY cohort),
    d AS (SELECT *, unnest(generate_series(0, 99)) AS draw FROM a), p AS (SELECT cohort, draw, x, row_number() OVER (PARTITION BY cohort, draw ORDER BY {_hash("'117:' || draw || ':' || item")}, item) AS n FROM d),
    m AS (SELECT cohort, draw, avg(x) AS m, max(o) AS o FROM p JOIN r USING (cohort) WHERE n <= k GROUP BY 1, 2)
    SELECT cohort, round(max(o), 6) AS observed, round((1 + count(*) FILTER (m >= o)) / 101.0::DOUBLE, 6) AS p FROM m GROUP BY cohort""")
def permutation_p(spark, folder):
    rows = load(spark, folder, "answer_key").where("excess is not null").groupBy("item").agg(F.min("cohort").alias("cohort"), F.min("excess").alias("x"), F.min(F.coalesce("ox_p20", F.lit(0.0))).alias("p"))
    found = Z.permutation_p(rows, group="cohort", ident="item", value="x", selected=F.col("p") >= 40, draws=100, seed=117)
    return found.select("cohort", F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


@plans.query("placebo_p", f"""
    WITH s AS (SELECT DISTINCT signal_id, strftime(entry_date, '%Y-%m') AS month, score, stock_return AS y FROM p_plus20_current WHERE entry_date IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND stock_return IS NOT NULL AND NOT isnan(stock_return)),
    w AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY month) * 0.2::DOUBLE)) AS k FROM s), o AS (SELECT avg(y) AS o FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, signal_id) AS n FROM w) WHERE n <= k),
    d AS (SELECT *, unnest(generate_series(0, 49)) AS draw FROM w), p AS (SELECT draw, y, k, row_number() OVER (PARTITION BY draw, month ORDER BY {_hash("'9:' || draw || ':' || signal_id")}, signal_id) AS n FROM d), m AS (SELECT draw, avg(y) AS m FROM p WHERE n <= k GROUP BY draw)
    SELECT round(max(o), 6) AS observed, round((1 + count(*) FILTER (m >= o)) / 51.0::DOUBLE, 6) AS p FROM m, o""")
def placebo_p(spark, folder):
    """Top fifth of each month by score against scores dealt out within the month."""
    rows = load(spark, folder, "p_plus20_current").where("entry_date is not null and not isnan(score) and not isnan(stock_return)")
    rows = rows.select("signal_id", F.date_format("entry_date", "yyyy-MM").alias("month"), "score", "stock_return").distinct()
    found = Z.placebo_p(rows, block="month", ident="signal_id", score="score", outcome="stock_return", fraction=0.2, draws=50, seed=9)
    return found.select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


@plans.query("permuted_within", f"""
    WITH a AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, row_number() OVER (PARTITION BY event_type ORDER BY {_hash("'5:' || event_id")}, event_id) AS j FROM events)
    SELECT a.event_id, a.value, b.value AS dealt FROM a JOIN a b ON a.event_type = b.event_type AND a.k = b.j""")
def permuted_within(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "event_type", "value")
    return Z.permuted_within(rows, block="event_type", ident="event_id", value="value", seed=5, name="dealt").select("event_id", "value", "dealt")


@plans.query("ordinal_spearman", """
    WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rx, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS ry FROM events)
    SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type""")
def ordinal_spearman(spark, folder):
    return S.ordinal_spearman(load(spark, folder, "events"), group="event_type", x="value", y="user_id", ident="event_id").withColumn("rho", F.round("rho", 6))


@plans.query("basket_metrics", """
    WITH s AS (SELECT DISTINCT signal_id, source, stock_return AS x FROM p_plus20_current WHERE stock_return IS NOT NULL AND NOT isnan(stock_return))
    SELECT source, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg((x > 0)::INTEGER), 6) AS positive, round(avg((x >= 0.2::DOUBLE)::INTEGER), 6) AS success FROM s GROUP BY source""")
def basket_metrics(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("not isnan(stock_return)").select("signal_id", "source", "stock_return").distinct()
    found = rows.groupBy("source").agg(*S.basket("stock_return", 0.2))
    return found.select("source", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "positive", "success")])


@plans.query("top_decile", """
    WITH c AS (SELECT event_type, quantile_cont(value, 0.9::DOUBLE) AS c FROM events GROUP BY event_type) SELECT event_type, count(*) AS n, round(avg(user_id), 6) AS mean, round(median(user_id), 6) AS median FROM events JOIN c USING (event_type) WHERE value >= c GROUP BY event_type""")
def top_decile(spark, folder):
    rows = S.top_quantile(load(spark, folder, "events"), group="event_type", score="value", q=0.9)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("user_id"), 6).alias("mean"), F.round(F.median("user_id"), 6).alias("median"))


@plans.query("correlation_test", """
    WITH s AS (SELECT event_type, ts::DATE AS d, corr(value, user_id) AS r FROM events GROUP BY 1, 2 HAVING count(*) >= 8) SELECT event_type, count(r) AS n, round(avg(r), 6) AS mean, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 4) AS t FROM s GROUP BY event_type""")
def correlation_test(spark, folder):
    """Mean of daily correlations with its t value."""
    days = load(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(S.correlation(F.col("value"), F.col("user_id").cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    found = S.correlation_test(days, value="r", group="event_type")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@plans.query("exact_replicates", "SELECT event_id // 2 AS pair, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) = 2")
def exact_replicates(spark, folder):
    pairs = load(spark, folder, "events").withColumn("pair", F.floor(F.col("event_id") / 2))
    whole = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair")
    return S.exact_mean(pairs.join(whole, "pair", "left_semi"), key="pair", value="value", replicates=2).select("pair", F.round("mean", 6).alias("mean"))


_MARKET = """
    WITH p AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS d, avg(o_totalprice) / 997 AS c FROM orders GROUP BY 1, 2), b AS (SELECT d, avg(c) AS b FROM p GROUP BY d),
    r AS (SELECT asset, d, tanh(c / 100 - 2.5::DOUBLE) / 50 AS r, tanh(b / 100 - 2.5::DOUBLE) / 50 AS m, 0.0001::DOUBLE AS f FROM p JOIN b USING (d))
"""


def _returns(spark, folder):
    closes = series(spark, folder)
    market = closes.groupBy("d").agg(F.avg("c").alias("b"))
    bound = lambda c: F.tanh(F.col(c) / 100 - 2.5) / 50
    return closes.join(market, "d").select("asset", "d", bound("c").alias("r"), bound("b").alias("m"), F.lit(0.0001).alias("f"))


_HAC = " + ".join(["sum(g0)"] + [f"2 * (1 - {k} / 21.0::DOUBLE) * sum(g{k})" for k in range(1, 21)])


@plans.query("full_metrics", _MARKET + f"""
    , w AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY d)) AS v FROM r), q AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY asset ORDER BY d)) - 1 AS dd, r - m AS x FROM w),
    h AS (SELECT asset, d, x - avg(x) OVER (PARTITION BY asset) AS c FROM q), g AS (SELECT asset, c * c AS g0, {', '.join(f'c * lag(c, {k}) OVER w AS g{k}' for k in range(1, 21))} FROM h WINDOW w AS (PARTITION BY asset ORDER BY d)), z AS (SELECT asset, {_HAC} AS z FROM g GROUP BY asset),
    a AS (SELECT asset, count(*) AS n, greatest(1, max(d) - min(d)) / 365.25::DOUBLE AS years, exp(sum(ln(1 + r))) - 1 AS total, stddev_samp(r) * sqrt(252) AS vol, avg(r - f) * 252 AS me, stddev_samp(r - f) * sqrt(252) AS se, sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252) AS sd,
      min(dd) AS drawdown, avg(x) * 252 AS mx, stddev_samp(x) * sqrt(252) AS sx, covar_samp(r - f, m - f) / var_samp(m - f) AS beta, avg(m - f) * 252 AS mb, avg(x) AS ax FROM q GROUP BY asset)
    SELECT asset, n, round(years, 6) AS years, round(total, 6) AS total, round(pow(1 + total, 1 / years) - 1, 6) AS cagr, round(vol, 6) AS vol, round(me / se, 6) AS sharpe, round(me / sd, 6) AS sortino, round(drawdown, 6) AS drawdown, round(mx / sx, 6) AS ir, round(beta, 6) AS beta,
      round(me - beta * mb, 6) AS alpha, round(ax / (sqrt(z) / n), 4) AS hac_t FROM a JOIN z USING (asset)""")
def full_metrics(spark, folder):
    found = S.full_metrics(_returns(spark, folder), key="asset", day="d", value="r", bench="m", free="f")
    return found.select("asset", "n", *[F.round(c, 6).alias(c) for c in ("years", "total", "cagr", "vol", "sharpe", "sortino", "drawdown", "ir", "beta", "alpha")], F.round("hac_t", 4).alias("hac_t"))


@plans.query("fit_quality", _MARKET + "SELECT asset, count(*) AS n, round(1 - avg((r - m) * (r - m)) / var_pop(r), 6) AS r2, round(sqrt(avg((r - m) * (r - m))), 6) AS rmse, round(avg((sign(r) = sign(m))::INTEGER), 6) AS direction FROM r GROUP BY asset")
def fit_quality(spark, folder):
    found = S.fit_quality(_returns(spark, folder), group="asset", predicted="m", actual="r")
    return found.select("asset", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "direction")])


_GUESSES = "WITH a AS (SELECT DISTINCT answer_id, item, direction FROM answers WHERE direction IS NOT NULL), g AS (SELECT direction, CASE WHEN winner THEN 'up' ELSE 'down' END AS real FROM a JOIN (SELECT item, bool_or(winner) AS winner FROM answer_key GROUP BY item) USING (item))"


def _guesses(spark, folder):
    answers = load(spark, folder, "answers").where("direction is not null").select("answer_id", "item", "direction").distinct()
    key = load(spark, folder, "answer_key").groupBy("item").agg(F.bool_or("winner").alias("winner"))
    return answers.join(key, "item").select("direction", F.when(F.col("winner"), "up").otherwise("down").alias("real"))


@plans.query("confusion_counts", _GUESSES + "SELECT real, direction, count(*) AS n FROM g GROUP BY 1, 2")
def confusion_counts(spark, folder):
    return L.confusion(_guesses(spark, folder), label="real", predicted="direction")


@plans.query("macro_scores", _GUESSES + """
    , c AS (SELECT real AS c, (real = direction)::INTEGER AS tp, 1 AS r, 0 AS s FROM g UNION ALL SELECT direction, 0, 0, 1 FROM g), e AS (SELECT c, sum(tp) AS tp, sum(r) AS r, sum(s) AS s FROM c GROUP BY c)
    SELECT round(sum(tp) / sum(r), 6) AS accuracy, round(avg(2 * tp / (r + s)), 6) AS macro_f1 FROM e""")
def macro_scores(spark, folder):
    found = L.macro_scores(L.confusion(_guesses(spark, folder), label="real", predicted="direction"), label="real", predicted="direction")
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_YEARS = "WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey / 100.0::DOUBLE AS a, (o_orderkey % 17)::DOUBLE AS b, o_totalprice / 1000 AS t FROM orders)"


@plans.query("walk_forward_ridge", _YEARS + """
    , s AS (SELECT p.y, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(t) AS st, sum(a * a) + 10 AS aa, sum(a * b) AS ab, sum(b * b) + 10 AS bb, sum(a * t) AS pa, sum(b * t) AS pb FROM (SELECT DISTINCT y FROM o) p JOIN o ON o.y < p.y GROUP BY p.y),
    c AS (SELECT y, n, sa, sb, st, aa - sa * sa / n AS aa, ab - sa * sb / n AS ab, bb - sb * sb / n AS bb, pa - sa * st / n AS pa, pb - sb * st / n AS pb FROM s), k AS (SELECT *, (pa * bb - pb * ab) / (aa * bb - ab * ab) AS ka, (pb * aa - pa * ab) / (aa * bb - ab * ab) AS kb FROM c)
    SELECT o_orderkey, round(st / n + ka * (a - sa / n) + kb * (b - sb / n), 4) AS predicted FROM o LEFT JOIN k USING (y)""")
def walk_forward_ridge(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_custkey") / 100.0).alias("a"), (F.col("o_orderkey") % 17).cast("double").alias("b"), (F.col("o_totalprice") / 1000).alias("t"))
    return L.walk_forward_ridge(rows, period="y", features=["a", "b"], target="t", name="predicted").select("o_orderkey", F.round("predicted", 4).alias("predicted"))


@plans.query("walk_forward_calibration")
def walk_forward_calibration(spark, folder):
    """Probabilities of earlier years recalibrated; iterative, so without SQL."""
    rows = load(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") / 520_000).alias("p"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("hit"))
    return L.walk_forward_logistic(rows, period="y", score="p", label="hit", name="calibrated").select("o_orderkey", F.round("calibrated", 4).alias("calibrated"))


@plans.query("expanding_forest")
def expanding_forest(spark, folder):
    """A random forest for each year, fitted on the years before; learned, so without SQL."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = load(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("double").alias("c"), (F.col("o_totalprice") / 1000).alias("t"))
    make = lambda: Pipeline(stages=[
        StringIndexer(inputCols=["o_orderpriority", "o_orderstatus"], outputCols=["i", "j"], handleInvalid="keep"), VectorAssembler(inputCols=["i", "j", "c"], outputCol="x"),
        RandomForestRegressor(featuresCol="x", labelCol="t", numTrees=8, maxDepth=4, seed=7)])
    return L.expanding_fit(rows, period="y", estimator=make).select("o_orderkey", F.round("prediction", 4).alias("predicted"))


@plans.query("training_percentile", """
    WITH o AS (SELECT event_id, event_type, value FROM events), t AS (SELECT value FROM o WHERE event_type <> 'error')
    SELECT event_id, round((SELECT count(*) FROM t WHERE t.value < o.value) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share FROM o WHERE event_type = 'error'""")
def training_percentile(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "event_type", "value")
    found = L.training_percentile(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), value="value", name="share")
    return found.select("event_id", F.round("share", 6).alias("share"))
