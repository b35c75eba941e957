"""Entries and exits on calendars, forward paths, market features, signal chains, curves and contracts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import times
from tidewell.operators import joins as J
from tidewell.operators import trades as X
from tidewell.operators import windows as W
from tidewell.plans.registry import Registry
from tidewell.plans.windowing import panel
from tidewell.sources import load

plans = Registry()

_SERIES = "WITH p AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS d, avg(o_totalprice) / 997 AS c, count(*) AS v FROM orders GROUP BY 1, 2) "
_KEY = "asset, strftime(d, '%Y-%m-%d') AS day"


def series(spark, folder):
    """A close and a volume for each asset and day: orders by priority."""
    return load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d")).agg(
        (F.avg("o_totalprice") / 997).alias("c"), F.count(F.lit(1)).alias("v"))


def _shown(rows, *columns):
    return rows.select("asset", F.date_format("d", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in columns])


@plans.query("entry_by_time_of_day", """
    WITH c AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS n FROM (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'click')),
    s AS (SELECT event_id, user_id, ts::DATE + CASE WHEN extract(hour FROM ts) < 16 THEN 0 ELSE 1 END AS f FROM events WHERE event_type = 'error'),
    e AS (SELECT event_id, s.user_id, min(n) + 1 AS n FROM s LEFT JOIN c ON c.user_id = s.user_id AND c.d >= s.f GROUP BY 1, 2)
    SELECT event_id, strftime(c.d, '%Y-%m-%d') AS entry FROM e LEFT JOIN c USING (user_id, n)""")
def entry_by_time_of_day(spark, folder):
    """Errors as signals: the same day's click day counts before 16:00 only, and the entry is one click day later."""
    events = load(spark, folder, "events")
    calendar = events.where("event_type = 'click'").select("user_id", F.to_date("ts").alias("d")).distinct()
    signals = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    found = J.nth_forward(signals, calendar, key="user_id", day="ts", same_day=F.hour("ts") < 16, calendar_day="d", values=[], delay=1)
    return found.select("event_id", F.date_format("entry_d", "yyyy-MM-dd").alias("entry"))


@plans.query("near_filings", """
    WITH s AS (SELECT DISTINCT signal_id, cik, loaded_at::DATE AS d FROM p_plus20_current), f AS (SELECT DISTINCT filing_id, lpad(cik, 10, '0') AS cik, loaded_at::DATE AS d FROM filing_records),
    m AS (SELECT signal_id, s.d, f.d - s.d AS delta FROM s LEFT JOIN f ON s.cik = f.cik AND abs(f.d - s.d) <= 5)
    SELECT signal_id, strftime(d, '%Y-%m-%d') AS day, count(delta) AS near, arg_min(delta, abs(delta) * 100 + delta) AS nearest FROM m GROUP BY signal_id, d""")
def near_filings(spark, folder):
    signals = load(spark, folder, "p_plus20_current").select("signal_id", "cik", F.to_date("loaded_at").alias("d")).distinct()
    filings = load(spark, folder, "filing_records").select("filing_id", F.lpad("cik", 10, "0").alias("cik"), F.to_date("loaded_at").alias("f")).distinct()
    found = J.near(signals, filings, key="cik", left_day="d", right_day="f", reach=5)
    return found.select("signal_id", F.date_format("d", "yyyy-MM-dd").alias("day"), "near", F.col("nearest").cast("long").alias("nearest"))


@plans.query("list_overlap_after", """
    WITH a AS (SELECT DISTINCT answer_id, answered_at, unnest(alternates) AS name FROM answers), b AS (SELECT form, min(loaded_at) AS since, unnest(list(DISTINCT issuer)) AS name FROM filing_records WHERE form IS NOT NULL GROUP BY form)
    SELECT answer_id, form, count(*) AS shared FROM (SELECT DISTINCT answer_id, answered_at, name FROM a) a JOIN b USING (name) WHERE answered_at >= since GROUP BY ALL""")
def list_overlap_after(spark, folder):
    """Answers and forms that share a company name, once the form has been filed."""
    answers = load(spark, folder, "answers").select("answer_id", "answered_at", "alternates").distinct()
    forms = load(spark, folder, "filing_records").where("form is not null").groupBy("form").agg(F.min("loaded_at").alias("since"), F.collect_set("issuer").alias("issuers"))
    return J.overlapping_lists(answers, forms, left_list="alternates", right_list="issuers", left_id="answer_id", right_id="form", condition=F.col("answered_at") >= F.col("since"))


_TRADES = _SERIES + """
    , s AS (SELECT o_orderkey, o_orderpriority AS asset, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P'),
    e AS (SELECT o_orderkey, s.asset, p.d AS entry_day, p.c AS entry FROM s JOIN p ON p.asset = s.asset AND p.d = s.d),
    x AS (SELECT o_orderkey, e.asset, entry_day, entry, min(p.d) AS exit_day, arg_min(p.c, p.d) AS exit FROM e LEFT JOIN p ON p.asset = e.asset AND p.d >= entry_day + 90 GROUP BY ALL),
    l AS (SELECT asset, arg_max(c, d) AS last FROM p GROUP BY asset)
"""


@plans.query("trade_exits", _TRADES + """
    SELECT o_orderkey, strftime(exit_day, '%Y-%m-%d') AS exit_day, exit_day IS NULL AS gap, round(coalesce(exit, 0) / entry - 1, 6) AS low, round(coalesce(exit, last) / entry - 1, 6) AS high FROM x JOIN l USING (asset)""")
def trade_exits(spark, folder):
    """Positions leave at the first close 90 days on; where the series ends before, at nothing or at the last close."""
    closes = series(spark, folder)
    signals = load(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d"))
    entries = signals.join(closes.select("asset", "d", F.col("c").alias("entry")), ["asset", "d"])
    found = X.exits(entries, closes, key="asset", entry_day="d", entry_price="entry", day="d", close="c", hold=90)
    return found.select("o_orderkey", F.date_format("exit_day", "yyyy-MM-dd").alias("exit_day"), "gap", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plans.query("mechanical_features", _SERIES + f"""
    , r AS (SELECT *, ln(c / lag(c) OVER w) AS r, count(*) OVER (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING) AS n FROM p WINDOW w AS (PARTITION BY asset ORDER BY d)),
    f AS (SELECT *, c / max(c) OVER (PARTITION BY asset ORDER BY d ROWS 252 PRECEDING) - 1 AS drawdown, c / lag(c, 21) OVER w - 1 AS mom21, c / lag(c, 126) OVER w - 1 AS mom126, c / lag(c, 252) OVER w - 1 AS mom252,
          stddev_pop(r) OVER (PARTITION BY asset ORDER BY d ROWS 62 PRECEDING) * sqrt(252) AS vol63, ln(c) AS log_price, ln(avg(c * v) OVER (PARTITION BY asset ORDER BY d ROWS 62 PRECEDING)) AS log_turnover FROM r WINDOW w AS (PARTITION BY asset ORDER BY d))
    SELECT {_KEY}, {', '.join(f'CASE WHEN n >= 64 THEN round({c}, 6) END AS {c}' for c in 'drawdown mom21 mom126 mom252 vol63 log_price log_turnover'.split())} FROM f""")
def mechanical_features(spark, folder):
    return _shown(W.mechanical(series(spark, folder), key="asset", day="d", close="c", volume="v"), "drawdown", "mom21", "mom126", "mom252", "vol63", "log_price", "log_turnover")


@plans.query("forward_paths", _SERIES + f"""
    , b AS (SELECT d, avg(c) AS b FROM p GROUP BY d), q AS (SELECT asset, d, c, b FROM p JOIN b USING (d)),
    j AS (SELECT x.asset, x.d, y.d AS e, y.c / x.c - 1 AS s, (y.c / x.c) / (y.b / x.b) - 1 AS r FROM q x LEFT JOIN q y ON x.asset = y.asset AND y.d > x.d AND y.d <= x.d + 30)
    SELECT {_KEY}, round(arg_max(r, e), 6) AS relative, round(least(0, min(s)), 6) AS lowest, strftime(min(e) FILTER (r >= 0.2::DOUBLE), '%Y-%m-%d') AS first_up, strftime(min(e) FILTER (s <= -0.25::DOUBLE), '%Y-%m-%d') AS first_down FROM j GROUP BY asset, d""")
def forward_paths(spark, folder):
    closes = series(spark, folder)
    market = closes.groupBy("d").agg(F.avg("c").alias("b"))
    found = W.forward_path(closes.join(market, "d"), key="asset", day="d", close="c", bench="b", days=30, up=0.2, down=-0.25)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("asset", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("relative", 6).alias("relative"), F.round("lowest", 6).alias("lowest"), day("first_up"), day("first_down"))


@plans.query("rolling_sharpe", _SERIES + f"""
    , r AS (SELECT *, c / lag(c) OVER (PARTITION BY asset ORDER BY d) - 1 AS r FROM p), t AS (SELECT *, count(r) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM r WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 25 PRECEDING))
    SELECT {_KEY}, round(CASE WHEN n >= 26 THEN m / nullif(s, 0) * sqrt(52) END, 6) AS sharpe FROM t""")
def rolling_sharpe(spark, folder):
    returns = series(spark, folder).withColumn("r", F.col("c") / F.lag("c").over(Window.partitionBy("asset").orderBy("d")) - 1)
    return _shown(W.rolling_sharpe(returns, key="asset", order="d", value="r", name="sharpe", length=26, per_year=52), "sharpe")


@plans.query("lagged_demeaned", _SERIES + f"""
    , l AS (SELECT *, greatest(-3000, least(300, lag(c, 4) OVER (PARTITION BY asset ORDER BY d)))  AS x FROM p), m AS (SELECT *, x - avg(x) OVER (PARTITION BY d) AS z FROM l)
    SELECT {_KEY}, round(z / nullif(sum(abs(z)) OVER (PARTITION BY d), 0), 6) AS weight FROM m""".replace("greatest(-3000, least(300,", "greatest(-300, least(300,"))
def lagged_demeaned(spark, folder):
    return _shown(W.lagged_demeaned(series(spark, folder), key="asset", order="d", value="c", name="weight", lag=4, clip=300.0), "weight")


@plans.query("smoothed_level", _SERIES + f"""
    , a AS (SELECT *, avg(c) OVER (PARTITION BY asset ORDER BY d ROWS 12 PRECEDING) AS l, avg(c) OVER (PARTITION BY asset ORDER BY d ROWS 3 PRECEDING) AS r FROM p),
    b AS (SELECT *, 0.75::DOUBLE * l + 0.25::DOUBLE * (r - lag(r, 4) OVER (PARTITION BY asset ORDER BY d)) AS m FROM a)
    SELECT {_KEY}, round(lag(m, 2) OVER (PARTITION BY asset ORDER BY d), 6) AS signal FROM b""")
def smoothed_level(spark, folder):
    return _shown(W.smoothed_level(series(spark, folder), key="asset", order="d", value="c", name="signal", long=13, short=4, lag=2), "signal")


@plans.query("blended_signals", _SERIES + f"""
    , a AS (SELECT asset, d, 0.6::DOUBLE * c AS w FROM p UNION ALL SELECT asset, d, 0.4::DOUBLE * v FROM p WHERE v > 1) SELECT {_KEY}, round(sum(w), 6) AS signal FROM a GROUP BY asset, d""")
def blended_signals(spark, folder):
    rows = series(spark, folder)
    return _shown(W.blended([(0.6, rows.select("asset", "d", F.col("c").alias("x"))), (0.4, rows.where("v > 1").select("asset", "d", F.col("v").cast("double").alias("x")))], keys=["asset", "d"], value="x", name="signal"), "signal")


@plans.query("conflict_haircut", _SERIES + f"""
    , m AS (SELECT *, round(c - avg(c) OVER (PARTITION BY d), 8) AS s, round(v - avg(v) OVER (PARTITION BY d), 8) AS o FROM p)
    SELECT {_KEY}, round(s * CASE WHEN sign(s) * sign(o) < 0 THEN 1 - 0.5::DOUBLE * least(abs(o) / 2, 1) ELSE 1 END, 6) AS signal FROM m""")
def conflict_haircut(spark, folder):
    day = Window.partitionBy("d")
    rows = series(spark, folder).withColumn("s", F.round(F.col("c") - F.avg("c").over(day), 8)).withColumn("o", F.round(F.col("v") - F.avg("v").over(day), 8))
    return _shown(W.haircut(rows, signal="s", outlook="o", share=0.5, scale=2.0, name="signal"), "signal")


@plans.query("causal_population_z", """
    WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS t FROM events),
    z AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(CASE WHEN n >= 50 THEN 100 * (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END END, 3) AS z FROM z""")
def causal_population_z(spark, folder):
    rows = W.causal_z(load(spark, folder, "events").select("event_id", "event_type", "value", "ts"), key="event_type", time="ts", fields={"value": 1}, name="z", least=50, population=True)
    return rows.select("event_id", F.round(100 * F.col("z"), 3).alias("z"))


_RECENT = """
    WITH s AS (SELECT signal_id, source, score, date_trunc('day', min(loaded_at)) AS t FROM p_plus20_current WHERE source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, signal_id) AS k FROM s), f AS (SELECT *, min(k) OVER (PARTITION BY source, t) AS first FROM n)
    SELECT signal_id, count(b.score) AS prior_count, round(CASE WHEN count(b.score) >= 20 THEN quantile_cont(b.score, 0.9::DOUBLE) END, 6) AS threshold,
      coalesce(count(b.score) >= 20 AND a.score >= quantile_cont(b.score, 0.9::DOUBLE), false) AS selected
    FROM (SELECT signal_id, source, score, first FROM f) a LEFT JOIN (SELECT source, score, k FROM f) b ON b.source = a.source AND b.k < a.first AND b.k >= a.first - 40 GROUP BY signal_id, a.score
"""


@plans.query("lookback_top_fraction", _RECENT)
def lookback_top_fraction(spark, folder):
    """Signals judged by the last 40 of earlier days."""
    signals = load(spark, folder, "p_plus20_current").where("not isnan(score)").groupBy("signal_id", "source", "score").agg(F.date_trunc("day", F.min("loaded_at")).alias("t"))
    found = W.lookback_threshold(signals, key="source", time="t", ident="signal_id", score="score", fraction=0.1, warmup=20, lookback=40)
    return found.select("signal_id", F.col("prior_count").cast("long").alias("prior_count"), F.round("threshold", 6).alias("threshold"), "selected")


_CONTRACTS = "WITH k AS (SELECT l_returnflag AS good, date_trunc('month', l_shipdate)::DATE AS d, l_linenumber AS contract, last_day(date_trunc('month', l_shipdate)::DATE + INTERVAL 1 MONTH * l_linenumber) AS expiry, avg(l_extendedprice / l_quantity) AS c FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"


def _contracts(spark, folder):
    rows = load(spark, folder, "lineitem").where("l_quantity > 0").withColumn("d", F.trunc(F.to_date("l_shipdate"), "month"))
    rows = rows.withColumn("expiry", F.last_day(F.add_months("d", F.col("l_linenumber").cast("int"))))
    return rows.groupBy(F.col("l_returnflag").alias("good"), "d", F.col("l_linenumber").alias("contract"), "expiry").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("c"))


@plans.query("contract_carry", _CONTRACTS + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY good, d ORDER BY expiry) AS n FROM k WHERE expiry - d >= 28), w AS (SELECT good, d, max(c) FILTER (n = 1) AS f, max(c) FILTER (n = 2) AS g, max(expiry) FILTER (n = 2) - max(expiry) FILTER (n = 1) AS gap FROM r GROUP BY good, d)
    SELECT good, strftime(d, '%Y-%m-%d') AS day, round(ln(f / g) * 365.25::DOUBLE / gap, 6) AS carry FROM w WHERE gap > 0""")
def contract_carry(spark, folder):
    found = X.carry(_contracts(spark, folder), key="good", day="d", expiry="expiry", price="c", least_days=28)
    return found.select("good", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("carry", 6).alias("carry"))


@plans.query("contract_returns", _CONTRACTS + """
    , f AS (SELECT good, d, arg_min(contract, expiry) AS contract, arg_min(c, expiry) AS c, lead(d) OVER (PARTITION BY good ORDER BY d) AS next FROM k WHERE expiry - d >= 28 GROUP BY good, d)
    SELECT f.good, strftime(f.d, '%Y-%m-%d') AS day, round(n.c / f.c - 1, 6) AS ret, f.contract - 1 <> g.contract AS rolled FROM f LEFT JOIN k n ON n.good = f.good AND n.d = f.next AND n.contract = f.contract - date_diff('month', f.d, f.next) LEFT JOIN f g ON g.good = f.good AND g.d = f.next""")
def contract_returns(spark, folder):
    """The front contract held to the next observation of the same contract; a contract is one expiry."""
    found = X.same_contract_returns(_contracts(spark, folder), key="good", day="d", contract="expiry", expiry="expiry", price="c", least_days=28)
    return found.select("good", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("ret", 6).alias("ret"), "rolled")


@plans.query("week_endings", "SELECT event_type, strftime(ts::DATE + ((5 - isodow(ts::DATE) + 7) % 7)::INTEGER, '%Y-%m-%d') AS week, CASE WHEN count(DISTINCT ts::DATE) >= 4 THEN round(sum(value), 4) END AS total, round(min(value), 4) AS lowest FROM events GROUP BY 1, 2")
def week_endings(spark, folder):
    """Weeks that end on Friday; a sum needs four days."""
    rows = load(spark, folder, "events").withColumn("d", F.to_date("ts"))
    found = rows.groupBy("event_type", F.date_format(times.week_ending(F.col("d")), "yyyy-MM-dd").alias("week")).agg(F.countDistinct("d").alias("n"), F.sum("value").alias("t"), F.min("value").alias("m"))
    return found.select("event_type", "week", F.when(F.col("n") >= 4, F.round("t", 4)).alias("total"), F.round("m", 4).alias("lowest"))


@plans.query("interpolated_curve", """
    WITH a AS (SELECT user_id, epoch_us(ts) / 1000000 AS t, value AS y FROM events WHERE event_type = 'purchase'), q AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS t FROM events WHERE event_type = 'view'),
    b AS (SELECT event_id, q.t, max(a.t) FILTER (a.t <= q.t) AS t0, arg_max(a.y, a.t) FILTER (a.t <= q.t) AS y0, min(a.t) FILTER (a.t >= q.t) AS t1, arg_min(a.y, a.t) FILTER (a.t >= q.t) AS y1 FROM q LEFT JOIN a USING (user_id) GROUP BY event_id, q.t)
    SELECT event_id, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL THEN y0 WHEN t1 = t0 THEN y0 ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END, 4) AS value FROM b""")
def interpolated_curve(spark, folder):
    """Values between the anchors before and after, level beyond the ends."""
    events = load(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    anchors = events.where("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), F.col("value").alias("y"))
    found = X.interpolated(events.where("event_type = 'view'").select("event_id", "user_id", "t"), anchors, key="user_id", at="t", anchor="a", value="y", name="v")
    return found.select("event_id", F.round("v", 4).alias("value"))


@plans.query("bond_prices", """
    WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_tax AS y, l_discount AS c, l_linenumber AS n FROM lineitem),
    f AS (SELECT *, unnest(generate_series(1, n)) AS t FROM b), g AS (SELECT l_orderkey, l_linenumber, l_partkey, y, c, t, (100 * c + CASE WHEN t = n THEN 100 ELSE 0 END) / pow(1 + y, t) AS v FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, round(sum(v), 6) AS price, round(sum(t * v) / sum(v) / (1 + min(y)), 6) AS duration FROM g GROUP BY l_orderkey, l_linenumber, l_partkey, y, c""")
def bond_prices(spark, folder):
    """Lines as bonds of as many years as their number, with the discount as coupon and the tax as yield."""
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount").distinct()
    price, duration = X.bond(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(price, 6).alias("price"), F.round(duration, 6).alias("duration"))


@plans.query("monthly_positions", _SERIES + f"""
    , m AS (SELECT asset, date_trunc('month', d)::DATE AS month, arg_max(c, d) AS signal FROM p GROUP BY 1, 2), n AS (SELECT asset, month, lag(signal) OVER (PARTITION BY asset ORDER BY month) AS held, lead(month) OVER (PARTITION BY asset ORDER BY month) AS until FROM m)
    SELECT asset, strftime(d, '%Y-%m-%d') AS day, round(held, 6) AS held FROM p JOIN n USING (asset) WHERE d >= month AND (until IS NULL OR d < until)""")
def monthly_positions(spark, folder):
    """The last bar of a month decides the next month's position."""
    return _shown(X.monthly_held(series(spark, folder), key="asset", day="d", value="c", name="held"), "held")
