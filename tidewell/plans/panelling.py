"""Panels, cohorts, probes and audits as queries."""

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import times
from tidewell.operators import aggregates as A
from tidewell.operators import panels as P
from tidewell.operators import resolve as V
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()


def _rounded(rows, keys, *columns, digits=6):
    return rows.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


@plans.query("flows", """
    SELECT o_custkey, year(o_orderdate)::INTEGER AS year, round(sum(greatest(o_totalprice - 200000, 0)), 2) AS gain, count(*) AS n, round(arg_max(o_totalprice - 200000, o_orderkey), 2) AS last_delta, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS stages FROM orders GROUP BY 1, 2""")
def flows(spark, folder):
    rows = load(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", (F.col("o_totalprice") - 200_000).alias("d"), "o_orderstatus", "o_totalprice")
    found = P.flows(rows, keys=["o_custkey", "year"], order="o_orderkey", delta="d", weight="o_totalprice", stage="o_orderstatus")
    return found.select("o_custkey", "year", F.round("gain", 2).alias("gain"), "n", F.round("last_delta", 2).alias("last_delta"), "stages")


@plans.query("stage_changes", """
    WITH s AS (SELECT l_partkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_linenumber, round(q - lag(q) OVER (PARTITION BY l_partkey ORDER BY l_linenumber), 6) AS change FROM s""")
def stage_changes(spark, folder):
    rows = load(spark, folder, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    return _rounded(P.stage_changes(rows, keys=["l_partkey"], stage="l_linenumber", value="q", name="change"), ["l_partkey", "l_linenumber"], "change")


@plans.query("stage_windows", """
    WITH d AS (SELECT o_orderpriority AS k, o_orderdate::DATE AS d, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2), y AS (SELECT DISTINCT k, year(d) AS y FROM d),
    s AS (SELECT k, y || '-spring' AS stage, make_date(y, 3, 1) AS a, make_date(y, 5, 31) AS b FROM y UNION ALL SELECT k, y || '-summer', make_date(y, 5, 15), make_date(y, 8, 31) FROM y)
    SELECT d.k AS asset, stage, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, count(*) FILTER (v > 260) AS days FROM d JOIN s ON s.k = d.k AND d.d BETWEEN a AND b GROUP BY 1, 2""")
def stage_windows(spark, folder):
    daily = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    years = daily.select("asset", F.year("d").alias("y")).distinct()
    stage = lambda name, a, b: years.select("asset", F.concat("y", F.lit(f"-{name}")).alias("stage"), F.make_date("y", *map(F.lit, a)).alias("a"), F.make_date("y", *map(F.lit, b)).alias("b"))
    found = P.windowed_sums(daily, stage("spring", (3, 1), (5, 31)).unionByName(stage("summer", (5, 15), (8, 31))), key="asset", day="d", stage="stage", start="a", stop="b", value="v", above=260)
    return found.select("asset", "stage", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "days")


@plans.query("cohort_growth", """
    WITH u AS (SELECT c_nationkey AS g, o_custkey AS u, year(o_orderdate)::INTEGER AS y, sum(o_totalprice) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
    p AS (SELECT a.g, a.y, a.s, b.s AS t, row_number() OVER (PARTITION BY a.g, a.y ORDER BY b.s DESC, a.u) AS k FROM u a JOIN u b ON a.g = b.g AND a.u = b.u AND a.y = b.y + 2)
    SELECT g AS c_nationkey, y AS year, count(*) AS units, round(sqrt(sum(s) / sum(t)) - 1, 6) AS growth FROM p WHERE k <= 10 GROUP BY 1, 2""")
def cohort_growth(spark, folder):
    """Two-year growth of the ten largest customers of each nation at the start of the interval."""
    orders = load(spark, folder, "orders").join(load(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    rows = orders.groupBy("c_nationkey", "o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("s"))
    return P.cohort_growth(rows, group="c_nationkey", unit="o_custkey", period="year", size="s", back=2, k=10).withColumn("growth", F.round("growth", 6))


@plans.query("month_attribution", """
    WITH s AS (SELECT DISTINCT signal_id, strftime(exit_date, '%Y-%m') AS month, entry_price * (stock_return - 0.01::DOUBLE) AS a FROM p_plus20_current WHERE exit_date IS NOT NULL AND stock_return IS NOT NULL AND NOT isnan(stock_return)), m AS (SELECT month, sum(a) AS a FROM s GROUP BY month)
    SELECT month, round(a, 4) AS amount, round(a / sum(a) OVER (), 6) AS share, row_number() OVER (ORDER BY a DESC, month) = 1 AS largest FROM m""")
def month_attribution(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("exit_date is not null and stock_return is not null and not isnan(stock_return)").select("signal_id", F.date_format("exit_date", "yyyy-MM").alias("month"), "entry_price", "stock_return").distinct()
    found = P.attribution(rows, period="month", amount=F.col("entry_price") * (F.col("stock_return") - 0.01))
    return found.select("month", F.round("amount", 4).alias("amount"), F.round("share", 6).alias("share"), "largest")


@plans.query("available_ranks", """
    WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY m) AS n FROM m)
    SELECT o_custkey, strftime(m + INTERVAL 6 MONTH, '%Y-%m-%d') AS available, round(r / n - 0.5::DOUBLE, 6) AS signal FROM r""")
def available_ranks(spark, folder):
    """Ranks within the month, available half a year later."""
    rows = load(spark, folder, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    found = P.ranked_after(rows, entity="o_custkey", period="m", value="v", months=6, name="signal")
    return found.select("o_custkey", F.date_format("available", "yyyy-MM-dd").alias("available"), F.round("signal", 6).alias("signal"))


@plans.query("precedence_union", """
    WITH a AS (SELECT name, min(cik) AS cik FROM universe GROUP BY name), b AS (SELECT name, min(expected_cik) AS cik FROM alias_golden WHERE expected_cik IS NOT NULL GROUP BY name)
    SELECT name, cik, 'list' AS source FROM a UNION ALL SELECT name, cik, 'golden' FROM b WHERE name NOT IN (SELECT name FROM a)""")
def precedence_union(spark, folder):
    golden = load(spark, folder, "alias_golden").where("expected_cik is not null").select("name", F.col("expected_cik").alias("cik"))
    return P.with_precedence(("list", load(spark, folder, "universe").select("name", "cik")), ("golden", golden), key="name")


@plans.query("complete_roles", """
    SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS "view", round(avg(value) FILTER (event_type = 'error'), 6) AS error FROM events
    WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3""")
def complete_roles(spark, folder):
    found = P.complete_roles(load(spark, folder, "events"), key="user_id", role="event_type", value="value", roles=["click", "view", "error"])
    return _rounded(found, ["user_id"], "click", "view", "error")


@plans.query("flag_sensitivity", """
    WITH s AS (SELECT DISTINCT signal_id, source, stock_return AS y, terminal_history_gap AS f FROM p_plus20_current WHERE NOT isnan(coalesce(stock_return, 0)))
    SELECT source, count(y) AS n, count(*) FILTER (f AND y IS NOT NULL) AS flagged, round(avg(y), 6) AS mean, round(avg(y) FILTER (NOT coalesce(f, false)), 6) AS mean_without FROM s GROUP BY source""")
def flag_sensitivity(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("not isnan(coalesce(stock_return, 0))").select("signal_id", "source", "stock_return", "terminal_history_gap").distinct()
    found = P.sensitivity(rows, group="source", value="stock_return", flagged=F.col("terminal_history_gap"))
    return found.select("source", "n", "flagged", F.round("mean", 6).alias("mean"), F.round("mean_without", 6).alias("mean_without"))


@plans.query("probe_accuracy", """
    WITH a AS (SELECT DISTINCT answer_id, item, direction, confidence FROM answers WHERE probe = 'recall'), k AS (SELECT item, min(cohort) AS cohort, bool_or(winner) AS winner FROM answer_key GROUP BY item)
    SELECT cohort, count(*) AS answers, round(avg((direction = 'up' AND winner OR direction = 'down' AND NOT winner)::INTEGER), 6) AS right_share, round(avg(confidence), 6) AS confidence FROM a JOIN k USING (item) WHERE direction IS NOT NULL GROUP BY cohort""")
def probe_accuracy(spark, folder):
    """How often recalled directions are right, by cohort."""
    answers = load(spark, folder, "answers").where("probe = 'recall' and direction is not null").select("answer_id", "item", "direction", "confidence").distinct()
    key = load(spark, folder, "answer_key").groupBy("item").agg(F.min("cohort").alias("cohort"), F.bool_or("winner").alias("winner"))
    right = ((F.col("direction") == "up") & F.col("winner")) | ((F.col("direction") == "down") & ~F.col("winner"))
    found = answers.join(key, "item").groupBy("cohort").agg(F.count(F.lit(1)).alias("answers"), F.avg(right.cast("int")).alias("right_share"), F.avg("confidence").alias("confidence"))
    return found.select("cohort", "answers", F.round("right_share", 6).alias("right_share"), F.round("confidence", 6).alias("confidence"))


@plans.query("monthly_medians", "SELECT source, strftime(entry_date, '%Y-%m') AS month, count(*) AS n, round(median(downside_probability), 6) AS median FROM (SELECT DISTINCT signal_id, source, entry_date, downside_probability FROM p_plus20_current WHERE entry_date IS NOT NULL) GROUP BY 1, 2")
def monthly_medians(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("entry_date is not null").select("signal_id", "source", "entry_date", "downside_probability").distinct()
    return rows.groupBy("source", F.date_format("entry_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("downside_probability"), 6).alias("median"))


@plans.query("flag_buckets", """
    WITH c AS (SELECT l_orderkey, sum((l_returnflag = 'R')::INTEGER) AS flags, max(l_discount) AS d FROM lineitem GROUP BY 1) SELECT least(flags, 3)::INTEGER AS flags, count(*) AS n, round(exp(sum(ln(1 + d / 1000))) - 1, 6) AS multiple FROM c GROUP BY 1""")
def flag_buckets(spark, folder):
    """Orders by number of flagged lines, with a compounded multiple."""
    cases = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("flags"), F.max("l_discount").alias("d"))
    return cases.groupBy(F.least("flags", F.lit(3)).cast("int").alias("flags")).agg(F.count(F.lit(1)).alias("n"), F.round(A.compounded(F.col("d") / 1000), 6).alias("multiple"))


@plans.query("latest_valid_stage", """
    WITH e AS (SELECT *, value >= 30 AS ok FROM events), p AS (SELECT event_id, value, ok, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT event_id, CASE WHEN NOT ok THEN 'poor' WHEN before IS NULL THEN 'first' WHEN value - before > 40 THEN 'jump' WHEN value - before > 5 THEN 'growth' WHEN value - before < -5 THEN 'decline' ELSE 'steady' END AS stage FROM p""")
def latest_valid_stage(spark, folder):
    """Labels by the change from the last valid row, the first rule that holds."""
    from tidewell.operators import windows as W

    events = load(spark, folder, "events").select("event_id", "user_id", "value")
    rows = W.last_valid(events, key="user_id", order="event_id", valid=F.col("value") >= 30, value="value", name="before")
    change = F.col("value") - F.col("before")
    stage = F.when(F.col("value") < 30, "poor").when(F.col("before").isNull(), "first").when(change > 40, "jump").when(change > 5, "growth").when(change < -5, "decline").otherwise("steady")
    return rows.select("event_id", stage.alias("stage"))


@plans.query("band_ratios", """
    WITH b AS (SELECT vec_id, embedding[1:8] AS r, embedding[9:16] AS n FROM embeddings), x AS (SELECT vec_id, list_transform(list_zip(r, n), lambda p: CASE WHEN p[1] + p[2] = 0 THEN NULL ELSE (p[2]::DOUBLE - p[1]) / (p[1]::DOUBLE + p[2]) END) AS i FROM b)
    SELECT vec_id, round(list_avg(i), 4) AS mean, len(list_filter(i, lambda v: v > 0.2::DOUBLE)) / len(list_filter(i, lambda v: v IS NOT NULL))::DOUBLE AS share FROM x""")
def band_ratios(spark, folder):
    """Normalised differences of two bands held as arrays: their mean and the share above a bound."""
    rows = load(spark, folder, "embeddings")
    double = lambda a: F.transform(a, lambda v: v.cast("double"))
    red, near = double(F.slice("embedding", 1, 8)), double(F.slice("embedding", 9, 8))
    index = F.filter(F.zip_with(red, near, lambda r, n: (n - r) / F.nullif(n + r, F.lit(0.0))), lambda v: v.isNotNull())
    mean = F.aggregate(index, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(index), F.lit(0))
    return rows.select("vec_id", F.round(mean, 4).alias("mean"), (F.size(F.filter(index, lambda v: v > 0.2)) / F.nullif(F.size(index), F.lit(0))).alias("share"))


@plans.query("open_intervals", """
    WITH v AS (SELECT DISTINCT security_id, version_id, valid_from, valid_to FROM security_versions) SELECT DISTINCT case_id, version_id FROM experiment_cases c JOIN v USING (security_id) WHERE prediction_as_of > valid_from AND (valid_to IS NULL OR prediction_as_of <= valid_to)""")
def open_intervals(spark, folder):
    """Versions whose interval, open at its start and closed at its end, holds the time of a case."""
    versions = load(spark, folder, "security_versions").select("security_id", "version_id", "valid_from", "valid_to").distinct()
    cases = load(spark, folder, "experiment_cases").select("case_id", "security_id", "prediction_as_of")
    inside = times.in_open_interval(F.col("prediction_as_of"), F.col("valid_from"), F.col("valid_to"))
    return cases.join(versions, "security_id").where(inside).select("case_id", "version_id").distinct()


@plans.query("legal_suffixes", "SELECT DISTINCT name, list_has_any(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), [" + ", ".join(f"'{w}'" for w in T.LEGAL_WORDS) + "]) AS legal FROM universe")
def legal_suffixes(spark, folder):
    return load(spark, folder, "universe").select("name", V.has_legal_word(F.col("name")).alias("legal")).distinct()


@plans.query("smallest_keys", "SELECT name, min(cik::BIGINT) AS cik, arg_min(ticker, {'c': cik::BIGINT, 't': ticker}) AS ticker FROM universe GROUP BY name")
def smallest_keys(spark, folder):
    """Of the keys of a name the least as a number, then the first ticker."""
    order = F.struct(F.col("cik").cast("long").alias("c"), "ticker")
    found = load(spark, folder, "universe").groupBy("name").agg(F.min(order).alias("k"))
    return found.select("name", F.col("k.c").alias("cik"), "k.ticker")


@plans.query("resampled_surprise", """
    WITH s AS (SELECT DISTINCT signal_id, source, stock_return AS y FROM p_plus20_current WHERE stock_return IS NOT NULL AND NOT isnan(stock_return)), m AS (SELECT source, avg(y) AS m, count(*) AS n, stddev_samp(y) AS sd FROM s GROUP BY source), w AS (SELECT avg(y) AS m FROM s)
    SELECT source, n, round((m.m - w.m) / (sd / sqrt(n)), 4) AS z FROM m, w WHERE n > 1""")
def resampled_surprise(spark, folder):
    """How far each source's mean lies from that of all, in its own standard errors."""
    rows = load(spark, folder, "p_plus20_current").where("stock_return is not null and not isnan(stock_return)").select("signal_id", "source", "stock_return").distinct()
    whole = rows.agg(F.avg("stock_return").alias("w"))
    each = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("stock_return").alias("m"), F.stddev_samp("stock_return").alias("sd")).where("n > 1")
    return each.crossJoin(F.broadcast(whole)).select("source", "n", F.round((F.col("m") - F.col("w")) / (F.col("sd") / F.sqrt("n")), 4).alias("z"))  # one row
