"""Joins: as-of in both directions, offsets, intervals, fallbacks, owners, dimensions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import bitemporal as B
from tidewell.operators import joins as J
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

_ASOF = """
    WITH s AS (SELECT DISTINCT signal_id, cik, loaded_at FROM p_plus20_current), f AS (SELECT DISTINCT lpad(cik, 10, '0') AS cik, loaded_at FROM filing_records)
    SELECT s.signal_id, epoch_us(s.loaded_at) AS loaded, {pick}(epoch_us(f.loaded_at)) AS filed FROM s LEFT JOIN f ON f.cik = s.cik AND f.loaded_at {op} s.loaded_at
    GROUP BY s.signal_id, s.loaded_at, s.cik"""


def _sides(spark, folder):
    signals = load(spark, folder, "p_plus20_current").select("signal_id", "cik", "loaded_at").distinct()
    filings = load(spark, folder, "filing_records").select(F.lpad("cik", 10, "0").alias("cik"), F.col("loaded_at").alias("filed_at")).distinct()
    return signals, filings


@plans.query("asof_backward", _ASOF.format(pick="max", op="<="))
def asof_backward(spark, folder):
    found = J.asof(*_sides(spark, folder), key="cik", left_time="loaded_at", right_time="filed_at", values=[])
    return found.select("signal_id", F.unix_micros("loaded_at").alias("loaded"), F.unix_micros("matched_filed_at").alias("filed"))


@plans.query("asof_forward_strict", _ASOF.format(pick="min", op=">"))
def asof_forward_strict(spark, folder):
    found = J.asof(*_sides(spark, folder), key="cik", left_time="loaded_at", right_time="filed_at", values=[], direction="forward", exact=False)
    return found.select("signal_id", F.unix_micros("loaded_at").alias("loaded"), F.unix_micros("matched_filed_at").alias("filed"))


@plans.query("offset_return", """
    SELECT event_id, value, later FROM (SELECT event_id, value, lead(value, 5) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events) WHERE later IS NOT NULL""")
def offset_return(spark, folder):
    rows = J.offset_rows(load(spark, folder, "events").select("event_id", "user_id", "value"), key="user_id", order="event_id", value="value", rows=5, name="later")
    return rows.where("later is not null").select("event_id", "value", "later")


@plans.query("interval_membership", """
    WITH w AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND o.o_orderdate BETWEEN w.a AND w.b)""")
def interval_membership(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    spans = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("day").alias("a"), F.date_add("day", 30).alias("b"))
    return J.within(orders.select("o_orderkey", "o_custkey", "day"), spans, key="o_custkey", point="day", start="a", stop="b").select("o_orderkey")


@plans.query("interval_filter_out", """
    WITH w AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND o.o_orderdate BETWEEN w.a AND w.b)""")
def interval_filter_out(spark, folder):
    return load(spark, folder, "orders").select("o_orderkey").join(interval_membership(spark, folder), "o_orderkey", "left_anti")


@plans.query("fallback_join", """
    WITH l AS (SELECT k, min(cik) AS v FROM (SELECT ticker AS k, cik FROM universe UNION ALL SELECT name, cik FROM universe) GROUP BY k)
    SELECT DISTINCT answer_id, coalesce(a.v, b.v) AS cik FROM answers LEFT JOIN l a ON a.k = ticker_guess LEFT JOIN l b ON b.k = company_guess""")
def fallback_join(spark, folder):
    universe = load(spark, folder, "universe")
    keys = universe.select(F.col("ticker").alias("k"), "cik").unionByName(universe.select(F.col("name").alias("k"), "cik"))
    guesses = load(spark, folder, "answers").select("answer_id", "ticker_guess", "company_guess").distinct()
    return J.with_fallback(guesses, keys, "ticker_guess", "company_guess", "k", "cik", "found").select("answer_id", F.col("found").alias("cik"))


@plans.query("owner_mismatch", """
    SELECT DISTINCT signal_id, ticker FROM p_plus20_current p WHERE EXISTS (SELECT 1 FROM universe u WHERE u.ticker = p.ticker)
    AND NOT EXISTS (SELECT 1 FROM universe u WHERE u.ticker = p.ticker AND u.cik = p.cik)""")
def owner_mismatch(spark, folder):
    signals = load(spark, folder, "p_plus20_current").select("signal_id", "ticker", "cik").distinct()
    owners = load(spark, folder, "universe").select("ticker", "cik")
    return signals.join(owners.select("ticker"), "ticker", "left_semi").join(owners, ["ticker", "cik"], "left_anti").select("signal_id", "ticker")


@plans.query("neighbours_in_window", """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY datediff('day', DATE '1970-01-01', o_orderdate::DATE) RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) - 1 AS near FROM orders""")
def neighbours_in_window(spark, folder):
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("o_orderdate"))).rangeBetween(-7, 7)
    return load(spark, folder, "orders").select("o_orderkey", (F.count(F.lit(1)).over(w) - 1).alias("near"))


@plans.query("dimension_revenue", """
    SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""")
def dimension_revenue(spark, folder):
    t = lambda name: load(spark, folder, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(F.broadcast(places), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


@plans.query("shared_array_join", """
    WITH a AS (SELECT DISTINCT answer_id, item, unnest(alternates) AS name FROM answers)
    SELECT x.item, x.name, count(DISTINCT x.answer_id) AS answers FROM a x WHERE x.name IN (SELECT name FROM universe) GROUP BY x.item, x.name""")
def shared_array_join(spark, folder):
    names = load(spark, folder, "answers").select("answer_id", "item", F.explode("alternates").alias("name")).distinct()
    listed = load(spark, folder, "universe").select("name").distinct()
    return names.join(listed, "name", "left_semi").groupBy("item", "name").agg(F.countDistinct("answer_id").alias("answers"))


@plans.query("history_self_join", """
    WITH v AS (SELECT DISTINCT security_id, version_id, valid_from, valid_to, system_from FROM security_versions)
    SELECT security_id, count(*) AS versions, count(valid_to) AS closed FROM v GROUP BY security_id""")
def history_self_join(spark, folder):
    rows = B.history(load(spark, folder, "security_versions").select("security_id", "version_id", "valid_from", "valid_to", "system_from"), "security_id", "system_from")
    return rows.groupBy("security_id").agg(F.count(F.lit(1)).alias("versions"), F.count("valid_to").alias("closed"))
