"""Aggregations, top-k, interval sequences and account simulation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators import intervals as I
from tidewell.operators import portfolio as P
from tidewell.operators import topk as K
from tidewell.plans.registry import Registry
from tidewell.plans.windowing import panel
from tidewell.sources import load

plans = Registry()


@plans.query("pricing_summary", """
    SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 1) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_discount), 6) AS discount
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, folder):
    return load(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 1).alias("quantity"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@plans.query("two_level_composite", """
    WITH i AS (SELECT user_id, event_type, avg(value) AS m, bool_or(value > 90) AS red FROM events GROUP BY 1, 2)
    SELECT user_id, round(avg(m), 6) AS mean_of_means, count(*) FILTER (red) AS red_groups, count(*) AS groups, least(count(*) FILTER (red), 4) AS bucket FROM i GROUP BY user_id""")
def two_level_composite(spark, folder):
    rows = A.two_level(load(spark, folder, "events"), outer="user_id", inner="event_type", value="value", red=F.col("value") > 90)
    return rows.withColumn("mean_of_means", F.round("mean_of_means", 6)).withColumn("bucket", F.col("bucket").cast("long"))


@plans.query("upper_median", """
    SELECT l_suppkey, x AS upper_median FROM (SELECT l_suppkey, l_quantity AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    WHERE k = n // 2 + 1""")
def upper_median(spark, folder):
    return A.upper_median(load(spark, folder, "lineitem"), key="l_suppkey", value="l_quantity", name="upper_median")


@plans.query("with_total", """
    SELECT l_returnflag, count(*) AS lines, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1
    UNION ALL SELECT 'all', count(*), round(avg(l_quantity), 6) FROM lineitem""")
def with_total(spark, folder):
    return A.with_total(load(spark, folder, "lineitem"), "l_returnflag", F.count(F.lit(1)).alias("lines"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@plans.query("compounded_months", """
    SELECT event_type, strftime(ts, '%Y-%m') AS month, round(product(1 + value / 1000000) - 1, 6) AS compounded FROM events GROUP BY 1, 2""")
def compounded_months(spark, folder):
    return load(spark, folder, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(A.compounded(F.col("value") / 1_000_000), 6).alias("compounded"))


@plans.query("weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS discount FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark, folder):
    return load(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(A.weighted_mean("l_discount", "l_extendedprice"), 6).alias("discount"))


@plans.query("share_within", """
    WITH s AS (SELECT p_brand, p_type, sum(p_retailprice) AS t FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, round(t, 2) AS total, round(t / sum(t) OVER (PARTITION BY p_brand), 6) AS share FROM s""")
def share_within(spark, folder):
    rows = A.share_within(load(spark, folder, "part"), group="p_brand", part="p_type", value="p_retailprice")
    return rows.select("p_brand", "p_type", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@plans.query("consensus", """
    SELECT item, CASE WHEN min(direction) = max(direction) THEN min(direction) ELSE 'uncertain' END AS consensus, count(*) AS votes
    FROM (SELECT DISTINCT answer_id, item, direction FROM answers WHERE direction IS NOT NULL) GROUP BY item""")
def consensus(spark, folder):
    votes = load(spark, folder, "answers").where("direction is not null").select("answer_id", "item", "direction").distinct()
    return A.consensus(votes, key="item", label="direction")


@plans.query("clusters", """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS actors, datediff('day', min(o_orderdate), max(o_orderdate)) AS span FROM orders GROUP BY 1
    HAVING count(DISTINCT o_orderpriority) >= 2 AND datediff('day', min(o_orderdate), max(o_orderdate)) <= 1500""")
def clusters(spark, folder):
    rows = A.clusters(load(spark, folder, "orders"), key="o_custkey", actor="o_orderpriority", day="o_orderdate", span_days=1500)
    return rows.withColumn("span", F.col("span").cast("long"))


@plans.query("pivoted_roles", """
    SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R"
    FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def pivoted_roles(spark, folder):
    rows = A.pivoted(load(spark, folder, "lineitem"), key="l_suppkey", role="l_returnflag", roles=("A", "N", "R"), value="l_quantity", complete=True)
    return rows.select("l_suppkey", *[F.round(c, 6).alias(c) for c in "ANR"])


@plans.query("calibration_buckets", """
    SELECT least(floor(value / 100 * 10), 9)::INTEGER AS bucket, count(*) AS n, round(avg(value / 100), 6) AS mean_p, round(avg((event_type = 'error')::INTEGER), 6) AS hit_rate FROM events GROUP BY 1""")
def calibration_buckets(spark, folder):
    rows = load(spark, folder, "events").select((F.col("value") / 100).alias("p"), (F.col("event_type") == "error").cast("int").alias("y"))
    return A.bucketed(rows, probability="p", outcome="y").select("bucket", "n", F.round("mean_p", 6).alias("mean_p"), F.round("hit_rate", 6).alias("hit_rate"))


@plans.query("priority_events", """
    SELECT l_orderkey, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS first_role, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS roles,
           bool_or(l_quantity > 25) AS any_flag, bool_and(l_quantity > 25) AS all_flag FROM lineitem GROUP BY 1""")
def priority_events(spark, folder):
    return A.priority_event(load(spark, folder, "lineitem"), keys=["l_orderkey"], role="l_returnflag", ranking=("R", "A", "N"), flag=F.col("l_quantity") > 25)


@plans.query("coverage_by_form", """
    WITH f AS (SELECT DISTINCT filing_id, form, report_date, source_url FROM filing_records)
    SELECT form, count(*) AS filings, count(report_date) AS with_report, round(count(source_url) / count(*), 6) AS url_share FROM f GROUP BY form""")
def coverage_by_form(spark, folder):
    rows = load(spark, folder, "filing_records").select("filing_id", "form", "report_date", "source_url").distinct()
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("filings"), F.count("report_date").alias("with_report"), F.round(F.count("source_url") / F.count(F.lit(1)), 6).alias("url_share"))


@plans.query("tagged_union", """
    SELECT 'filing' AS lane, form, count(*) AS n FROM filing_records GROUP BY form UNION ALL SELECT 'document', form, count(*) FROM documents GROUP BY form
    UNION ALL SELECT 'probe', form, count(*) FROM answer_key GROUP BY form""")
def tagged_union(spark, folder):
    lanes = {"filing": "filing_records", "document": "documents", "probe": "answer_key"}
    parts = [load(spark, folder, table).select(F.lit(lane).alias("lane"), "form") for lane, table in lanes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lane", "form").agg(F.count(F.lit(1)).alias("n"))


@plans.query("merged_intervals", """
    WITH w AS (SELECT o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 20 AS b, o_orderpriority AS p FROM orders),
    m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w),
    k AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT o_custkey, strftime(min(a), '%Y-%m-%d') AS a, strftime(max(b), '%Y-%m-%d') AS b, string_agg(DISTINCT p, '+' ORDER BY p) AS labels, count(*) AS spans FROM k GROUP BY o_custkey, g""")
def merged_intervals(spark, folder):
    spans = load(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("b"), "o_orderpriority")
    rows = I.merged(spans, key="o_custkey", start="a", stop="b", label="o_orderpriority")
    return rows.select("o_custkey", F.date_format("a", "yyyy-MM-dd").alias("a"), F.date_format("b", "yyyy-MM-dd").alias("b"), "labels", "spans")


@plans.query("cooldown_180", """
    WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, min(o_orderkey) AS i FROM orders GROUP BY 1, 2),
    s AS (SELECT k, min(d) AS d FROM o GROUP BY k UNION ALL SELECT s.k, (SELECT min(o.d) FROM o WHERE o.k = s.k AND o.d >= s.d + 180) AS d FROM s WHERE s.d IS NOT NULL)
    SELECT s.k::VARCHAR AS o_custkey, strftime(s.d, '%Y-%m-%d') AS day, o.i AS o_orderkey FROM s JOIN o ON o.k = s.k AND o.d = s.d""")
def cooldown_180(spark, folder):
    rows = I.cooldown(load(spark, folder, "orders"), key="o_custkey", day="o_orderdate", ident="o_orderkey", days=180)
    return rows.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")


@plans.query("slots_taken", """
    WITH RECURSIVE o AS (SELECT o_orderpriority AS k, o_orderkey AS i, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE, o_orderkey) AS n FROM orders),
    s AS (SELECT k, i, n, [d + 90] AS ends, true AS taken FROM o WHERE n = 1 UNION ALL
      SELECT k, i, n, CASE WHEN len(live) < 20 THEN list_append(live, d + 90) ELSE live END, len(live) < 20 FROM (SELECT o.k, o.i, o.n, o.d, list_filter(s.ends, lambda e: e > o.d) AS live FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1))
    SELECT k AS o_orderpriority, i AS o_orderkey, taken FROM s""")
def slots_taken(spark, folder):
    return I.slots(load(spark, folder, "orders"), lane="o_orderpriority", day="o_orderdate", ident="o_orderkey", hold_days=90, capacity=20)


@plans.query("top_fraction", """
    WITH s AS (SELECT DISTINCT signal_id, score FROM p_plus20_current WHERE score IS NOT NULL AND NOT isnan(score)),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, signal_id) AS k, count(*) OVER () AS n FROM s)
    SELECT signal_id, round(score, 6) AS score FROM r WHERE k <= ceil(n * 0.1::DOUBLE - 0.000000001)""")
def top_fraction(spark, folder):
    signals = load(spark, folder, "p_plus20_current").where("score is not null and not isnan(score)").select("signal_id", "score").distinct()
    return K.top_fraction(signals, score="score", ident="signal_id", fraction=0.1).select("signal_id", F.round("score", 6).alias("score"))


@plans.query("top_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3""")
def top_per_group(spark, folder):
    rows = K.top_per_group(load(spark, folder, "lineitem"), group="l_suppkey", order=[F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], k=3)
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber")


@plans.query("capped_share", """
    WITH n AS (SELECT greatest(1, floor(count(*) * 0.02::DOUBLE)) AS k FROM orders)
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), n WHERE r <= k""")
def capped_share(spark, folder):
    rows = K.capped_share(load(spark, folder, "orders"), group="o_orderpriority", order=[F.desc("o_totalprice"), "o_orderkey"], share=0.02)
    return rows.select("o_orderkey")


@plans.query("greedy_cap", """
    WITH RECURSIVE o AS (SELECT o_orderpriority AS k, o_orderkey AS i, o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    s AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS n, 0 AS f, 0 AS q, 0 AS p, true AS kept FROM o WHERE n = 1 UNION ALL
      SELECT k, i, n, f + (kept AND g = 'F')::INTEGER, q + (kept AND g = 'O')::INTEGER, p + (kept AND g = 'P')::INTEGER, kept FROM (SELECT o.k, o.i, o.n, o.g, s.f, s.q, s.p,
        coalesce((CASE o.g WHEN 'F' THEN s.f WHEN 'O' THEN s.q WHEN 'P' THEN s.p END + 1) / (s.f + s.q + s.p + 1)::DOUBLE <= 0.4::DOUBLE, true) AS kept FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1))
    SELECT k AS o_orderpriority, i AS o_orderkey, kept FROM s WHERE n > 0""")
def greedy_cap(spark, folder):
    return K.greedy_cap(load(spark, folder, "orders"), lane="o_orderpriority", order="o_orderdate", ident="o_orderkey", group="o_orderstatus", cap=0.4)


@plans.query("leave_one_out", """
    WITH s AS (SELECT event_type, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS m FROM events WINDOW w AS (PARTITION BY event_type))
    SELECT event_type, round(min(m), 6) AS lowest, round(max(m), 6) AS highest FROM s GROUP BY event_type""")
def leave_one_out(spark, folder):
    rows = K.leave_one_out(load(spark, folder, "events"), group="event_type", value="value")
    return rows.select("event_type", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@plans.query("stratified_sample", """
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 20""")
def stratified_sample(spark, folder):
    return K.stratified(load(spark, folder, "documents").select("source", "doc_id"), group="source", ident="doc_id", k=20, seed=7)


@plans.query("chronological_split", """
    WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def chronological_split(spark, folder):
    rows = K.chronological_split(load(spark, folder, "events").select("event_type", "ts", "event_id"), group="event_type", order=["ts", "event_id"], share=0.7)
    return rows.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"))


@plans.query("latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) USING (o_custkey, o_orderdate) GROUP BY 1")
def latest_per_key(spark, folder):
    return load(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@plans.query("account_simulation")
def account_simulation(spark, folder):
    w = Window.partitionBy("asset").orderBy("d")
    days = panel(spark, folder).withColumn("r", F.coalesce(F.col("v") / F.nullif(F.lag("v").over(w), F.lit(0.0)) - 1, F.lit(0.0)) / 100)
    return P.simulated(days.withColumn("s", F.col("n") >= 60), lane="asset", day="d", ret="r", signal="s", slots=5, hold=5, cost=0.0025)


def _account(spark, folder):
    signals = load(spark, folder, "p_plus20_current").where("entry_date is not null and exit_date is not null and entry_price > 0 and exit_price > 0")
    signals = signals.groupBy("source", "signal_id").agg(*[F.min(c).alias(c) for c in ("ticker", "entry_date", "entry_price", "exit_date", "exit_price")])
    both = [signals.select("ticker", F.col(f"{k}_date").alias("day"), F.col(f"{k}_price").alias("close")) for k in ("entry", "exit")]
    closes = both[0].unionByName(both[1]).groupBy("ticker", "day").agg(F.avg("close").alias("close"))
    days = closes.select("day").distinct()
    calendar = signals.select("source").distinct().join(days).select("source", "day", (F.sin(F.unix_date("day").cast("double")) / 200).alias("bench"), F.when(F.dayofweek("day") == 2, 2.0 + F.month("day") / 10).alias("bill"))  # a few lanes by one series of days
    trades = signals.select("source", F.col("signal_id").alias("trade_id"), "ticker", F.col("entry_date").alias("entry_day"), "entry_price", F.col("exit_date").alias("exit_day"))
    return P.account(calendar, trades, closes, lane="source", ticker="ticker", slots=10, cost_bps=25.0)


@plans.query("account_days")
def account_days(spark, folder):
    """An account for each source with ten places, marked where prices are known; a fold, tested against a plain walk."""
    return _account(spark, folder)[0].select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 8).alias(c) for c in ("nav", "ret", "matched", "excess")], "open")


@plans.query("account_ledger")
def account_ledger(spark, folder):
    """The trades of those accounts: taken or not, and what they brought."""
    return _account(spark, folder)[1].withColumn("net", F.round("net", 8))


@plans.query("cohort_returns", """
    WITH p AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS d, avg(o_totalprice) / 997 AS c FROM orders GROUP BY 1, 2), r AS (SELECT ticker, d, tanh(c / 100 - 1.5::DOUBLE) * 0.99 AS r, row_number() OVER (PARTITION BY ticker ORDER BY d) AS n, count(*) OVER (PARTITION BY ticker) AS m FROM p),
    s AS (SELECT o_orderstatus AS lane, o_orderpriority AS ticker, o_orderdate::DATE AS e FROM orders WHERE o_orderkey % 5 = 0), f AS (SELECT lane, s.ticker, e, (SELECT min(n) FROM r WHERE r.ticker = s.ticker AND r.d >= e) AS n, (SELECT max(n) FROM r WHERE r.ticker = s.ticker) AS m FROM s)
    SELECT lane, strftime(r.d, '%Y-%m-%d') AS day, count(*) AS n, round(avg(greatest(-0.95::DOUBLE, r.r - 0.02::DOUBLE / 252)) + 0.3::DOUBLE * 0.001::DOUBLE, 6) AS ret FROM f JOIN r ON r.ticker = f.ticker AND r.n > f.n AND r.n <= f.n + 20 WHERE f.n + 20 <= f.m GROUP BY lane, r.d""")
def cohort_returns(spark, folder):
    """Overlapping positions of 20 rows by order status, borrowed and hedged; the sample of orders is the signal."""
    orders = load(spark, folder, "orders")
    closes = orders.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 997).alias("c"))
    returns = closes.select("ticker", "day", (F.tanh(F.col("c") / 100 - 1.5) * 0.99).alias("ret"), F.lit(0.001).alias("bench"))
    signals = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderstatus").alias("lane"), F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("entry_day"))
    found = P.cohorts(signals, returns, lane="lane", horizon=20, borrow=0.02, hedge=0.3)
    return found.select("lane", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("ret", 6).alias("ret"))


@plans.query("net_returns", """
    WITH p AS (SELECT event_type AS asset, ts::DATE AS d, sum(value) / 1000 AS v FROM events GROUP BY 1, 2),
    w AS (SELECT asset, d, v / sum(v) OVER (PARTITION BY d) AS w, v / nullif(lag(v) OVER (PARTITION BY asset ORDER BY d), 0) - 1 AS r FROM p),
    h AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY asset ORDER BY d), 0) AS q FROM w)
    SELECT strftime(d, '%Y-%m-%d') AS day, round(sum(q * r), 6) AS gross, round(sum(abs(w - q)), 6) AS turnover, round(sum(q * r) - sum(abs(w - q)) * 10 / 1e4, 6) AS net FROM h GROUP BY d""")
def net_returns(spark, folder):
    w = Window.partitionBy("asset").orderBy("d")
    rows = panel(spark, folder).withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("d"))).withColumn("r", F.col("v") / F.nullif(F.lag("v").over(w), F.lit(0.0)) - 1)
    found = P.net_returns(rows, asset="asset", date="d", weight="w", ret="r", cost_bps=10)
    return found.select(F.date_format("d", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in ("gross", "turnover", "net")])
