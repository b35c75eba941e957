import random
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import text as T
from tidewell.operators import bitemporal as B
from tidewell.operators import bounded, intervals, joins, learning, portfolio, resampling, stats, topk, windows
from tidewell.streaming import hourly_counts

D0 = date(2020, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_running_quantile_equals_numpy(q):
    rng = random.Random(1)
    seen, mine = [], windows.RunningQuantile(q)
    for _ in range(400):
        x = rng.choice([rng.gauss(0, 5), float(rng.randrange(3))])
        seen.append(x)
        mine.add(x)
        assert mine.value == pytest.approx(np.quantile(seen, q))


def test_slots_cooldown_and_greedy_cap_equal_a_plain_walk(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), D0 + timedelta(days=rng.randrange(200)), i, rng.choice(["x", "y", None])) for i in range(300)] + [(None, D0, 900, "x"), ("a", None, 901, "x")]
    df = spark.createDataFrame(rows, "lane string, day date, id long, grp string")
    taken, kept, last, capped = {}, set(), {}, {}
    for lane in "ab":
        ends, held, total = [], {}, 0
        for _, d, i, g in sorted((r for r in rows if r[0] == lane and r[1]), key=lambda r: (r[1], r[2])):
            ends = [e for e in ends if e > d]
            taken[i] = len(ends) < 4
            if taken[i]:
                ends.append(d + timedelta(days=10))
            if lane not in last or (d - last[lane]).days >= 30:
                kept.add(i)
                last[lane] = d
            capped[i] = g is None or (held.get(g, 0) + 1) / (total + 1) <= 0.4
            if capped[i]:
                held[g], total = held.get(g, 0) + 1, total + 1
    assert {r["id"]: r["taken"] for r in intervals.slots(df, lane="lane", day="day", ident="id", hold_days=10, capacity=4).collect()} == taken
    assert {r["id"] for r in intervals.cooldown(df, key="lane", day="day", ident="id", days=30).collect()} == kept
    got = {r["id"]: r["kept"] for r in topk.greedy_cap(df.where("day is not null"), lane="lane", order="day", ident="id", group="grp", cap=0.4).collect()}
    assert got == capped


def test_account_pays_costs(spark):
    days = spark.createDataFrame([("p", D0 + timedelta(days=k), 0.1 if k == 1 else 0.0, k == 0) for k in range(4)], "lane string, day date, r double, s boolean")
    rows = portfolio.simulated(days, lane="lane", day="day", ret="r", signal="s", slots=1, hold=2, cost=0.01).orderBy("day").collect()
    assert [r["nav"] for r in rows] == pytest.approx([0.99, 1.089, 1.089 * 0.99, 1.089 * 0.99]) and [r["open"] for r in rows] == [1, 1, 0, 0]


def test_asof_ties_and_missing(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("z", 5, "c"), (None, 5, "d")], "key string, t int, name string")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 5, 2.0), ("k", 3, 0.5), ("k", None, 9.0)], "key string, u int, v double")
    run = lambda **o: {r["name"]: r["matched_v"] for r in joins.asof(left, right, key="key", left_time="t", right_time="u", values=["v"], **o).collect()}
    assert run() == {"a": 2.0, "b": None, "c": None, "d": None}
    assert run(exact=False)["a"] == 0.5
    assert run(direction="forward")["b"] == 0.5


def test_first_writer_wins_and_digest(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert [tuple(r) for r in B.append_missing(stored, new, ["k"]).collect()] == [("b", 3)]
    assert len(spark.range(1).select(B.digest(F.lit(None), F.lit("x"))).first()[0]) == 64


def test_broadcast_only_what_is_small(spark):
    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    for limit in (10, 1000):
        assert bounded.join_bounded(big, small, "k", "inner", max_rows=limit).count() == 50
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    cuts = bounded.hot_slices(rows, "k", "t", 100).collect()
    assert len(cuts) == 1 and 8 <= len(cuts[0]["bounds"]) <= 10
    assert bounded.hot_slices(rows, "k", "t", 5000) is None


def test_resampling_repeats_and_keeps_values(spark):
    rows = spark.range(200).select((F.col("id") % 10).alias("b"), "id", F.col("id").cast("double").alias("v"))
    one, two = (sorted(r["mean"] for r in resampling.moving_blocks(rows.withColumn("k", F.lit("all")), key="k", order="id", value="v", block=20, draws=50, seed=3).collect()) for _ in range(2))
    assert one == two and len(one) == 50 and abs(np.mean(one) - 99.5) < 12
    dealt = resampling.permuted_within(rows, block="b", ident="id", value="v", seed=1, name="x")
    assert dealt.groupBy("b").agg(F.sum("v") - F.sum("x")).where("`(sum(v) - sum(x))` <> 0").count() == 0
    assert dealt.where("v <> x").count() > 100


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.plain_text(F.lit("<style>x</style><p>A&amp;B</p><div>C <b>d</b></div>"))) == "A&B\nC d"
    assert one(T.normal_name(F.lit("The A&B Holdings, Inc. /DE/"))) == "a and b"
    assert one(T.largest_number(F.lit("About 46,200 of 7"))) == 46200 and one(T.largest_number(F.lit("none"))) is None
    assert one(T.embedded_json(F.lit('text {"a": 3} tail'), "a int")["a"]) == 3
    assert one(T.grounded(F.lit("two  Words here"), F.lit("so TWO words\nhere stand"))) and not one(T.grounded(F.lit("short"), F.lit("short")))
    assert one(N.renormalised([F.lit(None).cast("double"), F.lit(2.0)], [0.6, 0.4])) == 2.0
    assert one(N.growth(F.lit(121.0), F.lit(100.0), 2)) == pytest.approx(0.1) and one(N.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(N.vapour_pressure(F.lit(20.0))) == pytest.approx(2.338, abs=0.01)


def test_windows_on_a_stream(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = hourly_counts(stream).writeStream.format("memory").outputMode("complete").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    began = time.time()
    query.processAllAvailable()
    query.stop()
    assert time.time() - began < 100
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("hours")) == key(hourly_counts(events))


def plain_account(calendar, trades, closes, slots, bps):
    """The fold again, day by day over dictionaries."""
    navs, ledger, c = [], {}, bps / 1e4
    for lane in sorted({r[0] for r in calendar}):
        cash, places, total, bill = 1.0, {}, 1.0, 0.0
        for _, day, bench, quoted in sorted(r for r in calendar if r[0] == lane):
            rf = max(bill, 0) / 100 / 252
            cash *= 1 + rf
            before = sum(v[0] for v in places.values())
            for t in places.values():
                if (t[3], day) in closes:
                    t[0], t[2] = t[0] * closes[t[3], day] / t[2], closes[t[3], day]
            for i in [i for i, t in places.items() if day >= t[4]]:
                value, notional = places.pop(i)[:2]
                cash += value * (1 - c)
                ledger[i] = (True, value * (1 - c) / notional - 1)
            for _, i, ticker, entry, price, leave in sorted(t for t in trades if t[0] == lane and t[3] == day):
                size = min((cash + sum(v[0] for v in places.values())) / slots, cash)
                if len(places) < slots and size > 0:
                    cash -= size
                    places[i] = [size * (1 - c), size, price, ticker, leave]
                else:
                    ledger[i] = (False, None)
            now = cash + sum(v[0] for v in places.values())
            e = before / total
            navs.append((lane, day, now, e * bench + (1 - e) * rf))
            total, bill = now, bill if quoted is None else quoted
    return navs, ledger


def test_account_equals_a_plain_fold_on_many_lanes(spark):
    rng = random.Random(21)
    days = [D0 + timedelta(days=k) for k in range(120) if k % 7 < 5]
    calendar = [(f"lane{j}", d, rng.gauss(0, 0.01), rng.choice([None, 3.0, 4.5])) for j in range(7) for d in days]
    closes = {(t, d): 10 * np.exp(rng.gauss(0, 0.2)) for t in "abc" for d in days if rng.random() < 0.8}
    closes |= {("a", D0 + timedelta(days=5)): 99.0}
    trades = [(f"lane{rng.randrange(7)}", i, rng.choice("abc"), rng.choice(days), 10.0, rng.choice(days)) for i in range(160)]
    trades = [(k, i, t, a, p, b) for k, i, t, a, p, b in trades if b > a]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    navs, ledger = portfolio.account(
        frame(calendar, "lane string, day date, bench double, bill double"), frame(trades + [(None, 900, "a", D0, 1.0, D0), ("lane1", 901, "a", D0 + timedelta(days=5), 1.0, D0 + timedelta(days=9))], "lane string, trade_id long, ticker string, entry_day date, entry_price double, exit_day date"),
        frame([(t, d, float(c)) for (t, d), c in closes.items()], "ticker string, day date, close double"), lane="lane", ticker="ticker", slots=3, cost_bps=25.0)
    want, book = plain_account(calendar, trades, closes, 3, 25.0)
    got = {(r["lane"], r["day"]): (r["nav"], r["matched"]) for r in navs.collect()}
    assert len(got) == len(want) and all(got[k, d] == pytest.approx((n, m)) for k, d, n, m in want)
    rows = {r["trade_id"]: (r["taken"], r["net"], r["still_open"]) for r in ledger.collect()}
    assert rows.pop(901) == (False, None, False)
    assert {i: (t, n) for i, (t, n, o) in rows.items() if not o} == {i: (t, pytest.approx(n) if n is not None else None) for i, (t, n) in book.items()}


def test_walk_forward_fits_equal_numpy(spark):
    rng = np.random.default_rng(4)
    n = 900
    year, a, b = rng.integers(2010, 2014, n), rng.normal(size=n), rng.normal(size=n)
    y = 1.0 + 2 * a - b + rng.normal(size=n)
    p = 1 / (1 + np.exp(-a))
    hit = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * a - 1)))).astype(int)
    rows = spark.createDataFrame([(int(i), int(t), float(u), float(v), float(w), float(q), int(h)) for i, (t, u, v, w, q, h) in enumerate(zip(year, a, b, y, p, hit))] + [(n, 2013, None, None, None, None, None)], "i int, t int, a double, b double, y double, p double, h int")
    got = {r["i"]: r for r in learning.walk_forward_ridge(rows, period="t", features=["a", "b"], target="y", name="z").collect()}
    probability = {r["i"]: r["q"] for r in learning.walk_forward_logistic(rows, period="t", score="p", label="h", name="q", least=100).collect()}
    assert got[n]["z"] is None and all(got[i]["z"] is None and probability[i] is None for i in np.flatnonzero(year == 2010))
    for t in (2011, 2013):
        past, now = year < t, np.flatnonzero(year == t)
        x = np.stack([a, b], axis=1)
        xc, yc = x[past] - x[past].mean(axis=0), y[past] - y[past].mean()
        beta = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc)
        assert [got[i]["z"] for i in now] == pytest.approx(list(y[past].mean() + (x[now] - x[past].mean(axis=0)) @ beta))
        w = np.zeros(2)
        design = np.stack([a[past], np.ones(past.sum())], axis=1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-design @ w))
            w -= np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design, design.T @ (q - hit[past]))
        assert [probability[i] for i in now] == pytest.approx(list(1 / (1 + np.exp(-(a[now] * w[0] + w[1])))), abs=1e-6)


def test_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(None, 5, "a")], "key string, t int, name string")
    right = spark.createDataFrame([(None, 3, 1.0)], "key string, u int, v double")
    assert joins.asof(left, right, key="key", left_time="t", right_time="u", values=["v"]).first()["matched_v"] is None


def test_appends_refuse_and_raise(spark):
    stored = spark.createDataFrame([("h1", "one")], "h string, c string")
    new = spark.createDataFrame([("h1", "one"), ("h2", "two"), ("h2", "two")], "h string, c string")
    assert [tuple(r) for r in B.upserted(stored, new, key="h", content="c").collect()] == [("h2", "two")]
    with pytest.raises(Exception, match="two contents under h1"):
        B.upserted(stored, spark.createDataFrame([("h1", "other")], "h string, c string"), key="h", content="c").collect()
    with pytest.raises(Exception, match="wrong number of replicates"):
        stats.exact_mean(spark.createDataFrame([("k", 1.0)], "k string, v double"), key="k", value="v", replicates=2).collect()


def test_versions_are_read_under_three_clocks(spark):
    row = lambda v, start, end, known, recorded: ("f", v, start, end, known, recorded)
    rows = spark.createDataFrame([row("v1", 1, 10, 2, 3), row("v2", 1, 8, 2, 6), row("v2", 1, 8, 2, 6)], "f string, v string, a int, b int, k int, r int")
    read = lambda valid, known, system: [x["v"] for x in B.three_clocks(rows, fact=["f"], starts="a", ends="b", available="k", recorded="r", valid_at=F.lit(valid), known_at=F.lit(known), system_at=F.lit(system)).collect()]
    assert read(5, 5, 5) == ["v1"] and read(5, 5, 6) == ["v2"] and read(9, 5, 5) == ["v1"] and read(9, 9, 6) == [] and read(10, 9, 5) == [] and read(5, 1, 5) == [] and read(5, 5, 2) == []


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_a_hot_key_is_cut_into_slices(spark, direction, exact):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(400), i) for i in range(500)], "key string, t int, i int")
    right = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), rng.randrange(400), float(i)) for i in range(120)], "key string, u int, v double")
    run = lambda n: {r["i"]: (r["matched_u"], r["matched_v"]) for r in joins.asof(left, right, key="key", left_time="t", right_time="u", values=["v"], direction=direction, exact=exact, slice_rows=n).collect()}
    assert run(1_000_000) == run(40)


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.97])
def test_thresholds_of_a_hot_key_do_not_depend_on_slices(spark, fraction):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), D0 + timedelta(days=rng.randrange(300)), i, rng.choice([rng.gauss(i / 300, 1), float(rng.randrange(3)), 1.0, float("nan")])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t date, i long, s double")
    run = lambda n: {r["i"]: (r["threshold"], r["prior_count"], r["selected"]) for r in windows.causal_threshold(df, key="k", time="t", ident="i", score="s", fraction=fraction, warmup=20, slice_rows=n).collect()}
    want = run(200_000)
    for n in (400, 90):
        assert run(n) == {i: (pytest.approx(a) if a is not None else None, b, c) for i, (a, b, c) in want.items()}
