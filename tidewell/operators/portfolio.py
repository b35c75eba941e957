"""Path-dependent account simulation: a fold per lane over its days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import asof
from tidewell.session import cut_lineage


def simulated(days: DataFrame, *, lane: str, day: str, ret: str, signal: str, slots: int, hold: int, cost: float) -> DataFrame:
    """(lane, day, nav, open, entered): an account with ``slots`` equal places.

    Each day in order: places earn the day's return, those held ``hold`` days
    are closed at a cost, and a day with a signal opens one place with
    ``total / slots`` if one is free and cash is left.  One pass over each
    lane's sorted days; memory is that of the open places.
    """
    data = days.select(F.col(lane).cast("string").alias("k"), F.unix_date(F.to_date(day)).alias("d"), F.col(ret).cast("double").alias("r"), F.col(signal).cast("boolean").alias("s")).where("k is not null and d is not null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cash, held = None, 1.0, []
        for batch in batches:
            out = []
            for k, d, r, s in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    now, cash, held = k, 1.0, []
                held = [(v * (1 + (r or 0.0)), until) for v, until in held]
                cash += sum(v * (1 - cost) for v, until in held if until <= d)
                held = [h for h in held if h[1] > d]
                entered = False
                if s and len(held) < slots:
                    size = min((cash + sum(v for v, _ in held)) / slots, cash)
                    if size > 0:
                        cash -= size
                        held.append((size * (1 - cost), d + hold))
                        entered = True
                out.append((k, d, cash + sum(v for v, _ in held), len(held), entered))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.bool_())],
                                             names=["k", "d", "nav", "open", "entered"])

    walked = data.repartition("k").sortWithinPartitions("k", "d").mapInArrow(walk, "k string, d int, nav double, open int, entered boolean")
    return walked.select(F.col("k").alias(lane), F.date_from_unix_date("d").alias(day), "nav", "open", "entered")


def account(calendar: DataFrame, trades: DataFrame, closes: DataFrame, *, lane: str, ticker: str, slots: int = 10, cost_bps: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """((lane, day, nav, ret, matched, excess, open), (lane, trade_id, taken, net)): a daily account for each lane.

    ``calendar`` has (lane, day, bench, bill): the benchmark's return of the day
    and the bill rate quoted then, null if none.  ``trades`` have (lane,
    trade_id, ticker, entry_day, entry_price, exit_day) and enter in order of
    trade_id; an entry on no calendar day is not taken.  ``closes`` have
    (ticker, day, close).

    Each day in order: cash earns the last bill rate known before the day over
    252; places with a close today are marked, the others keep their value;
    those due leave at a cost; entries take the smaller of ``nav / slots`` and
    the cash, at a cost, if a place is free.  ``matched`` is the benchmark held
    to the share invested before the day, the rest in bills.

    Trades meet their closes by ticker, only between entry and exit.  The fold
    is sequential in each lane: one streaming pass over its sorted rows, in
    memory of its open places; lanes run side by side.
    """
    days = calendar.where(F.col(lane).isNotNull() & F.col("day").isNotNull()).select(F.col(lane).cast("string").alias("k"), F.unix_date(F.to_date("day")).alias("d"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("i"),
                         F.col("bench").cast("double").alias("x"), F.col("bill").cast("double").alias("y"), F.lit(None).cast("int").alias("until"))
    held = trades.where(F.col(lane).isNotNull()).select(F.col(lane).cast("string").alias("k"), F.col("trade_id").cast("long").alias("i"), F.col(ticker).alias("__s"), F.unix_date(F.to_date("entry_day")).alias("d"),
                         F.unix_date(F.to_date("exit_day")).alias("until"), F.col("entry_price").cast("double").alias("x")).where("d is not null and until is not null and x > 0")
    # A place is open up to the first calendar day at or after its exit.
    ends = asof(held, days.select("k", F.col("d").alias("__d")), key="k", left_time="until", right_time="__d", values=[], direction="forward").withColumnRenamed("matched___d", "__end")
    marks = closes.where("close is not null").select(F.col(ticker).alias("__t"), F.unix_date(F.to_date("day")).alias("__m"), F.col("close").cast("double").alias("__c"))
    priced = ends.join(marks, (F.col("__s") == F.col("__t")) & (F.col("__m") > F.col("d")) & (F.col("__end").isNull() | (F.col("__m") <= F.col("__end"))))
    rows = days.unionByName(priced.select("k", F.col("__m").alias("d"), F.lit(1).alias("turn"), "i", F.col("__c").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("int").alias("until")))
    rows = rows.unionByName(held.select("k", "d", F.lit(2).alias("turn"), "i", "x", F.lit(None).cast("double").alias("y"), "until"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state = None, None

        def close(s: dict) -> None:
            """What is left of the day after its marks: exits, entries, the day's row."""
            if s["day"] is None:
                return
            for i in [i for i, (_, _, _, until) in s["places"].items() if s["day"] >= until]:
                value, notional, _, _ = s["places"].pop(i)
                s["cash"] += value * (1 - cost_bps / 1e4)
                out.append((now, s["day"], 1, i, value * (1 - cost_bps / 1e4) / notional - 1, None, None, True))
            for i, price, until in s["entries"]:
                total = s["cash"] + sum(p[0] for p in s["places"].values())
                size = min(total / slots, s["cash"])
                taken = len(s["places"]) < slots and size > 0
                if taken:
                    s["cash"] -= size
                    s["places"][i] = (size * (1 - cost_bps / 1e4), size, price, until)
                else:
                    out.append((now, s["day"], 1, i, None, None, None, False))
            total = s["cash"] + sum(p[0] for p in s["places"].values())
            share = s["before"] / s["total"] if s["total"] else 0.0
            matched = share * (s["bench"] or 0.0) + (1 - share) * s["rf"]
            out.append((now, s["day"], 0, len(s["places"]), total, total / s["total"] - 1, matched, None))
            s["total"] = total
            s["bill"] = s["quoted"] if s["quoted"] is not None else s["bill"]
            s["day"] = None

        def left(s: dict) -> None:
            """Places open at the end of the calendar."""
            for i, (value, notional, _, _) in s["places"].items():
                out.append((now, s["last"], 1, i, value / notional - 1, None, None, None))

        for batch in batches:
            for k, d, turn, i, x, y, until in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    if state is not None:
                        close(state)
                        left(state)
                    now, state = k, {"cash": 1.0, "places": {}, "total": 1.0, "bill": 0.0, "day": None, "last": None}
                if turn == 0:
                    close(state)
                    rf = max(state["bill"], 0.0) / 100 / 252
                    state.update(day=d, last=d, bench=x, quoted=y, rf=rf, entries=[], before=sum(p[0] for p in state["places"].values()))
                    state["cash"] *= 1 + rf
                elif turn == 1:
                    if i in state["places"] and x > 0 and state["day"] == d:  # a close off the calendar marks nothing
                        value, notional, price, end = state["places"][i]
                        state["places"][i] = (value * x / price, notional, x, end)
                elif state["day"] == d:
                    state["entries"].append((i, x, until))
                else:
                    out.append((k, d, 1, i, None, None, None, False))
            yield _account_rows(out)
            out.clear()
        if state is not None:
            close(state)
            left(state)
        yield _account_rows(out)

    walked = cut_lineage(rows.repartition("k").sortWithinPartitions("k", "d", "turn", "i").mapInArrow(walk, "k string, d int, kind int, i long, a double, b double, c double, t boolean"))
    day = F.date_from_unix_date("d").alias("day")
    navs = walked.where("kind = 0").select(F.col("k").alias(lane), day, F.col("a").alias("nav"), F.col("b").alias("ret"), F.col("c").alias("matched"), (F.col("b") - F.col("c")).alias("excess"), F.col("i").cast("int").alias("open"))
    ledger = walked.where("kind = 1").select(F.col("k").alias(lane), F.col("i").alias("trade_id"), F.coalesce("t", F.lit(True)).alias("taken"), F.col("a").alias("net"), F.col("t").isNull().alias("still_open"))
    return navs, ledger


def _account_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 8
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["k", "d", "kind", "i", "a", "b", "c", "t"])


def cohorts(signals: DataFrame, returns: DataFrame, *, lane: str, horizon: int, borrow: float = 0.0, hedge: float = 0.0, floor: float = -0.95) -> DataFrame:
    """(lane, day, n, ret): equally weighted overlapping positions, each held for the ``horizon`` rows of its series after the entry.

    ``signals`` have (lane, ticker, entry_day), ``returns`` (ticker, day, ret,
    bench).  A position needs all rows of its horizon; its daily return less the
    borrow cost is no lower than ``floor``; the hedge adds its part of the
    benchmark while anything is held.
    """
    numbered = returns.withColumn("__n", F.row_number().over(Window.partitionBy("ticker").orderBy("day"))).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    first = asof(signals, numbered.select("ticker", F.col("day").alias("__d"), "__n", "__all"), key="ticker", left_time="entry_day", right_time="__d", values=["__n", "__all"], direction="forward")
    whole = first.where(F.col("matched___n") + horizon <= F.col("matched___all")).select(lane, F.col("ticker").alias("__t"), F.explode(F.sequence(F.col("matched___n") + 1, F.col("matched___n") + horizon)).alias("__k"))
    met = whole.join(numbered, (F.col("__t") == F.col("ticker")) & (F.col("__k") == F.col("__n")))
    one = F.greatest(F.lit(floor), F.col("ret") - borrow / 252)
    return met.groupBy(lane, "day").agg(F.count(F.lit(1)).alias("n"), (F.avg(one) + hedge * F.max("bench")).alias("ret"))


def net_returns(positions: DataFrame, *, asset: str, date: str, weight: str, ret: str, cost_bps: float) -> DataFrame:
    """(date, gross, turnover, net): weights of the day before earn the day's return; trading costs by turnover."""
    w = Window.partitionBy(asset).orderBy(date)
    held = positions.withColumn("__p", F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    found = held.groupBy(date).agg(F.sum(F.col("__p") * F.col(ret)).alias("gross"), F.sum(F.abs(F.col(weight) - F.col("__p"))).alias("turnover"))
    return found.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
