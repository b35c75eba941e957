"""Keyed state on streams: cooldowns, expanding thresholds, idempotent appends, maturity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.windows import RunningQuantile


def cooled_stream(events: DataFrame, *, key: str, time: str, ident: str, days: int) -> DataFrame:
    """(key, time, ident) of events at least ``days`` after the last kept one of their key.

    The state is the last kept time of a key.  Events of one micro-batch are
    taken in order of time and id; one that comes late, before the last kept,
    is turned down, as the order of kept events cannot be undone.
    """
    data = events.select(F.col(key).cast("string").alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(ident).cast("long").alias("i")).where("k is not null and t is not null")

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "i"], kind="stable")
        kept = []
        for t, i in zip(rows["t"], rows["i"]):
            at = int(t.value // 1000)
            if last is None or at - last >= days * 86_400_000_000:
                last = at
                kept.append((name[0], t, int(i)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["k", "t", "i"])

    found = data.groupBy("k").applyInPandasWithState(step, "k string, t timestamp, i long", "last long", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("k").alias(key), F.col("t").alias(time), F.col("i").alias(ident))


def threshold_stream(events: DataFrame, *, key: str, time: str, ident: str, score: str, fraction: float, warmup: int) -> DataFrame:
    """(key, ident, threshold, prior_count, selected): each event judged by the scores of its key in earlier micro-batches and instants.

    The state is the sorted list of scores, so it grows with the key; the
    batch operator ``causal_threshold`` gives the same rows on tables.
    """
    data = events.select(F.col(key).cast("string").alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(ident).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    data = data.where("k is not null and t is not null and s is not null and not isnan(s)")

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = RunningQuantile(1 - fraction)
        known = list(state.get[0]) if state.exists else []
        for x in known:
            seen.add(x)
        rows = pd.concat(list(batches)).sort_values(["t", "i"], kind="stable")
        out = []
        for _, same in rows.groupby("t", sort=True):
            limit = seen.value if len(seen) >= warmup and len(seen) else None
            out += [(name[0], int(i), limit, len(seen), limit is not None and s >= limit) for i, s in zip(same["i"], same["s"])]
            for s in same["s"]:
                seen.add(float(s))
                known.append(float(s))
        state.update((known,))
        yield pd.DataFrame(out, columns=["k", "i", "threshold", "prior_count", "selected"])

    found = data.groupBy("k").applyInPandasWithState(step, "k string, i long, threshold double, prior_count long, selected boolean", "scores array<double>", "append", GroupStateTimeout.NoTimeout)
    return found.withColumnsRenamed({"k": key, "i": ident})


def append_once(path: str, keys: list[str]):
    """A ``foreachBatch`` writer that appends the rows whose key the table does not hold: a batch that runs again adds nothing."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates(keys)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def matured(rows: DataFrame, *, time: str, days: int, now) -> DataFrame:
    """Rows whose window of ``days`` is over at ``now``."""
    return rows.where(F.date_add(F.to_date(time), days) <= F.to_date(now))
