"""Fits on strictly earlier periods from sums, and measures of what they predict."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import asof


def _models(rows: DataFrame, period: str) -> list:
    """The periods, in order; one row each reaches the driver."""
    return [r[0] for r in rows.select(period).where(F.col(period).isNotNull()).distinct().orderBy(period).collect()]


def walk_forward_logistic(rows: DataFrame, *, period: str, score: str, label: str, name: str, least: int = 200, steps: int = 12, clip: float = 1e-4) -> DataFrame:
    """Each row with its probability recalibrated by a logistic line on the logit, fitted on strictly earlier periods.

    Newton's method on five sums for each period's model; a step is one
    aggregation over the rows for all models together.  Periods with fewer than
    ``least`` earlier rows, or one kind of label before them, have null.
    """
    spark = rows.sparkSession
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    data = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(period).alias("__t"), F.log(p / (1 - p)).alias("__x"), F.col(label).cast("double").alias("__y"))
    models = {t: np.array([1.0, 0.0]) for t in _models(rows, period)}
    kind = rows.schema[period].dataType.simpleString()
    ready: set = set()
    for step in range(steps):
        table = spark.createDataFrame([(t, float(m[0]), float(m[1])) for t, m in models.items()], f"__m {kind}, a double, b double")
        q = 1 / (1 + F.exp(-(F.col("a") * F.col("__x") + F.col("b"))))
        met = data.join(F.broadcast(table), F.col("__t") < F.col("__m")).withColumn("q", q).withColumn("w", F.col("q") * (1 - F.col("q")))  # a row for each later period
        sums = met.groupBy("__m").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("k"), *[F.sum(e).alias(c) for c, e in (
            ("ga", (F.col("q") - F.col("__y")) * F.col("__x")), ("gb", F.col("q") - F.col("__y")), ("haa", F.col("w") * F.col("__x") * F.col("__x")), ("hab", F.col("w") * F.col("__x")), ("hbb", F.col("w")))]).collect()
        moved = 0.0
        for r in sums:
            if r["n"] < least or r["k"] in (0.0, float(r["n"])):
                continue
            ready.add(r["__m"])
            move = np.linalg.solve(np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]]) + 1e-9 * np.eye(2), np.array([r["ga"], r["gb"]]))
            move *= min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
            models[r["__m"]] = models[r["__m"]] - move
            moved = max(moved, float(np.abs(move).max()))
        if moved < 1e-10:
            break
    lines = spark.createDataFrame([(t, float(models[t][0]), float(models[t][1])) for t in sorted(ready)], f"__m {kind}, __a double, __b double")
    out = rows.join(F.broadcast(lines), F.col(period) == F.col("__m"), "left")  # one row a period
    return out.withColumn(name, 1 / (1 + F.exp(-(F.col("__a") * F.log(p / (1 - p)) + F.col("__b"))))).drop("__m", "__a", "__b")


def walk_forward_ridge(rows: DataFrame, *, period: str, features: Sequence[str], target: str, name: str, alpha: float = 10.0, least: int = 30) -> DataFrame:
    """Each row with the prediction of a ridge fit (free level) on strictly earlier periods.

    One aggregation gives the sums of each period; they are added up over
    earlier periods, and small systems solved, one a period, on the driver.
    """
    spark, k = rows.sparkSession, len(features)
    given = rows
    for c in (*features, target):
        given = given.where(F.col(c).isNotNull())
    terms = [(f"__p{i}_{j}", F.sum(F.col(features[i]) * F.col(features[j]))) for i in range(k) for j in range(i, k)]
    terms += [(f"__s{i}", F.sum(features[i])) for i in range(k)] + [(f"__c{i}", F.sum(F.col(features[i]) * F.col(target))) for i in range(k)]
    sums = given.groupBy(period).agg(F.count(F.lit(1)).alias("__n"), F.sum(target).alias("__y"), *[e.alias(c) for c, e in terms]).collect()
    by = {r[0]: r for r in sums}
    kind = rows.schema[period].dataType.simpleString()
    fits, n, y = [], 0, 0.0
    pp, s, c = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in _models(rows, period):
        if n >= least:
            beta = np.linalg.solve(pp - np.outer(s, s) / n + alpha * np.eye(k), c - s * y / n)
            fits.append((t, float(y / n - beta @ s / n), [float(b) for b in beta]))
        if t in by:
            r = by[t]
            n, y = n + r["__n"], y + r["__y"]
            pp += np.array([[r[f"__p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            s, c = s + np.array([r[f"__s{i}"] for i in range(k)], float), c + np.array([r[f"__c{i}"] for i in range(k)], float)
    table = spark.createDataFrame(fits, f"__m {kind}, __a double, __b array<double>")
    out = rows.join(F.broadcast(table), F.col(period) == F.col("__m"), "left")  # one row a period
    line = F.col("__a")
    for i, f in enumerate(features):
        line = line + F.col("__b")[i] * F.col(f)
    return out.withColumn(name, line).drop("__m", "__a", "__b")


def expanding_fit(rows: DataFrame, *, period: str, estimator: Callable[[], object], least: int = 30) -> DataFrame:
    """Predictions of each period by a model (a pipeline of ``pyspark.ml``) fitted on the earlier ones; periods with fewer than ``least`` earlier rows give none.

    One distributed fit for each period.
    """
    out = None
    counts = {r[0]: r[1] for r in rows.groupBy(period).count().collect()}
    before = 0
    for t in sorted(x for x in counts if x is not None):
        if before >= least:
            model = estimator().fit(rows.where(F.col(period) < F.lit(t)))
            found = model.transform(rows.where(F.col(period) == F.lit(t)))
            out = found if out is None else out.unionByName(found)
        before += counts[t]
    return out if out is not None else rows.limit(0)


def training_percentile(train: DataFrame, test: DataFrame, *, value: str, name: str) -> DataFrame:
    """Test rows with the share of training values strictly below theirs.

    Training values are counted, ranked within at most 1,000 ranges whose
    totals the driver adds up, and met as of each test value: no pairs, and no
    task that holds them all.
    """
    counts = train.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cuts = sorted(set(counts.agg(F.percentile_approx("__v", [i / 1000 for i in range(1, 1000)], 10_000).alias("c")).first()["c"] or []))
    slot = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("__v") > c)) if cuts else F.lit(0)
    placed = counts.withColumn("__b", slot)
    totals = {r["__b"]: r["n"] for r in placed.groupBy("__b").agg(F.sum("__n").alias("n")).collect()}
    offsets, n = [], 0
    for b in sorted(totals):
        offsets.append((b, n))
        n += totals[b]
    upto = F.sum("__n").over(Window.partitionBy("__b").orderBy("__v")) - F.col("__n")
    table = train.sparkSession.createDataFrame(offsets, "__b int, __o long")
    ranked = placed.withColumn("__below", upto).join(F.broadcast(table), "__b").select("__v", (F.col("__below") + F.col("__o")).alias("__below"), "__n")
    one = F.lit(0)
    met = asof(test.withColumn("__k", one), ranked.withColumn("__k", one), key="__k", left_time=value, right_time="__v", values=["__below", "__n"])
    below = F.when(F.col("matched___v") == F.col(value), F.col("matched___below")).otherwise(F.col("matched___below") + F.col("matched___n"))
    return met.withColumn(name, F.when(F.col(value).isNotNull(), F.coalesce(below, F.lit(0)) / F.lit(float(max(n, 1))))).drop("__k", "matched___v", "matched___below", "matched___n")


def confusion(rows: DataFrame, *, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n)."""
    return rows.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def macro_scores(counts: DataFrame, *, label: str, predicted: str) -> DataFrame:
    """(accuracy, macro_f1) of a confusion table: F1 of each class that occurs on either side, averaged."""
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    sides = counts.select(F.col(label).alias("c"), hit.alias("tp"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")).unionByName(
        counts.select(F.col(predicted).alias("c"), F.lit(0).alias("tp"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))
    each = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))
    return each.agg((F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(2 * F.col("tp") / F.nullif(F.col("real") + F.col("said"), F.lit(0))).alias("macro_f1"))
