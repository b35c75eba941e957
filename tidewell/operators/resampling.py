"""Resampling by hash: every draw repeats itself, wherever and however often it is made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def hashed(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 2**48) from a seed and columns, the same on every machine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def moving_blocks(series: DataFrame, *, key: str, order: str, value: str, block: int, draws: int, seed: int) -> DataFrame:
    """(key, draw, mean): means of resamples made of blocks of consecutive rows, cut to the length of the series.

    Starts are uniform on [0, n - block]; a series shorter than a block is one
    block.  Running sums give each block's sum from its two ends, so that a
    draw costs as many rows as it has blocks.
    """
    data = series.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(order)
    upto = data.select(key, F.row_number().over(w).alias("i"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    counts = upto.groupBy(key).agg(F.max("i").alias("n"))
    ends = upto.unionByName(counts.select(key, F.lit(0).alias("i"), F.lit(0.0).alias("s")))
    size = F.least(F.lit(block), F.col("n"))
    picks = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)))
    picks = picks.withColumn("a", (hashed(seed, "draw", "b") % (F.col("n") - size + 1)).cast("int"))
    picks = picks.withColumn("z", F.col("a") + F.least(size, F.col("n") - F.col("b") * size).cast("int"))
    first = ends.select(F.col(key).alias("__k"), F.col("i").alias("a"), F.col("s").alias("sa"))
    last = ends.select(F.col(key).alias("__l"), F.col("i").alias("z"), F.col("s").alias("sz"))
    met = picks.join(first, (F.col(key) == F.col("__k")) & (picks["a"] == first["a"])).join(last, (F.col(key) == F.col("__l")) & (picks["z"] == last["z"]))
    return met.groupBy(key, "draw").agg((F.sum(F.col("sz") - F.col("sa")) / F.max("n")).alias("mean"))


def poisson_means(rows: DataFrame, *, group: str, unit: str, values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """(group, draw, a mean of each value): resamples in which each unit counts as often as a Poisson draw of mean 1 says.

    A unit is a row's id or a block such as a month; rows are summed by unit
    first, all values share the weights, and so their differences are paired.
    """
    sums = rows.groupBy(group, unit).agg(*[f(v).alias(f"{p}_{v}") for v in values for p, f in (("s", F.sum), ("n", F.count))])
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = hashed(seed, "draw", unit) / float(2**48)
    times = sum(((u >= p).cast("int") for p in _POISSON[1:]), (u >= _POISSON[0]).cast("int"))
    weighed = drawn.withColumn("__w", times).where("__w > 0")
    return weighed.groupBy(group, "draw").agg(*[(F.sum(F.col("__w") * F.col(f"s_{v}")) / F.nullif(F.sum(F.col("__w") * F.col(f"n_{v}")), F.lit(0))).alias(v) for v in values])


def interval(draws: DataFrame, *, group: str, value: str | Column, level: float = 0.95) -> DataFrame:
    """(group, low, high): percentile interval of a statistic over its draws."""
    x = F.col(value) if isinstance(value, str) else value
    return draws.groupBy(group).agg(F.percentile(x, (1 - level) / 2).alias("low"), F.percentile(x, (1 + level) / 2).alias("high"))


def permutation_p(rows: DataFrame, *, group: str, ident: str, value: str, selected: Column, draws: int, seed: int) -> DataFrame:
    """(group, observed, p): how often a random choice of as many rows has a mean at least as high; (1 + hits) / (1 + draws)."""
    data = rows.where(F.col(value).isNotNull()).select(group, ident, F.col(value).alias("__v"), F.coalesce(selected, F.lit(False)).alias("__s"))
    real = data.groupBy(group).agg(F.count_if("__s").alias("__k"), F.avg(F.when(F.col("__s"), F.col("__v"))).alias("observed"))
    drawn = data.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.row_number().over(Window.partitionBy(group, "draw").orderBy(hashed(seed, "draw", ident), ident))
    chosen = drawn.withColumn("__r", place).join(F.broadcast(real.withColumnRenamed(group, "__g")), F.col(group).eqNullSafe(F.col("__g"))).where("__r <= __k")  # one row a group
    means = chosen.groupBy(group, "draw").agg(F.avg("__v").alias("m"), F.max("observed").alias("o"))
    return means.groupBy(group).agg(F.max("o").alias("observed"), ((1 + F.count_if(F.col("m") >= F.col("o"))) / (1.0 + draws)).alias("p"))


def placebo_p(rows: DataFrame, *, block: str, ident: str, score: str, outcome: str, fraction: float, draws: int, seed: int) -> DataFrame:
    """(observed, p): mean outcome of the top ``fraction`` of each block by score against scores dealt out anew within the block.

    Each draw selects again by the dealt scores.  Dealing scores to rows and
    taking the highest is dealing places to rows: the rows with the lowest
    hashes take the top places of their block.
    """
    data = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(block, ident, score, F.col(outcome).alias("__o"))
    n = F.count(F.lit(1)).over(Window.partitionBy(block))
    want = F.greatest(F.lit(1), F.floor(n * fraction))
    real = data.withColumn("__w", want).withColumn("__r", F.row_number().over(Window.partitionBy(block).orderBy(F.desc(score), ident)))
    observed = real.where("__r <= __w").agg(F.avg("__o").alias("observed"))
    drawn = data.withColumn("__w", want).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    dealt = drawn.withColumn("__r", F.row_number().over(Window.partitionBy("draw", block).orderBy(hashed(seed, "draw", ident), ident))).where("__r <= __w")
    means = dealt.groupBy("draw").agg(F.avg("__o").alias("m")).crossJoin(F.broadcast(observed))  # one row
    return means.agg(F.max("observed").alias("observed"), ((1 + F.count_if(F.col("m") >= F.col("observed"))) / (1.0 + draws)).alias("p"))


def permuted_within(rows: DataFrame, *, block: str, ident: str, value: str, seed: int, name: str) -> DataFrame:
    """Values dealt out again at random within each block, by a hash of seed and id."""
    shuffled = F.row_number().over(Window.partitionBy(block).orderBy(hashed(seed, ident), ident))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy(block).orderBy(ident)))
    other = rows.select(block, F.col(value).alias(name), shuffled.alias("__k"))
    return placed.join(other, [block, "__k"]).drop("__k")
