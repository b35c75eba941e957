"""Top fractions, capped groups and order-dependent caps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_fraction(rows: DataFrame, *, score: str, ident: str, fraction: float) -> DataFrame:
    """The ceil(fraction * n) rows with the highest scores, ties by id.

    Scores are counted first; the running count over distinct scores, built in
    two steps over ranges of the score, gives the cutoff.  Rows above it are
    kept as they lie and only its ties are ranked: no row goes through one task.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    n, = rows.agg(F.count(F.lit(1))).first()
    want = -(-int(round(fraction * n * 1e9)) // 10**9)
    # One row for each of at most 1,000 ranges of the score tells in which range the cutoff lies.
    cuts = counts.agg(F.percentile_approx("__s", [i / 1000 for i in range(1, 1000)], 10_000).alias("c")).first()["c"] or []
    slot = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: F.col("__s") >= c)) if cuts else F.lit(0)
    above, inside = 0, None
    for place, many in sorted(((r["p"], r["n"]) for r in counts.groupBy(slot.alias("p")).agg(F.sum("__n").alias("n")).collect()), reverse=True):
        if above + many >= want:
            inside = place
            break
        above += many
    down = F.sum("__n").over(Window.orderBy(F.desc("__s")))  # the distinct scores of one range
    at = counts.where(slot == inside).withColumn("__u", down).where(F.col("__u") + above >= want).orderBy(F.desc("__s")).first() if inside is not None and want else None
    if at is None:  # every score is kept, and nulls after them
        rest = want - above
        nulls = rows.where(F.col(score).isNull()).orderBy(ident).limit(max(0, rest))
        return rows.where(F.col(score).isNotNull()).unionByName(nulls) if want else rows.limit(0)
    left = want - above - (at["__u"] - at["__n"])
    ties = rows.where(F.col(score) == F.lit(at["__s"])).orderBy(ident).limit(left)
    return rows.where(F.col(score) > F.lit(at["__s"])).unionByName(ties)


def top_per_group(rows: DataFrame, *, group: str, order: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def capped_share(rows: DataFrame, *, group: str, order: list, share: float) -> DataFrame:
    """Per group at most max(1, floor(share * rows of the input)); rows without a group are exempt."""
    k = max(1, int(share * rows.count()))
    named = top_per_group(rows.where(F.col(group).isNotNull()), group=group, order=order, k=k)
    return named.unionByName(rows.where(F.col(group).isNull()))


def greedy_cap(rows: DataFrame, *, lane: str, order: str, ident: str, group: str, cap: float) -> DataFrame:
    """(lane, ident, kept): in order, a row is kept if its group's share of the kept rows stays within ``cap``.

    The first row of a known group stands alone, so its share is 1 and it is
    turned down whenever ``cap`` is below 1 and nothing was kept before; rows
    without a group are always kept.
    """
    data = rows.select(F.col(lane).cast("string").alias("k"), F.unix_micros(F.col(order).cast("timestamp")).alias("t"), F.col(ident).cast("long").alias("i"), F.col(group).cast("string").alias("g")).where("k is not null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, {}, 0
        for batch in batches:
            kept = []
            for k, g in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if k != now:
                    now, held, total = k, {}, 0
                ok = g is None or (held.get(g, 0) + 1) / (total + 1) <= cap
                if ok:
                    held[g], total = held.get(g, 0) + 1, total + 1
                kept.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kept, pa.bool_())], names=["k", "i", "kept"])

    walked = data.repartition("k").sortWithinPartitions("k", "t", "i").mapInArrow(walk, "k string, i long, kept boolean")
    return walked.select(F.col("k").alias(lane), F.col("i").alias(ident), "kept")


def leave_one_out(rows: DataFrame, *, group: str, value: str) -> DataFrame:
    """(group, lowest, highest) mean of the group with one row left out."""
    w = Window.partitionBy(group)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    one = rows.where(F.col(value).isNotNull()).select(group, F.when(n > 1, (total - F.col(value)) / F.nullif(n - 1, F.lit(0))).alias("__m"))
    return one.groupBy(group).agg(F.min("__m").alias("lowest"), F.max("__m").alias("highest"))


def stratified(rows: DataFrame, *, group: str, ident: str, k: int, seed: int) -> DataFrame:
    """A repeatable sample of k rows per group, ordered by a hash of seed and id (the feature is the limit)."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")), 256)
    return top_per_group(rows, group=group, order=[key, F.col(ident)], k=k)


def chronological_split(rows: DataFrame, *, group: str, order: list, share: float, name: str = "split") -> DataFrame:
    """First floor(share * n) rows of each group are ``train``, the rest ``test``."""
    w = Window.partitionBy(group)
    place, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return rows.withColumn(name, F.when(place <= F.floor(n * share), "train").otherwise("test"))


def hash_sample(rows: DataFrame, *, ident: str, modulus: int) -> DataFrame:
    """Rows whose MD5, read as one number, is divisible by ``modulus``; the remainder is taken digit by digit."""
    digits = F.transform(F.split(F.md5(F.col(ident).cast("string").cast("binary")), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    remainder = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)
    return rows.where(remainder == 0)


def round_robin(rows: DataFrame, *, stratum: str, ident: str, k: int, seed: int) -> DataFrame:
    """``k`` rows, one of each stratum in turn, in the order of a hash of seed and id.

    No stratum gives more than ``k``, so each is cut to that before the turns are dealt.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(key, ident))
    return rows.withColumn("__k", turn).where(F.col("__k") <= k).orderBy("__k", F.asc_nulls_last(stratum)).limit(k).drop("__k")


def sweep(rows: DataFrame, *, score: str, ident: str, value: str, sizes: list[int]) -> DataFrame:
    """(size, mean, tied, left_out): mean of the ``size`` highest rows, the ties at the edge, and how many of those fall outside.

    Only the largest basket is ranked; ties are counted on all rows.
    """
    head = rows.orderBy(F.desc(score), ident).limit(max(sizes)).select(F.row_number().over(Window.orderBy(F.desc(score), ident)).alias("__k"), F.col(score).alias("__s"), F.col(value).alias("__v"))
    named = head.join(F.broadcast(head.sparkSession.createDataFrame([(n,) for n in sizes], "size int")), F.col("__k") <= F.col("size"))  # a few sizes
    baskets = named.groupBy("size").agg(F.avg("__v").alias("mean"), F.min("__s").alias("__e"))
    inside = named.join(baskets.select("size", "__e"), "size").groupBy("size").agg(F.count_if(F.col("__s") == F.col("__e")).alias("__in"))
    ties = rows.join(F.broadcast(baskets), F.col(score) == F.col("__e")).groupBy("size").agg(F.max("mean").alias("mean"), F.count(F.lit(1)).alias("tied"))
    return ties.join(inside, "size").select("size", "mean", "tied", (F.col("tied") - F.col("__in")).alias("left_out"))
