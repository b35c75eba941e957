"""Score cutoffs that keep a target fraction of each source: a persistent dyadic count tree."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.bounded import join_bounded
from tidewell.session import cut_lineage, scratch_path

#: Levels of the stored tree, and levels added at once below a leaf that holds more than ``REFINE_ROWS`` rows.
TREE_BITS, STEP_BITS, REFINE_ROWS = 24, 20, 50_000
_SIGNAL = ("source", "signal_id", "batch", "score", "code")


def score_code(score: Column) -> Column:
    """A signed 64-bit integer that rises exactly as the score does.

    It is the bit pattern of the double, its magnitude negated below zero, so
    that the tree divides each source where its scores lie, whatever their
    scale.  The code depends on the score alone: trees of different batches add
    up.  Null and NaN have none.
    """
    size = F.abs(score)
    guess = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0))
    # The logarithm may err by one next to a power of two; powers of two and their quotients are exact.
    low = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= 2.0 * F.pow(F.lit(2.0), guess), guess + 1).otherwise(guess)
    exponent = F.least(F.greatest(low, F.lit(-1022.0)), F.lit(1023.0))
    part = (size / F.pow(F.lit(2.0), exponent) * 2.0**52).cast("long")  # from 2**52 on, below it for subnormal scores
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52)).otherwise((exponent + 1022).cast("long") * F.lit(1 << 52) + part)
    return F.when(score.isNotNull() & ~F.isnan(score), F.when(score < 0, -bits).otherwise(bits))


def _node(code: Column | str, bits: int) -> Column:
    """The node that holds a code ``bits`` levels below the root; siblings are 2n and 2n + 1."""
    return F.shiftright(code, 64 - bits) if bits else F.lit(0).cast("long")


def node_counts(scored: DataFrame, above: int = 0, bits: int = TREE_BITS) -> DataFrame:
    """(source, level, node, n): counts of (source, code) at the levels from ``above`` to ``above + bits``."""
    leaf = scored.groupBy("source", _node("code", above + bits).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(above), F.lit(above + bits)))
    spread = leaf.select("source", levels.alias("level"), "node", "n")
    up = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.expr(f"shiftright(node, {above + bits} - level)"))
    return spread.select("source", "level", up.cast("long").alias("node"), "n").groupBy("source", "level", "node").agg(F.sum("n").alias("n"))


class CountTree:
    """Node counts kept as a table to which every batch adds its own."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or scratch_path(spark, "count-tree")

    def add(self, scored: DataFrame) -> None:
        """Append the node counts of a batch of (source, code)."""
        node_counts(scored).write.mode("append").parquet(self.path)

    def add_signals(self, scored: DataFrame) -> None:
        """Add a batch of ``scored_signals`` and keep its rows beside the counts; rows already kept are left out.

        ``signals`` gives them back.  A tree filled by ``add`` alone has counts but no rows.
        """
        scored = scored.select(*_SIGNAL)
        scored.limit(0).write.mode("append").parquet(f"{self.path}-signals/part=none")
        part = f"{self.path}-signals/part={uuid4().hex}"
        scored.join(self.signals(), ["source", "signal_id", "batch", "score"], "left_anti").select(*_SIGNAL).write.parquet(part)
        self.add(self.spark.read.parquet(part))

    def signals(self) -> DataFrame:
        """All rows that ``add_signals`` kept."""
        return self.spark.read.parquet(f"{self.path}-signals").select(*_SIGNAL)

    def nodes(self) -> DataFrame:
        stored = self.spark.read.schema("source string, level int, node long, n long").parquet(self.path)
        return stored.groupBy("source", "level", "node").agg(F.sum("n").alias("n"))


_LEAF = "source string, leaf long, level int, above long, need long, held long"


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source, from the node it stands at to the lowest one that holds the wanted rank; rows come by (source, level, node down)."""
    source, out = None, []
    at = level = above = need = held = 0
    for batch in batches:
        for name, depth, node, n, start, top, before, want in zip(*[c.to_pylist() for c in batch.columns]):
            if name != source:
                if source is not None:
                    out.append((source, at, level, above, need, held))
                source, at, level, above, need, held = name, start, top, before, want, 0
            # Children come right first; the root has a negative and a positive half.
            if depth == level + 1 and (node >> 1 == at or level == 0) and not (held and depth == found):
                if above + n >= need:
                    at, level, held, found = node, depth, n, depth
                else:
                    above += n
            elif depth == top and node == start:
                held, found = n, depth
    if source is not None:
        out.append((source, at, level, above, need, held))
    columns = list(zip(*out)) or [()] * 6
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["source", "leaf", "level", "above", "need", "held"])


def _walked(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """Where each source of ``start`` (source, leaf, level, above, need) comes to stand after the levels of ``nodes``."""
    from_here = start.select("source", "leaf", F.col("level").alias("top"), "above", "need")
    rows = join_bounded(nodes, from_here, "source", "inner").select("source", "level", "node", "n", "leaf", "top", "above", "need")
    return rows.repartition("source").sortWithinPartitions("source", "level", F.desc("node")).mapInArrow(_descend, _LEAF)


def cutoffs(tree: CountTree, scored: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cutoff, kept): the highest score that keeps at least the target share of each source.

    The stored tree leads to the node with the wanted rank and the count above
    it.  Where that node still holds many rows, the next levels are counted on
    its rows alone, and so on to the full code; then its distinct scores are
    refined.  Runs one small job for each descent.
    """
    goals = targets.groupBy(F.col("source").cast("string").alias("source")).agg(F.max("target_percent").cast("long").alias("percent")).where("percent <= 100")
    nodes = tree.nodes()
    whole = nodes.where("level = 0").select("source", "n")
    start = join_bounded(whole, goals, "source", "inner").select(
        "source", F.lit(0).cast("long").alias("leaf"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("above"),
        F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / 100)).cast("long").alias("need"))
    found, bits = cut_lineage(_walked(nodes, start)), TREE_BITS
    while bits < 64 and not found.where(F.col("held") > REFINE_ROWS).isEmpty():
        step = min(STEP_BITS, 64 - bits)
        inside = join_bounded(scored.select("source", "code", _node("code", bits).alias("leaf")), found.select("source", "leaf"), ["source", "leaf"], "inner")
        found, bits = cut_lineage(_walked(node_counts(inside.select("source", "code"), bits, step), found)), bits + step
    inside = join_bounded(scored.select("source", _node("code", bits).alias("leaf"), "score"), found, ["source", "leaf"], "inner")
    distinct = inside.groupBy("source", "score").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above"), F.max("need").alias("need"))
    down = Window.partitionBy("source").orderBy(F.desc("score"))
    upto = distinct.withColumn("kept", F.col("above") + F.sum("n").over(down)).where("kept >= need")
    return upto.groupBy("source").agg(F.max("score").alias("cutoff"), F.min("kept").alias("kept"))


def scored_signals(signals: DataFrame) -> DataFrame:
    """(source, signal_id, batch, score, code) of scored signals, resent ones once."""
    rows = signals.select(
        F.col("source").cast("string").alias("source"), "signal_id", F.coalesce(F.col("batch"), F.lit(-1)).alias("batch"),
        (F.col("score").cast("double") + F.lit(0.0)).alias("score"))
    return rows.where("source is not null and signal_id is not null and score is not null and not isnan(score)").distinct().withColumn("code", score_code(F.col("score")))


def kept_signals(signals: DataFrame, targets: DataFrame, tree: CountTree | None = None) -> tuple[DataFrame, DataFrame]:
    """((source, signal_id) of the kept signals, (source, cutoff, kept) of each source).

    Without ``tree`` the table is one batch of a new one.  With a tree, the
    ``signals`` are the next batch: those not yet kept there are added, and
    cutoffs and kept signals are those of all signals it holds; the tree must
    be filled by this function or ``CountTree.add_signals``.  A score that is
    null or NaN is not counted and not kept; ties at the cutoff are kept; a
    source without target, or with a target above 100, has no cutoff; an empty
    table has no sources.
    """
    scored = scored_signals(signals)
    if tree is None:
        tree = CountTree(signals.sparkSession)
        tree.add(scored)
    else:
        tree.add_signals(scored)
        scored = tree.signals()
    found = cutoffs(tree, scored, targets)
    kept = join_bounded(scored, found, "source", "inner").where("score >= cutoff")
    return kept.select("source", "signal_id"), found
