"""Joins whose small side is proven small before it is broadcast, and hot-key slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows, and bytes of their values, up to which a dimension may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def _value_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row's values."""
    size = F.lit(0)
    for field in rows.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
        else:
            size = size + 8
    return size


def join_bounded(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "left",
                 max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a broadcast only if ``small`` has at most ``max_rows`` rows and ``max_bytes`` of values.

    The bound is checked when the operator is called, by reading at most
    ``max_rows + 1`` rows; the small side is then made again for the join.  A
    larger side is joined by shuffle, where AQE splits skewed partitions.
    """
    n, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_value_bytes(small)), F.lit(0))).first()
    if n <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def hot_slices(rows: DataFrame, key: str, order: str, slice_rows: int) -> DataFrame | None:
    """Cut points of ``order`` for each key with more than ``slice_rows`` rows.

    Returns (key, ``bounds`` array<long>) or None when no key is hot.  The
    slice size grows with the input, so there are at most about 40,000 cut
    points in all: the result is always small enough to broadcast.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col(key).isNotNull())
    total, = rows.select(F.count(F.lit(1))).first()
    step = max(slice_rows, total // 20_000, 1)
    hot = counts.where(F.col("__n") > step)
    worst = hot.agg(F.max("__n")).first()[0]
    if worst is None:
        return None
    parts = -(-worst // step)
    cuts = F.percentile_approx(order, [i / parts for i in range(1, parts)], max(10_000, 10 * parts))
    bounds = (
        rows.join(F.broadcast(hot), key).groupBy(key)
        .agg(cuts.alias("__cuts"), F.max("__n").alias("__n"))
    )
    stride = F.greatest(F.lit(1), F.floor(F.lit(parts) / F.ceil(F.col("__n") / F.lit(step))).cast("int"))
    return bounds.select(
        key,
        F.array_distinct(F.filter("__cuts", lambda c, i: (i + 1) % stride == 0)).alias("bounds"),
    )
