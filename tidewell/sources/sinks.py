"""Writers: append-only lines, tables with a marker, immutable snapshots."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_tables(path: str, **tables: DataFrame) -> None:
    """One zstd Parquet folder for each table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")


def snapshot(rows: DataFrame, path: str) -> None:
    """Written once; an existing snapshot is never replaced."""
    rows.write.mode("error").parquet(path)


def numbered_snapshot(rows: DataFrame, path: str) -> str:
    """Written once below ``path`` or, where that is taken, below the first free ``path-1``, ``path-2``, ...; returns the place."""
    place, n = path, 0
    while True:
        try:
            rows.write.mode("error").parquet(place)
            return place
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            n += 1
            place = f"{path}-{n}"


def sorted_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in order over all part files."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def atomic_state(path: str, state: dict) -> None:
    """A small state file of the driver: written aside and moved into place."""
    aside = f"{path}.new"
    with open(aside, "w") as out:
        json.dump(state, out, sort_keys=True)
        out.flush()
        os.fsync(out.fileno())
    os.replace(aside, path)


def read_state(path: str) -> dict:
    """The state file, or an empty state."""
    if not os.path.exists(path):
        return {}
    with open(path) as given:
        return json.load(given)


def delimited(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def staged(rows: DataFrame, path: str, batch: str) -> None:
    """A batch below its own folder, and its name in a table beside it once it is whole.

    ``committed`` reads named batches only, so one that broke off is not seen;
    writing a batch again replaces it.
    """
    rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite").partitionBy("__batch").option("partitionOverwriteMode", "dynamic").parquet(path)
    rows.sparkSession.createDataFrame([(batch,)], "__batch string").coalesce(1).write.mode("append").parquet(f"{path}/_commits")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were written whole."""
    whole = spark.read.parquet(f"{path}/_commits").distinct()
    return spark.read.parquet(path).withColumn("__batch", F.col("__batch").cast("string")).join(whole, "__batch", "left_semi").drop("__batch")
