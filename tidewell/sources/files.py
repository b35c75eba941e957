"""Readers of semi-structured files, with the tolerance each one needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Line-feed separated objects; blank, broken and non-object lines are skipped, or raise if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("lineSep", "\n").json(path)


def enveloped(spark: SparkSession, path: str, schema: str, field: str = "results") -> DataFrame:
    """Rows of a JSON file that holds either a list or an object with the list under ``field``."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", f"$.{field}"), f"array<{schema}>"), F.from_json("value", f"array<{schema}>"))
    return whole.select(F.inline(F.when(F.size(listed) >= 0, listed)))


def separated(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited text with a header, gzip allowed; values that do not fit the schema become null."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, mode="PERMISSIVE")


def fixed_width(spark: SparkSession, path: str, **columns: tuple[int, int]) -> DataFrame:
    """Lines cut at fixed places; ``columns`` give (first, length), counted from 1."""
    lines = spark.read.text(path)
    return lines.select(*[F.trim(F.substring("value", a, n)).alias(name) for name, (a, n) in columns.items()])


def rows_of_columns(table: DataFrame, *columns: str) -> DataFrame:
    """Parallel lists of one row to rows, cut to the shortest list."""
    shortest = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut = [F.slice(F.col(c), 1, F.greatest(shortest, F.lit(0))).alias(c) for c in columns]
    return table.select(F.inline(F.arrays_zip(*cut))) if len(columns) > 1 else table.select(F.explode(cut[0]).alias(columns[0]))


def map_of_maps(table: DataFrame, column: str, fill: float | None = None) -> DataFrame:
    """(feature, day, value) of a JSON object of objects; the fill value is null."""
    outer = table.select(F.explode(F.from_json(column, "map<string,map<string,double>>")).alias("feature", "__m"))
    rows = outer.select("feature", F.explode("__m").alias("day", "value"))
    return rows.withColumn("value", F.nullif("value", F.lit(fill))) if fill is not None else rows


def transactions(table: DataFrame, column: str, code: str = "P") -> DataFrame:
    """(owner, code, shares, price) of ownership documents in XML."""
    doc = F.col(column)
    at = lambda path: F.xpath(doc, F.lit(path))
    owner = F.xpath_string(doc, F.lit("//reportingOwner/reportingOwnerId/rptOwnerName"))
    zipped = F.arrays_zip(
        at("//nonDerivativeTransaction/transactionCoding/transactionCode/text()").alias("code"),
        at("//nonDerivativeTransaction/transactionAmounts/transactionShares/value/text()").alias("shares"),
        at("//nonDerivativeTransaction/transactionAmounts/transactionPricePerShare/value/text()").alias("price"))
    rows = table.select(owner.alias("owner"), F.inline(zipped))
    return rows.select("owner", "code", F.col("shares").try_cast("double").alias("shares"), F.col("price").try_cast("double").alias("price")).where(F.col("code") == code)


def number(text: Column) -> Column:
    """A number written with thousands separators; null where it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def coerced(text: Column) -> Column:
    """A number written with thousands separators, blanks or a percent sign; null for anything else."""
    return F.regexp_replace(F.trim(text), "[, %]", "").try_cast("double")


def zipped_tables(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of the delimited members of zip files, each archive read by one task as bytes and cut by line.

    The header names the columns; columns that the schema lacks are left out,
    missing ones and values that do not fit are null.
    """
    import csv
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    fields = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as raw:
                            reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8", errors="replace"), delimiter=sep)
                            rows: list[tuple] = []
                            for row in reader:
                                rows.append(tuple(row.get(c) for c in fields))
                                if len(rows) == 20_000:
                                    yield pd.DataFrame(rows, columns=fields)
                                    rows = []
                            yield pd.DataFrame(rows, columns=fields)

    raw = spark.read.format("binaryFile").load(path).select("content")
    text = raw.mapInPandas(read, ", ".join(f"{c} string" for c in fields))
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    return text.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in fields])


def html_tables(table: DataFrame, column: str) -> DataFrame:
    """(all other columns, table, row, cells): rows of the tables of a page, cells without markup."""
    tag = lambda name: F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&nbsp;|&#160;", " "), r"\s+", " "))
    keep = [c for c in table.columns if c != column]
    tables = table.select(*keep, F.posexplode(F.regexp_extract_all(column, tag("table"), 1)).alias("table", "__t"))
    rows = tables.select(*keep, "table", F.posexplode(F.regexp_extract_all("__t", tag("tr"), 1)).alias("row", "__r"))
    cells = F.transform(F.regexp_extract_all("__r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), clean)
    return rows.select(*keep, "table", "row", cells.alias("cells"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
