from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewell.functions.times import iso_instant, to_utc_micros, to_written_day
from tidewell.operators.timestamps import normalised_times

NY, BERLIN, TOKYO = ("America/New_York", "mdy"), ("Europe/Berlin", "dmy"), ("Asia/Tokyo", "ymd")
CASES = [
    ("2016-01-11 18:18:45", NY, "2016-01-11T23:18:45.000000Z"), ("2017-01-22T20:36:22Z", BERLIN, "2017-01-22T20:36:22.000000Z"),
    ("20230118062754", TOKYO, "2023-01-17T21:27:54.000000Z"), ("1559405594", NY, "2019-06-01T16:13:14.000000Z"),
    ("1682423384841", NY, "2023-04-25T11:49:44.841000Z"), ("2024-08-15t05:55:08.975223z", NY, "2024-08-15T05:55:08.975223Z"),
    ("01-NOV-2015 01:05", NY, "2015-11-01T05:05:00.000000Z"), ("Nov 1, 2015 1:05 a.m. EST", NY, "2015-11-01T06:05:00.000000Z"),
    ("Wed, 11 Jul 2012 22:41:01 -0500", BERLIN, "2012-07-12T03:41:01.000000Z"), ("08/13/16 17:53", NY, "2016-08-13T21:53:00.000000Z"),
    ("13/08/16 17:53", BERLIN, "2016-08-13T15:53:00.000000Z"), ("11.07.2017 13:51 ", BERLIN, "2017-07-11T11:51:00.000000Z"),
    ("2014-03-09 02:30:00", NY, "2014-03-09T07:30:00.000000Z"), ("2021-07-12 22:58:04 America/New_York", TOKYO, "2021-07-13T02:58:04.000000Z"),
    ("2025-06-11 05:10:14 UTC-04:00", NY, "2025-06-11T09:10:14.000000Z"), ("20191104T121314+0930", NY, "2019-11-04T02:43:14.000000Z"),
    ("\t16 August 2020, 16:46:05 ", TOKYO, "2020-08-16T07:46:05.000000Z"), ("2020-05-19 21:53:51,320", BERLIN, "2020-05-19T19:53:51.320000Z"),
    ("12/30/2018 12:18 AM", NY, "2018-12-30T05:18:00.000000Z"), ("2022-07-13", BERLIN, "2022-07-12T22:00:00.000000Z"),
    ("0000-00-00 00:00:00", NY, None), ("2021-13-45", NY, None), ("2021-02-29 10:00", NY, None), ("2021-02-28 25:00", NY, None),
    ("13:00 PM", NY, None), ("2020-01-01 00:00 Nowhere/City", NY, None), ("pending", NY, None), ("", NY, None), (None, NY, None), ("x" * 100_000, NY, None),
]


def test_instants(spark):
    rows = [(i, s, z, o) for i, (s, (z, o), _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, s string, z string, o string")
    got = {r[0]: r[1] for r in df.select("i", iso_instant(to_utc_micros(F.col("s"), F.col("z"), F.col("o")))).collect()}
    for i, (text, _, want) in enumerate(CASES):
        assert got[i] == want, text


def test_naive_times_equal_the_zone_database(spark):
    texts = [f"2019-{m:02d}-{d:02d} {h:02d}:30:00" for m, d in ((3, 10), (3, 31), (10, 27), (11, 3), (6, 1)) for h in range(24)]
    rows = [(t, z) for t in texts for z in ("America/New_York", "Europe/Berlin", "Asia/Tokyo")]
    df = spark.createDataFrame(rows, "s string, z string")
    for r in df.select("s", "z", to_utc_micros(F.col("s"), F.col("z"), F.lit("ymd")).alias("u")).collect():
        local = datetime.strptime(r["s"], "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r["z"]), fold=0)
        assert r["u"] == round(local.astimezone(timezone.utc).timestamp() * 1e6), r


@pytest.mark.parametrize("text,order,want", [
    ("03/04/2020", "mdy", "2020-03-04"), ("03/04/2020", "dmy", "2020-04-03"), ("20/04/03", "ymd", "2020-04-03"), ("09-JAN-24", "mdy", "2024-01-09"),
    ("2018-02-15T23:59:59-05:00", "mdy", "2018-02-15"), ("July 7, 2024", "mdy", "2024-07-07"), ("20240815", "dmy", "2024-08-15"), ("31/04/2020", "dmy", None), ("N/A", "mdy", None),
])
def test_days_as_written(spark, text, order, want):
    df = spark.createDataFrame([(text, order)], "s string, o string")
    assert df.select(to_written_day(F.col("s"), F.col("o")).cast("string")).first()[0] == want


def test_tables_with_nulls_resends_and_clashing_columns(spark):
    feeds = spark.createDataFrame([("f", "Asia/Tokyo", "ymd")], "feed string, tz_name string, date_order string")
    rows = spark.createDataFrame(
        [(1, "f", "2020-01-01 09:00", "2020-01-01", "x"), (1, "f", "2020-01-01 09:00", "2020-01-01", "y"), (2, None, "2020-01-01 09:00", None, "x"), (None, "f", "2020-01-01", None, "x")],
        "rid long, feed string, accepted string, filed string, norm_value string")
    options = dict(table_name="t", record_id="rid", instants=["accepted"], dates=["filed"])
    got = sorted(tuple(r) for r in normalised_times(rows, feeds, **options).collect())
    assert got == [("t", 1, "accepted", "2020-01-01T00:00:00.000000Z"), ("t", 1, "filed", "2020-01-01"), ("t", 2, "accepted", "2020-01-01T09:00:00.000000Z")]
    assert normalised_times(rows.limit(0), feeds, **options).count() == 0
    assert normalised_times(rows, feeds.limit(0), **options).count() == 3
