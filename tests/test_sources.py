import gzip
import json

import pytest

from tidewell.sources import files, sinks


def test_tolerant_and_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"k": 1}\n\n{broken\n[1, 2]\n7\n{"k": 2, "x": "a\\u2028b"}\n')
    assert sorted(r["k"] for r in files.json_lines(spark, str(path), "k int, x string").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(path), "k int, x string", strict=True).collect()


@pytest.mark.parametrize("envelope", [True, False])
def test_envelopes(spark, tmp_path, envelope):
    rows = [{"a": 1, "b": "x"}, {"a": 2}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"meta": {}, "results": rows} if envelope else rows))
    assert sorted(tuple(r) for r in files.enveloped(spark, str(path), "struct<a:int,b:string>").collect()) == [(1, "x"), (2, None)]


def test_separated_fixed_and_columns(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("a\tb\n1\tx\nbad\ty\n")
    assert sorted((r["a"] or 0, r["b"]) for r in files.separated(spark, str(tmp_path / "t.tsv.gz"), "a int, b string").collect()) == [(0, "y"), (1, "x")]
    (tmp_path / "f.txt").write_text("10-K  ACME      0001\n8-K   BETA CO   0002\n")
    assert [tuple(r) for r in files.fixed_width(spark, str(tmp_path / "f.txt"), form=(1, 6), name=(7, 10), cik=(17, 4)).collect()] == [("10-K", "ACME", "0001"), ("8-K", "BETA CO", "0002")]
    table = spark.createDataFrame([([1, 2, 3], ["x", "y"])], "a array<int>, b array<string>")
    assert [tuple(r) for r in files.rows_of_columns(table, "a", "b").collect()] == [(1, "x"), (2, "y")]
    daily = spark.createDataFrame([('{"T": {"20200101": 1.5, "20200102": -999.0}}',)], "j string")
    assert sorted(tuple(r) for r in files.map_of_maps(daily, "j", fill=-999.0).collect()) == [("T", "20200101", 1.5), ("T", "20200102", None)]


def test_ownership_documents(spark):
    deal = lambda code, shares, price: f"<nonDerivativeTransaction><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"
    xml = f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Ann</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>{deal('P', 50000, 10.25)}{deal('S', 5, 1)}</nonDerivativeTable></ownershipDocument>"
    assert [tuple(r) for r in files.transactions(spark.createDataFrame([(xml,)], "x string"), "x").collect()] == [("Ann", "P", 50000.0, 10.25)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for _ in range(2):
        sinks.append_lines(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.export_tables(str(tmp_path / "e"), t=rows)
    assert spark.read.parquet(str(tmp_path / "e/t.parquet")).count() == 2
    sinks.snapshot(rows, str(tmp_path / "s"))
    with pytest.raises(Exception):
        sinks.snapshot(rows, str(tmp_path / "s"))
    sinks.delimited(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.staged(rows, str(tmp_path / "b"), "one")
    sinks.staged(rows, str(tmp_path / "b"), "one")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
