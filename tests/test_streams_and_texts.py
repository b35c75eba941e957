import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import streaming
from tidewell.functions import text as T
from tidewell.operators import intervals, resolve, windows
from tidewell.sources import files, sinks

T0 = datetime(2021, 3, 1)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def streamed(spark, tmp_path, parts, schema, build):
    """Rows of a query over a stream of one file after another."""
    folder, n = tmp_path / "in", [0]
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows in parts:
            n[0] += 1
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n[0]}"))
            for file in (tmp_path / f"part{n[0]}").glob("*.parquet"):
                file.rename(folder / f"{n[0]}-{file.name}")
            query.processAllAvailable()
        return spark.table("seen").collect()
    finally:
        query.stop()


def test_streamed_cooldowns_and_thresholds_equal_the_tables(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((T0 + timedelta(hours=5 * i), rng.choice("ab"), i, float(rng.randrange(50))) for i in range(90))
    schema = "t timestamp, k string, i long, s double"
    parts = [rows[:30], rows[30:60], rows[60:]]
    whole = spark.createDataFrame(rows, schema)
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    got = {r["i"] for r in streamed(spark, tmp_path / "one", parts, schema, lambda s: streaming.cooled_stream(s, key="k", time="t", ident="i", days=2))}
    kept, last = set(), {}
    for t, k, i, _ in rows:
        if k not in last or t - last[k] >= timedelta(days=2):
            kept.add(i)
            last[k] = t
    assert got == kept
    got = {r["i"]: (r["threshold"], r["prior_count"], r["selected"]) for r in streamed(spark, tmp_path / "two", parts, schema, lambda s: streaming.threshold_stream(s, key="k", time="t", ident="i", score="s", fraction=0.1, warmup=5))}
    want = {r["i"]: (r["threshold"], r["prior_count"], r["selected"]) for r in windows.causal_threshold(whole, key="k", time="t", ident="i", score="s", fraction=0.1, warmup=5).collect()}
    assert got == {i: (pytest.approx(a) if a is not None else None, b, c) for i, (a, b, c) in want.items()}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    write = streaming.append_once(str(tmp_path / "table"), ["k"])
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    for number in (0, 0, 1):
        write(batch, number)
    write(spark.createDataFrame([("c", 3), ("a", 9)], "k string, v int"), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    rows = spark.createDataFrame([("2021-01-01",), ("2021-06-01",)], "d string")
    assert streaming.matured(rows, time="d", days=90, now=F.lit("2021-04-15")).count() == 1


def test_archives_pages_hashes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("a.tsv", "form\tcik\tn\n10-K\t1\t5\n8-K\t2\tbad\n")
        z.writestr("b.tsv", "cik\tform\n3\t10-Q\n")
    assert sorted((tuple(r) for r in files.zipped_tables(spark, str(tmp_path / "q.zip"), "form string, cik long, n int").collect()), key=str) == [("10-K", 1, 5), ("10-Q", 3, None), ("8-K", 2, None)]
    page = spark.createDataFrame([(7, "<table><tr><th>a</th><th>b&nbsp;c</th></tr><tr><td> 1 </td><td><i>2</i></td></tr></table>"), (8, "no table"), (9, None)], "id int, html string")
    assert [tuple(r) for r in files.html_tables(page, "html").orderBy("row").collect()] == [(7, 0, 0, ["a", "b c"]), (7, 0, 1, ["1", "2"])]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert files.file_hashes(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("ba7816bf")
    assert one(spark, files.coerced(F.lit(" 1,234.5 "))) == 1234.5 and one(spark, files.coerced(F.lit("n/a"))) is None


def test_snapshots_never_replace_and_state_is_whole(spark, tmp_path):
    rows = spark.range(3)
    places = [sinks.numbered_snapshot(rows, str(tmp_path / "snap")) for _ in range(3)]
    assert places == [str(tmp_path / "snap"), str(tmp_path / "snap-1"), str(tmp_path / "snap-2")]
    path = str(tmp_path / "state.json")
    assert sinks.read_state(path) == {}
    sinks.atomic_state(path, {"done": 3})
    sinks.atomic_state(path, {"done": 4})
    assert sinks.read_state(path) == {"done": 4}


def plain_windows(text, words, before, after, gap, budget):
    import re

    runs = []
    for m in re.finditer("|".join(words), text.lower()):
        a, b = max(m.start() - before, 0), min(m.start() + after, len(text))
        if runs and a - runs[-1][1] <= gap:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return "\n...\n".join(text[a:b] for a, b in runs)[:budget]


def test_windows_of_text_merge(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["shares ", "notice", "filler words stand here. ", "x"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "none", "SHARES"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", T.merged_windows(F.col("t"), "shares|notice", 20, 30, 10, 200).alias("x")).collect()}
    assert got.pop(99) in ("", None)
    assert got == {i: plain_windows(t, ["shares", "notice"], 20, 30, 10, 200) for i, t in enumerate(texts)}


def test_each_row_loses_its_own_names(spark):
    rows = spark.createDataFrame([
        ("Trobexor Mining Inc and TRBX, 0000123: trobexor grew. TRBXs stay.", ["Trobexor Mining Inc", "TRBX", "0000123"]), ("Oak Inc (a+b) is here", ["(a+b)", "Oak", None]), ("plain", []), (None, ["x"]), ("kept", None)], "t string, n array<string>")
    got = [r[0] for r in rows.select(T.redacted(F.col("t"), F.col("n"))).collect()]
    assert got[0] == "[ISSUER] and [ISSUER], [ISSUER_ID]: [ISSUER] grew. TRBXs stay." and got[2] == "plain" and got[3] is None
    assert "Oak" not in got[1]
    assert one(spark, T.firm_of_title(F.lit("Acme Toys, of Springfield Recalls Blocks"))) == "Acme Toys"
    assert one(spark, T.capital_phrases(F.lit("the Great Lakes Fund and Tom"))) == ["Great Lakes Fund"]
    assert one(spark, T.surviving(F.lit("Trobexor and trobexor, TRBX TRBXs"), F.lit("Trobexor Inc"), F.lit("TRBX"))) == 3


def test_names_resolve_by_steps(spark):
    index = spark.createDataFrame([("Harbor Mining Inc", "2"), ("Harbor Foods Inc", "3"), ("Zelt Corp", "4"), ("Great Blue Ocean Shipping Ltd", "5"), ("Zelt Corp", "1")], "name string, cik string")
    typed = {"Harbor Mining, Inc.": ("2", "exact"), "Harbor": (None, None), "ZELT": (None, None), "Zelt Corporation": ("1", "exact"), "Great Blue Ocean": ("5", "containment_0.75"), "Great Blue Sea Ocean Shipping": ("5", "containment_0.80"),
             "Great Green Ocean Shipping Ltd": ("5", "fuzzy_0.60"), "Harbor Index Fund": (None, None), "Harbor Nothing": (None, None), "": (None, None)}
    names = spark.createDataFrame([(t, "clash") for t in typed] + [(None, "clash")], "name string, cik string")
    got = {r["name"]: (r["cik"], r["label"]) for r in resolve.resolved(names, index, name="name", index_name="name", key="cik").collect()}
    assert got == typed
    assert resolve.resolved(names.limit(0), index, name="name", index_name="name", key="cik").count() == 0
    assert {r["label"] for r in resolve.resolved(names, index.limit(0), name="name", index_name="name", key="cik").collect()} == {None}


def test_windows_with_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, d date, v double, i long")
    assert windows.ewm(empty, key="k", order="d", value="v", name="x", halflife=3).count() == 0
    assert windows.rolling_sharpe(empty, key="k", order="d", value="v", name="x", length=3, per_year=12).count() == 0
    assert intervals.cooldown(empty, key="k", day="d", ident="i", days=3).count() == 0
