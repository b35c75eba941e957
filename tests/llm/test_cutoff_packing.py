import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, differences
from tidewell.llm import cutoff
from tidewell.llm import queries as Q
from tidewell.llm.cutoff import CountTree, kept_signals, score_code, scored_signals
from tidewell.llm.packing import BestFit, packed_documents, token_count


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, folder, name):
    here, there, n, m = differences(Q.queries()[name](spark, folder), connection(folder), Q.oracle_sql()[name])
    assert (here, there, n) == ([], [], m)


def brute(signals, targets):
    by = defaultdict(dict)
    for s, i, _, x in signals:
        if s is not None and x is not None and x == x:
            by[s][i] = x
    out = set()
    for s, percent in targets:
        scores = sorted(by.get(s, {}).values(), reverse=True)
        for c in sorted(set(scores), reverse=True):
            if 100 * sum(x >= c for x in scores) >= percent * len(scores):
                out |= {(s, i) for i, x in by[s].items() if x >= c}
                break
    return out


SIGNALS = "source string, signal_id long, batch int, score double, code long"
TARGETS = "source string, target_percent int, score double"


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(5)
    signals, targets = [], []
    for k in range(9):
        targets.append((f"s{k}", rng.choice([1, 7, 10, 33, 50, 99, 100])))
        for i in range(rng.choice([1, 2, 30, 400])):
            x = rng.choice([rng.gauss(0, 10.0**rng.randrange(-8, 9)), float(rng.randrange(4)), 0.0, -0.0, None, float("nan"), float("inf"), -float("inf"), 1e-300, 5e-324])
            signals.append((f"s{k}", k * 1000 + i, i % 3, x))
    signals += signals[:40] + [(None, 1, 0, 1.0), ("untargeted", 2, 0, 1.0), ("allnull", 3, 0, None)]
    targets += [("allnull", 10), ("missing", 10), ("s_over", 101)]
    signals += [("s_over", 77, 0, 1.0)]
    kept, cut = kept_signals(spark.createDataFrame([(*s, 1) for s in signals], SIGNALS), spark.createDataFrame([(*t, 0.0) for t in targets], TARGETS))
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(signals, [t for t in targets if t[1] <= 100])
    assert {r["source"] for r in cut.collect()} == {s for s, _ in rows}


def test_cutoffs_batch_by_batch_equal_brute_force(spark):
    rng = random.Random(8)
    signals = [("ab"[i % 2], i, i // 60, rng.choice([rng.gauss(0, 1), 1 + i % 7 * 1e-9, 2.0])) for i in range(180)]
    targets = [("a", 10), ("b", 45)]
    tree, goals = CountTree(spark), spark.createDataFrame([(*t, 0.0) for t in targets], TARGETS)
    for b in range(3):
        sent = [s for s in signals if s[2] == b] + signals[:20]  # earlier rows come again
        kept, _ = kept_signals(spark.createDataFrame([(*s, 1) for s in sent], SIGNALS), goals, tree)
        rows = [tuple(r) for r in kept.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == brute([s for s in signals if s[2] <= b], targets)


def test_full_leaves_are_counted_deeper(spark, monkeypatch):
    rng = random.Random(12)
    signals = [("near", i, 0, 1000.0 + rng.randrange(700) * 1e-12) for i in range(900)] + [("mixed", i, 0, rng.choice([0.5, 0.5 + 2**-40 * rng.randrange(99), -3.0])) for i in range(900)]
    targets = [("near", 37), ("mixed", 61)]
    df, goals = spark.createDataFrame([(*s, 1) for s in signals], SIGNALS), spark.createDataFrame([(*t, 0.0) for t in targets], TARGETS)
    want = brute(signals, targets)
    for rows in (50_000, 100, 1):
        monkeypatch.setattr(cutoff, "REFINE_ROWS", rows)
        kept, cut = kept_signals(df, goals)
        assert {tuple(r) for r in kept.collect()} == want
        assert {r["source"]: r["kept"] for r in cut.collect()} == {k: sum(s == k for s, _ in want) for k in ("near", "mixed")}


def test_batches_add_up_and_empty(spark):
    rows = spark.createDataFrame([("a", i, i % 4, float(i % 17), 0) for i in range(200)], SIGNALS)
    targets = spark.createDataFrame([("a", 25, 0.0)], TARGETS)
    tree = CountTree(spark)
    for b in range(4):
        tree.add(scored_signals(rows.where(f"batch = {b}")))
    whole = CountTree(spark)
    whole.add(scored_signals(rows))
    key = lambda t: sorted(tuple(r) for r in t.nodes().collect())
    assert key(tree) == key(whole)
    assert kept_signals(rows.limit(0), targets)[0].count() == 0
    assert kept_signals(rows, targets.limit(0))[0].count() == 0


def test_code_never_falls(spark):
    rng = random.Random(2)
    xs = sorted([rng.gauss(0, 10.0**rng.randrange(-9, 12)) for _ in range(3000)] + [0.0, float("inf"), -float("inf"), 1.7e308, -1.7e308])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "score double").coalesce(1).select(score_code(F.col("score"))).collect()]
    assert got == sorted(got)
    xs += [5e-324, -5e-324, 2.2250738585072014e-308, 2.225e-308, 1.0, 0.9999999999999999, 2.0, 1.9999999999999998, -0.0] + [2.0**k for k in range(-1074, 1024, 7)]
    rows = spark.createDataFrame([(x,) for x in xs], "score double").coalesce(1).select("score", score_code(F.col("score"))).collect()
    bits = [struct.unpack("<q", struct.pack("<d", abs(x) + 0.0))[0] for x in xs]
    assert [r[1] for r in rows] == [-b if x < 0 else b for x, b in zip(xs, bits)]


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = BestFit(10, 2)
    assert fit.put(6)[:2] == (0, 0) and fit.put(5)[:2] == (1, 0)
    assert fit.put(4)[:2] == (0, 6)  # four units are free in bin 0, five in bin 1
    assert fit.put(7)[:2] == (2, 0)
    bin_, _, closed = fit.put(6)
    assert bin_ == 3 and closed == [(2, 7)]
    assert sorted(fit.rest()) == [(1, 5), (3, 6)]


def test_containers_are_whole_and_full(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("money", "report", "unpronounceable", "x")) for _ in range(rng.choice((3, 40, 300, 900)))) for _ in range(300)] + [None, "", " ", "word " * 9000, "é" * 50]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, container_id int").repartition(6)
    rows = packed_documents(docs, capacity=512, open_bins=8).collect()
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    sizes, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["doc_id"]] += r["n_tokens"]
        if r["container_id"] is not None:
            bins[r["container_id"]].append((r["start"], r["start"] + r["n_tokens"]))
    assert dict(sizes) == {i: token_count(t, path) for i, t in enumerate(texts)}
    assert all(len([r for r in rows if r["doc_id"] == i]) == max(1, -(-sizes[i] // 512)) for i in sizes)
    for spans in bins.values():
        spans.sort()
        assert spans[-1][1] <= 512 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(sizes.values()) / (512 * len(bins)) > 0.93
    assert packed_documents(docs.limit(0)).count() == 0
