from datetime import datetime, timedelta, timezone

import pytest

from tidewell.operators.point_in_time import attributes_known_at

UTC = timezone.utc
T0 = datetime(2020, 1, 1, tzinfo=UTC)
EVENTS = "case_id string, security_id string, prediction_as_of timestamp, version string"
VERSIONS = "version_id string, security_id string, valid_from timestamp, valid_to timestamp, system_from timestamp, entity string, `at` int"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, events, versions, **options):
    e = spark.createDataFrame([(c, s, day(t), "x") for c, s, t in events], EVENTS)
    v = spark.createDataFrame([(i, s, day(a), day(b), day(k), "clash", 1) for i, s, a, b, k in versions], VERSIONS)
    rows = attributes_known_at(e, v, **options).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1] for r in rows}


def brute(events, versions):
    out = {}
    for case, security, t in events:
        if case is None or security is None or t is None:
            continue
        known = [v for v in versions if v[1] == security and v[2] is not None and v[4] is not None and v[4] <= t]
        standing = {}
        for v in sorted(known, key=lambda v: (v[4], v[0])):
            standing[v[2]] = v
        good = [v for v in standing.values() if v[2] <= t and (v[3] is None or t < v[3])]
        if good:
            out[case] = max(good, key=lambda v: v[2])[0]
    return out


def test_corrections_withdrawals_and_ties(spark):
    versions = [
        ("a", "s", 0, None, 0), ("b", "s", 10, None, 12), ("a2", "s", 0, 10, 12), ("b2", "s", 10, 10, 20), ("c", "s", 30, None, 25),
        ("c", "s", 30, None, 25), (None, None, 1, None, 1), ("n", "s", None, None, 3), ("m", "s", 3, None, None),
    ]
    events = [("e0", "s", -1), ("e1", "s", 0), ("e2", "s", 11), ("e3", "s", 12), ("e4", "s", 19), ("e5", "s", 20), ("e6", "s", 26), ("e7", "s", 30),
              ("e7", "s", 30), ("e8", None, 5), ("e9", "unknown", 5), ("ea", "s", None)]
    assert run(spark, events, versions) == brute(events, versions) == {"e1": "a", "e2": "a", "e3": "b", "e4": "b", "e7": "c"}


@pytest.mark.parametrize("slice_rows", [5, 40, 10**6])
def test_equals_brute_force_with_hot_entity(spark, slice_rows):
    import random

    rng = random.Random(slice_rows)
    versions = []
    for i in range(300):
        s = "hot" if i % 3 else f"s{i % 7}"
        a, k = rng.randrange(200), rng.randrange(220)
        versions.append((f"v{i}", s, a, rng.choice([None, a, a + rng.randrange(40)]), k))
    versions = list({(v[1], v[2], v[4]): v for v in versions}.values())
    events = [(f"e{i}", "hot" if i % 2 else f"s{i % 9}", rng.randrange(-5, 250)) for i in range(400)]
    assert run(spark, events, versions, slice_rows=slice_rows) == brute(events, versions)


def test_empty_tables(spark):
    assert run(spark, [], [("a", "s", 0, None, 0)]) == {}
    assert run(spark, [("e", "s", 1)], []) == {}
