from datetime import datetime, timedelta

import pytest

from tests.oracle import connection, differences
from tidewell import plans

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, folder, con, name):
    here, there, n, m = differences(plans.queries()[name](spark, folder), con, SQL[name])
    assert (here, there) == ([], []), f"{n} and {m} rows"
    assert n == m


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert plans.queries()[name](spark, folder).count() > 0


def test_kept_last_tells_nan_from_null_and_rounds_as_its_sql(spark, tmp_path):
    t, nan, inf = datetime(2024, 1, 1), float("nan"), float("inf")
    last = [nan, None, 1.25, inf, -inf, 1e303, 0.0, 259.5647585, -2080.1610825, 745205236638614.8]
    rows = [(i, t + timedelta(days=1), x) for i, x in enumerate(last)] + [(i, t, x) for i, x in enumerate([2.0, nan, nan, None])] + [(2, None, 9.0), (20, None, 4.5), (None, t, nan)]
    spark.createDataFrame(rows, "signal_id long, loaded_at timestamp, score double").write.parquet(str(tmp_path / "p_plus20_current.parquet"))
    want = connection(tmp_path).sql(f"SELECT signal_id, loaded, score FROM ({SQL['kept_last']})").fetchall()
    got = [tuple(r) for r in plans.queries()["kept_last"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))  # as text: a NaN is not a null
