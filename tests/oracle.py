"""Spark rows against DuckDB rows of the equivalent SQL."""

import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings security_versions experiment_cases p_plus20_current filing_records "
          "answer_key answers alias_golden universe eval_items reading_labels feeds score_targets").split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        return None if x != x else round(float(x), 5) + 0.0
    if isinstance(x, (date, datetime)):
        return str(x)
    return str(x)


def differences(spark_df, con, sql):
    names = sorted(spark_df.columns)
    mine = Counter(tuple(value(r[n]) for n in names) for r in spark_df.collect())
    found = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    theirs = Counter(tuple(value(x) for x in r) for r in found.fetchall())
    return list((mine - theirs).items())[:5], list((theirs - mine).items())[:5], sum(mine.values()), sum(theirs.values())
