"""Bitemporal store: histories, as-of reads, appends, manifests, integrity."""

from pyspark.sql import functions as F

from tidewell.operators import bitemporal as B
from tidewell.operators import joins as J
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()


def _versions(spark, folder):
    return load(spark, folder, "security_versions").select("security_id", "version_id", "ticker", "valid_from", "valid_to", "system_from").distinct()


@plans.query("history_versions", """
    WITH v AS (SELECT DISTINCT security_id, version_id, system_from FROM security_versions)
    SELECT security_id, version_id, epoch_us(system_from) AS recorded,
           epoch_us(lead(system_from) OVER (PARTITION BY security_id ORDER BY system_from)) AS replaced FROM v""")
def history_versions(spark, folder):
    rows = B.history(load(spark, folder, "security_versions").select("security_id", "version_id", "system_from"), "security_id", "system_from")
    return rows.select("security_id", "version_id", F.unix_micros("system_from").alias("recorded"), F.unix_micros("system_to").alias("replaced"))


@plans.query("versions_as_of", """
    SELECT security_id, arg_max(version_id, system_from) AS version_id FROM security_versions
    WHERE system_from <= TIMESTAMPTZ '2020-01-01 00:00:00+00' GROUP BY security_id""")
def versions_as_of(spark, folder):
    return B.as_of(_versions(spark, folder), "security_id", "system_from", F.lit("2020-01-01 00:00:00+00:00").cast("timestamp")).select("security_id", "version_id")


@plans.query("tri_temporal_select", """
    WITH v AS (SELECT DISTINCT security_id, version_id, valid_from, valid_to, system_from FROM security_versions),
    h AS (SELECT *, lead(system_from) OVER (PARTITION BY security_id, valid_from ORDER BY system_from) AS system_to FROM v)
    SELECT security_id, version_id FROM h
    WHERE valid_from <= TIMESTAMPTZ '2019-06-01 00:00:00+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2019-06-01 00:00:00+00')
      AND system_from <= TIMESTAMPTZ '2020-01-01 00:00:00+00' AND (system_to IS NULL OR system_to > TIMESTAMPTZ '2020-01-01 00:00:00+00')""")
def tri_temporal_select(spark, folder):
    at = lambda t: F.lit(f"{t} 00:00:00+00:00").cast("timestamp")
    rows = B.history(_versions(spark, folder).drop("ticker"), ["security_id", "valid_from"], "system_from")
    return rows.where(B.holds(F.col("valid_from"), F.col("valid_to"), at("2019-06-01")) & B.holds(F.col("system_from"), F.col("system_to"), at("2020-01-01"))).select("security_id", "version_id")


@plans.query("documents_as_of", """
    SELECT doc_id, cik FROM documents d JOIN (
      SELECT cik, max(available_at) AS m FROM documents WHERE available_at <= TIMESTAMPTZ '2019-01-01 00:00:00+00' GROUP BY cik) l USING (cik)
    WHERE d.available_at = l.m""")
def documents_as_of(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "cik", "available_at")
    return J.latest_with_ties(docs, "cik", "available_at", F.lit("2019-01-01 00:00:00+00:00").cast("timestamp")).select("doc_id", "cik")


@plans.query("append_missing_cases", """
    SELECT c.case_id, min(security_id) AS security_id FROM experiment_cases c
    WHERE NOT EXISTS (SELECT 1 FROM p_plus20_current p WHERE p.case_id = c.case_id) GROUP BY c.case_id""")
def append_missing_cases(spark, folder):
    return B.append_missing(load(spark, folder, "p_plus20_current").select("case_id"), load(spark, folder, "experiment_cases").select("case_id", "security_id"), ["case_id"])


@plans.query("version_collisions", """
    SELECT cik, count(DISTINCT issuer) AS contents FROM filing_records GROUP BY cik HAVING count(DISTINCT issuer) > 1""")
def version_collisions(spark, folder):
    return B.collisions(load(spark, folder, "filing_records").select("cik", "issuer"), ["cik"], "issuer")


@plans.query("manifest_hashes", """
    SELECT l_orderkey, count(*) AS items, sha256(string_agg(l_partkey::VARCHAR, chr(31) ORDER BY l_linenumber, l_partkey)) AS manifest_hash
    FROM lineitem GROUP BY l_orderkey""")
def manifest_hashes(spark, folder):
    rows = B.manifest(load(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("items", F.col("items").cast("long"))


@plans.query("integrity_violations", """
    SELECT 'order without customer' AS "check", count(*) AS violations FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
    UNION ALL SELECT 'line shipped before order', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
    UNION ALL SELECT 'line without order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
    UNION ALL SELECT 'version ends before it starts', count(*) FROM security_versions WHERE valid_to < valid_from""")
def integrity_violations(spark, folder):
    t = lambda name: load(spark, folder, name)
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return B.violations(
        ("order without customer", t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")),
        ("line shipped before order", lines.join(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").where("l_shipdate < o_orderdate")),
        ("line without order", lines.join(t("orders").select("o_orderkey"), "o_orderkey", "left_anti")),
        ("version ends before it starts", t("security_versions").where("valid_to < valid_from")))


@plans.query("table_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, folder):
    return B.table_counts(**{name: load(spark, folder, name) for name in ("orders", "lineitem", "events")})


@plans.query("backtest_inputs", """
    SELECT DISTINCT p.signal_id, c.case_id, c.split, round(p.stock_return, 6) AS outcome FROM p_plus20_current p JOIN experiment_cases c USING (case_id)
    JOIN security_versions v ON v.security_id = c.security_id AND v.system_from <= c.prediction_as_of
    WHERE c.split IS NOT NULL AND c.recorded_at <= p.loaded_at""")
def backtest_inputs(spark, folder):
    cases = load(spark, folder, "experiment_cases").where("split is not null").select("case_id", "security_id", "split", "prediction_as_of", "recorded_at")
    first = load(spark, folder, "security_versions").groupBy("security_id").agg(F.min("system_from").alias("first"))
    known = cases.join(first, "security_id").where("first <= prediction_as_of")
    signals = load(spark, folder, "p_plus20_current").select("signal_id", "case_id", "loaded_at", "stock_return")
    return signals.join(known, "case_id").where("recorded_at <= loaded_at").select("signal_id", "case_id", "split", F.round("stock_return", 6).alias("outcome")).distinct()


@plans.query("content_digests", "SELECT doc_id, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, ''))) AS digest FROM documents")
def content_digests(spark, folder):
    return load(spark, folder, "documents").select("doc_id", B.digest(F.col("doc_id"), F.col("text")).alias("digest"))


@plans.query("content_classes", """
    SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id FROM documents WHERE text IS NOT NULL""")
def content_classes(spark, folder):
    """One row per document with the first document of equal content."""
    docs = load(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"))
    return docs.join(first, "h").select("doc_id", "class_id")
