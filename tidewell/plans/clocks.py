"""Reads under three clocks, manifests and their faults, checked appends, outcome versions."""

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import times
from tidewell.operators import bitemporal as B
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

_AT = "TIMESTAMPTZ '{} 00:00:00+00'"
_ISO = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({0} AS DATE) END"


def _at(day):
    return F.lit(f"{day} 00:00:00+00:00").cast("timestamp")


def _iso(column):
    return F.when(F.col(column).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(column).try_cast("date"))


@plans.query("claims_as_of", f"""
    WITH c AS (SELECT DISTINCT filing_id, accession_number, {_ISO.format('report_date')} AS starts, {_ISO.format('filing_date')} AS available, loaded_at FROM filing_records),
    h AS (SELECT *, lead(loaded_at) OVER (PARTITION BY accession_number ORDER BY loaded_at) AS until FROM c)
    SELECT filing_id, accession_number, epoch_us(loaded_at) AS recorded FROM h WHERE starts <= DATE '2019-06-30' AND starts + 400 > DATE '2019-06-30' AND available <= DATE '2019-06-30'
      AND loaded_at <= {_AT.format('2020-01-01')} AND (until IS NULL OR until > {_AT.format('2020-01-01')})""")
def claims_as_of(spark, folder):
    """Filings as claims: in effect from the report date for 400 days, available from the filing date, recorded when loaded."""
    rows = load(spark, folder, "filing_records").select("filing_id", "accession_number", _iso("report_date").alias("starts"), _iso("filing_date").alias("available"), "loaded_at")
    rows = rows.withColumn("ends", F.date_add("starts", 400))
    day = F.lit("2019-06-30").cast("date")
    found = B.three_clocks(rows, fact=["accession_number"], starts="starts", ends="ends", available="available", recorded="loaded_at", valid_at=day, known_at=day, system_at=_at("2020-01-01"))
    return found.select("filing_id", "accession_number", F.unix_micros("loaded_at").alias("recorded"))


@plans.query("documents_known", f"""
    WITH h AS (SELECT *, lead(loaded_at) OVER (PARTITION BY accession_number ORDER BY loaded_at) AS until FROM (SELECT DISTINCT filing_id, cik, accession_number, {_ISO.format('filing_date')} AS available, loaded_at FROM filing_records))
    SELECT cik, accession_number, row_number() OVER (PARTITION BY cik ORDER BY available, accession_number) AS place FROM h
    WHERE available <= DATE '2018-12-31' AND loaded_at <= {_AT.format('2019-06-01')} AND (until IS NULL OR until > {_AT.format('2019-06-01')})""")
def documents_known(spark, folder):
    """Documents of each issuer available at one time and in the store at another, in order."""
    from pyspark.sql import Window

    rows = load(spark, folder, "filing_records").select("filing_id", "cik", "accession_number", _iso("filing_date").alias("available"), "loaded_at").distinct()
    stood = B.history(rows, "accession_number", "loaded_at", "until").where((F.col("available") <= F.lit("2018-12-31").cast("date")) & B.holds(F.col("loaded_at"), F.col("until"), _at("2019-06-01")))
    return stood.select("cik", "accession_number", F.row_number().over(Window.partitionBy("cik").orderBy("available", "accession_number")).alias("place"))


_ITEMS = """
    WITH v AS (SELECT DISTINCT security_id, version_id, valid_from, system_from FROM security_versions), h AS (SELECT *, lead(system_from) OVER (PARTITION BY security_id, valid_from ORDER BY system_from) AS until FROM v),
    c AS (SELECT case_id, min(security_id) AS security_id, min(prediction_as_of) AS known_at, min(recorded_at) AS system_at FROM experiment_cases GROUP BY case_id),
    i AS (SELECT case_id, known_at, system_at, version_id, valid_from, system_from, until FROM c LEFT JOIN h USING (security_id))"""


def _items(spark, folder):
    versions = B.history(load(spark, folder, "security_versions").select("security_id", "version_id", "valid_from", "system_from"), ["security_id", "valid_from"], "system_from", "until")
    cases = load(spark, folder, "experiment_cases").groupBy("case_id").agg(F.min("security_id").alias("security_id"), F.min("prediction_as_of").alias("known_at"), F.min("recorded_at").alias("system_at"))
    return cases.join(versions, "security_id", "left")


@plans.query("manifest_faults", _ITEMS + """
    SELECT fault, count(*) AS items FROM (SELECT 'missing' AS fault FROM i WHERE system_from IS NULL UNION ALL SELECT 'look-ahead' FROM i WHERE valid_from > known_at
      UNION ALL SELECT 'invisible' FROM i WHERE NOT (system_from <= system_at AND (until IS NULL OR system_at < until))
      UNION ALL SELECT 'repeated' FROM (SELECT count(*) OVER (PARTITION BY case_id, version_id) AS n FROM i) WHERE n > 1) GROUP BY fault""")
def manifest_faults(spark, folder):
    """Faults of manifests that would list all versions of a case's security."""
    faults = B.manifest_faults(_items(spark, folder), header="case_id", ordinal="version_id", known_at="known_at", system_at="system_at", available="valid_from", recorded="system_from", until="until")
    return faults.groupBy("fault").agg(F.count(F.lit(1)).alias("items"))


@plans.query("run_faults", """
    WITH m AS (SELECT manifest_id, min(experiment_id) AS experiment_id, min(prediction_as_of) AS knowledge_at FROM experiment_cases WHERE split = 'train' GROUP BY manifest_id),
    r AS (SELECT DISTINCT case_id, manifest_id, experiment_id, prediction_as_of FROM experiment_cases)
    SELECT case_id, 'unknown manifest' AS fault FROM r LEFT JOIN m USING (manifest_id) WHERE knowledge_at IS NULL
    UNION ALL SELECT case_id, 'experiment_id differs' FROM r JOIN m USING (manifest_id) WHERE r.experiment_id IS DISTINCT FROM m.experiment_id
    UNION ALL SELECT case_id, 'prediction_as_of differs' FROM r JOIN m USING (manifest_id) WHERE r.prediction_as_of IS DISTINCT FROM m.knowledge_at""")
def run_faults(spark, folder):
    cases = load(spark, folder, "experiment_cases")
    headers = cases.where("split = 'train'").groupBy("manifest_id").agg(F.min("experiment_id").alias("experiment_id"), F.min("prediction_as_of").alias("knowledge_at"))
    runs = cases.select("case_id", "manifest_id", "experiment_id", "prediction_as_of").distinct()
    return B.run_faults(runs, headers, manifest="manifest_id", equal=[("experiment_id", "experiment_id"), ("prediction_as_of", "knowledge_at")]).select("case_id", "fault")


_INPUTS = f"""
    WITH o AS (SELECT DISTINCT signal_id, case_id, source, stock_return, exit_date, loaded_at FROM p_plus20_current), h AS (SELECT *, lead(loaded_at) OVER (PARTITION BY signal_id ORDER BY loaded_at) AS until FROM o),
    p AS (SELECT case_id, min(split) AS split, min(recorded_at) AS recorded_at FROM experiment_cases GROUP BY case_id),
    b AS (SELECT p.case_id, p.split, h.signal_id, h.source, h.stock_return FROM p JOIN h USING (case_id) WHERE p.recorded_at <= {_AT.format('2021-01-01')} AND h.loaded_at <= {_AT.format('2021-01-01')}
      AND (until IS NULL OR until > {_AT.format('2021-01-01')}) AND exit_date <= DATE '2020-12-31')
"""


def _inputs(spark, folder):
    outcomes = load(spark, folder, "p_plus20_current").select("signal_id", "case_id", "source", "stock_return", "exit_date", "loaded_at")
    cases = load(spark, folder, "experiment_cases").groupBy("case_id").agg(F.min("split").alias("split"), F.min("recorded_at").alias("recorded_at"))
    return B.outcome_inputs(cases.select("case_id", "recorded_at"), cases.select("case_id", "split"), outcomes, case="case_id", recorded="recorded_at", outcome_recorded="loaded_at", outcome_key=["signal_id"],
                            available="exit_date", system_at=_at("2021-01-01"), evaluated_at=F.lit("2020-12-31").cast("date"))


@plans.query("outcome_inputs", _INPUTS + "SELECT case_id, split, signal_id, round(stock_return, 6) AS outcome FROM b")
def outcome_inputs(spark, folder):
    """Predictions, cases and the outcome versions that one moment of the store allows."""
    return _inputs(spark, folder).select("case_id", "split", "signal_id", F.round("stock_return", 6).alias("outcome"))


@plans.query("backtest_record", _INPUTS + """
    , q AS (SELECT DISTINCT source, sha256(case_id || chr(31) || signal_id) AS h FROM b), k AS (SELECT source, substr(h, 1, 3) AS part, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM q GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS pairs, sha256(string_agg(h, ',' ORDER BY part)) AS pair_hash FROM k GROUP BY source""")
def backtest_record(spark, folder):
    return B.pair_hash(_inputs(spark, folder), group="source", first="case_id", second="signal_id")


@plans.query("checked_append", """
    WITH c AS (SELECT case_id, security_id, prediction_as_of, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY security_id NULLS FIRST, prediction_as_of, recorded_at) AS k FROM experiment_cases) WHERE k = 1),
    n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p_plus20_current p WHERE p.case_id = c.case_id)),
    j AS (SELECT case_id, CASE WHEN prediction_as_of > recorded_at THEN 'prediction_as_of after recorded_at' WHEN security_id IS NOT NULL AND security_id NOT IN (SELECT security_id FROM security_versions WHERE security_id IS NOT NULL) THEN 'security_id unknown' END AS reason FROM n)
    SELECT case_id, coalesce(reason, 'appended') AS result FROM j""")
def checked_append(spark, folder):
    """What becomes of new cases whose security must be known and that cannot be recorded before they are made."""
    new = load(spark, folder, "experiment_cases").select("case_id", "security_id", "prediction_as_of", "recorded_at")
    stored = load(spark, folder, "p_plus20_current").select("case_id")
    good, bad = B.checked_append(stored, new, ["case_id"], {"security_id": load(spark, folder, "security_versions").select("security_id")}, [("prediction_as_of", "recorded_at")])
    return good.select("case_id", F.lit("appended").alias("result")).unionByName(bad.select("case_id", F.col("reason").alias("result")))


@plans.query("content_upsert", """
    SELECT sha256(text) AS content_hash, count(*) AS documents FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM eval_items WHERE text IS NOT NULL) GROUP BY 1""")
def content_upsert(spark, folder):
    """Contents to add to a content-addressed store that holds the evaluation items, with the documents of each."""
    keyed = lambda df: df.where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "text")
    documents = keyed(load(spark, folder, "documents"))
    new = B.upserted(keyed(load(spark, folder, "eval_items")), documents, key="content_hash", content="text")
    return documents.groupBy("content_hash").agg(F.count(F.lit(1)).alias("documents")).join(new.select("content_hash"), "content_hash", "left_semi")


@plans.query("canonical_json", "SELECT DISTINCT case_id, json(selection_json)::VARCHAR AS canonical FROM experiment_cases WHERE selection_json IS NOT NULL")
def canonical_json(spark, folder):
    rows = load(spark, folder, "experiment_cases").where("selection_json is not null").select("case_id", "selection_json").distinct()
    return rows.select("case_id", T.canonical_json("selection_json").alias("canonical"))


@plans.query("case_times", """
    SELECT DISTINCT case_id, epoch_us((prediction_as_of::DATE + 1)::TIMESTAMP) - 1 AS case_time, coalesce(epoch_us(horizon_end), epoch_us((prediction_as_of::DATE + 91)::TIMESTAMP) - 1) AS horizon_time FROM experiment_cases""")
def case_times(spark, folder):
    rows = load(spark, folder, "experiment_cases").select("case_id", "prediction_as_of", "horizon_end").distinct()
    day = F.to_date("prediction_as_of")
    return rows.select("case_id", F.unix_micros(times.end_of_day(day)).alias("case_time"), F.unix_micros(times.horizon(day, F.col("horizon_end"))).alias("horizon_time")).distinct()
