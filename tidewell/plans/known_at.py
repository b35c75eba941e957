"""Problems 1 and 4: attributes known at event time, mixed timestamp formats."""

from tidewell.operators.point_in_time import attributes_known_at
from tidewell.operators.timestamps import normalised_times
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

_FOUND_SQL = """
    WITH v AS (SELECT DISTINCT version_id, security_id, valid_from, valid_to, system_from, ticker, exchange FROM security_versions),
    c AS (SELECT DISTINCT case_id, security_id, prediction_as_of AS t FROM experiment_cases),
    standing AS (
      SELECT c.case_id, c.t, v.*, row_number() OVER (PARTITION BY c.case_id, v.valid_from ORDER BY v.system_from DESC) AS rn
      FROM c JOIN v ON v.security_id = c.security_id AND v.system_from <= c.t),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY valid_from DESC) AS k
      FROM standing WHERE rn = 1 AND valid_from <= t AND (valid_to IS NULL OR t < valid_to))
"""


@plans.query("p1_found", _FOUND_SQL + "SELECT case_id, version_id FROM ranked WHERE k = 1")
def p1_found(spark, folder):
    return attributes_known_at(load(spark, folder, "experiment_cases"), load(spark, folder, "security_versions"))


@plans.query("p1_case_attributes", _FOUND_SQL + "SELECT case_id, version_id, ticker, exchange FROM ranked WHERE k = 1")
def p1_case_attributes(spark, folder):
    """The attributes themselves beside each case."""
    versions = load(spark, folder, "security_versions")
    found = attributes_known_at(load(spark, folder, "experiment_cases"), versions)
    return found.join(versions.select("version_id", "ticker", "exchange").dropDuplicates(["version_id"]), "version_id")


@plans.query("p4_found")
def p4_found(spark, folder):
    feeds = load(spark, folder, "feeds")
    signals = normalised_times(
        load(spark, folder, "p_plus20_current"), feeds, table_name="p_plus20_current", record_id="signal_id",
        instants=["accepted"], dates=["cutoff"])
    filings = normalised_times(
        load(spark, folder, "filing_records"), feeds, table_name="filing_records", record_id="filing_id",
        instants=["accepted_at"], dates=["filing_date"])
    return signals.unionByName(filings)
