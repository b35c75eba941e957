"""tidewell: a PySpark engine for point-in-time research data.

Every operator takes and returns lazy DataFrames.  ``tidewell.plans`` holds
the named queries that ``__spark_entry__.py`` hands to a driver.
"""

__version__ = "0.1.0"
