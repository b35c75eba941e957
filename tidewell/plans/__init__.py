"""Registered queries of the core, by module."""

from tidewell.plans import clocks, filing, grouping, joining, known_at, markets, panelling, resampling, resolving, statistics, store, texts, windowing

MODULES = (known_at, store, clocks, joining, markets, windowing, grouping, statistics, resampling, resolving, panelling, filing, texts)


def queries():
    return {name: run for module in MODULES for name, run in module.plans.queries.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.plans.sql.items()}
