"""Append-only versions read under three clocks: effective, available and system time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """SHA-256 of text parts joined by the unit separator; a null part counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def holds(start: Column, stop: Column, at: Column) -> Column:
    """Half-open [start, stop) contains ``at``; a null ``stop`` is open."""
    return (start <= at) & (stop.isNull() | (at < stop))


def history(versions: DataFrame, entity: str | Sequence[str], recorded: str, until: str = "system_to") -> DataFrame:
    """Every version with the instant at which the next one of its entity was recorded; exact resends once."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    return versions.distinct().withColumn(until, F.lead(recorded).over(Window.partitionBy(*keys).orderBy(recorded)))


def as_of(versions: DataFrame, entity: str | Sequence[str], recorded: str, at: Column) -> DataFrame:
    """The version of each entity that the store held at ``at``: a filter and one aggregation, no window."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    rest = [c for c in versions.columns if c not in keys]
    last = versions.where(F.col(recorded) <= at).groupBy(*keys).agg(F.max(F.struct(recorded, *[c for c in rest if c != recorded])).alias("__v"))
    return last.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])


def append_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet, each key once: first writer wins."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__v")) if rest else new.distinct()
    fresh = fresh.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]) if rest else fresh
    return fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def collisions(rows: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Keys under which different contents are stored."""
    return rows.groupBy(*keys).agg(F.countDistinct(content).alias("contents")).where("contents > 1")


def manifest(items: DataFrame, header: str, ordinal: str, value: str) -> DataFrame:
    """(header, items, manifest_hash): an ordered, hashed list of the inputs of each header."""
    listed = items.groupBy(header).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal), F.col(value).alias("value")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["value"].cast("string")), "\u001f")
    return listed.select(header, F.size("l").alias("items"), F.sha2(joined, 256).alias("manifest_hash"))


def upserted(stored: DataFrame, new: DataFrame, *, key: str, content: str) -> DataFrame:
    """The rows of ``new`` to append to a content-addressed table: first writer wins, each key once.

    A key that comes with two contents, among the new rows or against the
    stored ones, raises when the rows are read.
    """
    both = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("__v"), F.col(content).alias("__c"), F.lit(1).alias("__new")).unionByName(
        stored.select(key, F.lit(None).alias("__v"), F.col(content).alias("__c"), F.lit(0).alias("__new")), allowMissingColumns=True)
    found = both.groupBy(key).agg(F.min("__v").alias("__v"), F.min("__new").alias("__new"), F.min("__c").alias("__a"), F.max("__c").alias("__b"))
    clash = F.when(F.col("__a") == F.col("__b"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two contents under "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(clash & (F.col("__new") == 1)).select(key, *[F.col(f"__v.{c}").alias(c) for c in new.columns if c != key])


def checked_append(stored: DataFrame, new: DataFrame, keys: Sequence[str], parents: dict[str, DataFrame], order: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to append, (reason, keys) of refused rows).

    A row is refused when a parent key is not there (``parents`` maps a column
    to a table whose first column holds it; null refers to nothing and passes),
    or when the first of two times lies after the second.  Rows whose key is
    stored are neither: the same key is the same row.
    """
    fresh = append_missing(stored, new, keys)
    reason = F.lit(None).cast("string")
    for early, late in order:
        reason = F.coalesce(reason, F.when(F.col(early) > F.col(late), F.lit(f"{early} after {late}")))
    for column, table in parents.items():
        known = table.select(F.col(table.columns[0]).alias("__p")).distinct().withColumn(f"__has_{column}", F.lit(True))
        fresh = fresh.join(known, F.col(column) == F.col("__p"), "left").drop("__p")
        reason = F.coalesce(reason, F.when(F.col(column).isNotNull() & F.col(f"__has_{column}").isNull(), F.lit(f"{column} unknown")))
    judged = fresh.withColumn("reason", reason).drop(*[f"__has_{c}" for c in parents])
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("reason", *keys)


def three_clocks(versions: DataFrame, *, fact: Sequence[str], starts: str, ends: str, available: str, recorded: str, valid_at: Column, known_at: Column, system_at: Column) -> DataFrame:
    """Versions that hold at ``valid_at``, could be known at ``known_at`` and stand in the store at ``system_at``.

    Effective time is half-open, availability a bound, and system time lasts
    from the record to the next version of the same fact, half-open as well.
    """
    rows = history(versions, list(fact), recorded, "__until")
    return rows.where(holds(F.col(starts), F.col(ends), valid_at) & (F.col(available) <= known_at) & holds(F.col(recorded), F.col("__until"), system_at)).drop("__until")


def manifest_faults(items: DataFrame, *, header: str, ordinal: str, known_at: str, system_at: str, available: str, recorded: str, until: str) -> DataFrame:
    """(header, ordinal, fault) of items that a manifest must not hold.

    ``missing``: no version was found (``recorded`` is null); ``look-ahead``:
    it was not available at the header's ``known_at``; ``invisible``: the store
    did not hold it at ``system_at``; ``repeated``: the ordinal occurs twice.
    """
    twice = F.count(F.lit(1)).over(Window.partitionBy(header, ordinal)) > 1
    faults = F.array_compact(F.array(
        F.when(F.col(recorded).isNull(), "missing"), F.when(F.col(available) > F.col(known_at), "look-ahead"),
        F.when(~holds(F.col(recorded), F.col(until), F.col(system_at)), "invisible"), F.when(F.col("__twice"), "repeated")))
    return items.withColumn("__twice", twice).select(header, ordinal, F.explode(faults).alias("fault"))


def run_faults(runs: DataFrame, headers: DataFrame, *, manifest: str, equal: Sequence[tuple[str, str]]) -> DataFrame:
    """(all run columns, fault) of runs whose manifest is unknown or differs from them in one of the ``equal`` (run, header) columns."""
    known = headers.select(F.col(manifest).alias("__m"), *[F.col(h).alias(f"__{i}") for i, (_, h) in enumerate(equal)])
    met = runs.join(known, F.col(manifest) == F.col("__m"), "left")
    faults = F.array(F.when(F.col("__m").isNull(), "unknown manifest"), *[
        F.when(F.col("__m").isNotNull() & ~F.col(r).eqNullSafe(F.col(f"__{i}")), F.lit(f"{r} differs")) for i, (r, _) in enumerate(equal)])
    return met.select(*runs.columns, F.explode(F.array_compact(faults)).alias("fault"))


def outcome_inputs(predictions: DataFrame, cases: DataFrame, outcomes: DataFrame, *, case: str, recorded: str, outcome_recorded: str, outcome_key: Sequence[str], available: str, system_at: Column, evaluated_at: Column) -> DataFrame:
    """Predictions with their case and the outcome version that the store held at ``system_at``.

    Predictions count if recorded by then, outcomes if their version stood then
    and was available at ``evaluated_at``.
    """
    stood = history(outcomes, list(outcome_key), outcome_recorded, "__until").where(holds(F.col(outcome_recorded), F.col("__until"), system_at) & (F.col(available) <= evaluated_at)).drop("__until")
    return predictions.where(F.col(recorded) <= system_at).join(cases, case).join(stood, case)


def pair_hash(rows: DataFrame, *, group: str, first: str, second: str, digits: int = 3) -> DataFrame:
    """(group, pairs, pair_hash): one hash for the set of (first, second) pairs of a group.

    Pairs are hashed, put in order within 16 ** ``digits`` blocks by the first
    digits, each block hashed, and the block hashes hashed in order: no task
    holds more than a block of a hot group.
    """
    pairs = rows.select(group, digest(F.col(first), F.col(second)).alias("h")).distinct()
    blocks = pairs.groupBy(group, F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"))
    found = blocks.groupBy(group).agg(F.sum("n").alias("pairs"), F.sort_array(F.collect_list(F.struct("b", "h"))).alias("l"))
    return found.select(group, "pairs", F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ","), 256).alias("pair_hash"))


def violations(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(check, violations): row counts of several violation queries in one table."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, rows in checks])


def table_counts(**tables: DataFrame) -> DataFrame:
    return violations(*tables.items()).withColumnsRenamed({"check": "table_name", "violations": "rows"})
