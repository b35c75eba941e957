"""Attributes as they held, and were on record, at the time of an event."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.bounded import hot_slices

_FOREVER = 2**63 - 1
_CHANGE_SCHEMA = "entity string, slice int, at long, version string"


def active_spans(versions: DataFrame, *, entity: str, version: str, valid_from: str, valid_to: str,
                 known_from: str) -> DataFrame:
    """(entity, version, rank, start, stop): when each version is the standing, valid one of its chain.

    A chain is the set of versions of an entity with equal ``valid_from``; its
    last recorded member stands.  A member is in force for the instants t with
    ``known_from <= t < next known_from`` and ``valid_from <= t < valid_to``,
    that is on one half-open span.  Resent rows fall together; of two different
    rows recorded at the same instant the greater version id stands.  Rows
    without entity, ``valid_from`` or ``known_from`` are never in force.
    """
    v = versions.select(
        F.col(entity).cast("string").alias("entity"), F.col(version).cast("string").alias("version"),
        F.unix_micros(F.col(valid_from).cast("timestamp")).alias("rank"), F.unix_micros(F.col(valid_to).cast("timestamp")).alias("ends"),
        F.unix_micros(F.col(known_from).cast("timestamp")).alias("known"),
    ).where("entity is not null and rank is not null and known is not null")
    chain = Window.partitionBy("entity", "rank").orderBy("known", F.col("version").asc_nulls_first())
    v = v.withColumn("next", F.lead("known").over(chain)).where("next is null or next > known")
    return v.select(
        "entity", "version", "rank", F.greatest("known", "rank").alias("start"),
        F.coalesce(F.least("next", "ends"), F.lit(_FOREVER)).alias("stop"),
    ).where("start < stop")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (entity, slice, start) to the instants at which the winner changes.

    The winner is the span in force with the greatest rank.  Memory is that of
    the spans in force at one instant, whatever the length of a history.
    """
    key: tuple | None = None
    heap: list[tuple[int, int, str]] = []
    out: list[tuple] = []

    def put(at: int, winner: str | None) -> None:
        if out and out[-1][:3] == (*key, at):
            out[-1] = (*key, at, winner)
        else:
            out.append((*key, at, winner))

    def expire(now: int) -> None:
        while heap and heap[0][1] <= now and heap[0][1] < _FOREVER:
            at = heapq.heappop(heap)[1]
            while heap and heap[0][1] <= at:
                heapq.heappop(heap)
            put(at, heap[0][2] if heap else None)

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        made = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.string())], names=["entity", "slice", "at", "version"])
        out.clear()
        return made

    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for entity, cut, start, stop, rank, version in zip(*rows):
            if (entity, cut) != key:
                if key is not None:
                    expire(_FOREVER)
                key = (entity, cut)
                heap.clear()
            expire(start)
            heapq.heappush(heap, (-rank, stop, version))
            put(start, heap[0][2])
        if len(out) > 50_000:
            last = out.pop()  # a later row at the same instant may still replace it
            yield emit()
            out.append(last)
    if key is not None:
        expire(_FOREVER)
    yield emit()


def attributes_known_at(events: DataFrame, versions: DataFrame, *, event_key: str = "case_id",
                        entity: str = "security_id", event_time: str = "prediction_as_of",
                        version: str = "version_id", valid_from: str = "valid_from",
                        valid_to: str = "valid_to", known_from: str = "system_from",
                        slice_rows: int = 200_000) -> DataFrame:
    """(event_key, version): for each event the version in force and on record at its time.

    Changes and events are united, sorted by entity and time with changes
    before events of the same instant, and the last known version is carried
    forward.  Entities with more than ``slice_rows`` events are cut into slices
    of time that run as tasks of their own; a change that reaches into a slice
    is repeated at its start.

    Events without entity, time or a version in force give no row; resent
    events (same key, entity and time) count once; extra columns of either
    table are ignored, whatever their names; empty tables give no rows.
    """
    e = events.select(
        F.col(entity).cast("string").alias("entity"),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"), F.col(event_key).alias("key"),
    ).where("entity is not null and at is not null and key is not null")
    spans = active_spans(versions, entity=entity, version=version, valid_from=valid_from,
                         valid_to=valid_to, known_from=known_from)
    sizes = e.select("entity", "at").unionByName(spans.select("entity", F.col("start").alias("at")))
    cuts = hot_slices(sizes, "entity", "at", slice_rows)
    if cuts is None:
        e = e.withColumn("slice", F.lit(0))
        spans = spans.withColumn("slice", F.lit(0))
    else:
        cuts = F.broadcast(cuts)
        below = lambda at, strict: F.coalesce(F.size(F.filter("bounds", lambda b: b < at if strict else b <= at)), F.lit(0))
        e = e.join(cuts, "entity", "left").withColumn("slice", below(F.col("at"), False)).drop("bounds")
        spans = (
            spans.join(cuts, "entity", "left")
            .withColumn("slice", F.explode(F.sequence(below(F.col("start"), False), below(F.col("stop"), True))))
            .withColumn("start", F.greatest("start", F.try_element_at("bounds", F.when(F.col("slice") > 0, F.col("slice")))))
            .drop("bounds")
        )
    changes = (
        spans.select("entity", "slice", "start", "stop", "rank", "version")
        .repartition("entity", "slice").sortWithinPartitions("entity", "slice", "start")
        .mapInArrow(_sweep, _CHANGE_SCHEMA)
    )
    kind = events.schema[event_key].dataType
    both = changes.select(
        "entity", "slice", "at", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("key"), "version",
    ).unionByName(e.select(
        "entity", "slice", "at", F.lit(1).alias("turn"), "key", F.lit(None).cast("string").alias("version"),
    ))
    order = Window.partitionBy("entity", "slice").orderBy("at", "turn", "key")
    known = F.last(F.when(F.col("turn") == 0, F.struct("version")), ignorenulls=True).over(order)
    resent = (F.lag("key").over(order).eqNullSafe(F.col("key"))) & (F.lag("at").over(order) == F.col("at"))
    return (
        both.select("turn", "key", known["version"].alias("found"), F.coalesce(resent, F.lit(False)).alias("resent"))
        .where("turn = 1 and not resent and found is not null")
        .select(F.col("key").alias(event_key), F.col("found").alias(version))
    )
