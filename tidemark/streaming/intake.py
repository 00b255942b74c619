"""Streaming intake: idempotent append, late marks, compliance rules and the suppression log."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.late_events import current_watermarks
from tidemark.operators.mapping import apply_mapping, dead_letters
from tidemark.sources.store import EventStore


def ingest_batch(store: EventStore, raw: DataFrame, spec: dict[str, Any], pepper: str | None = None, totals: bool = False, tag: str | None = None) -> dict[str, int]:
    """One batch: map, split, dead-letter, merge, mark late. A replay changes nothing.

    With ``totals`` the daily totals of the store are corrected by the rows that are new in it, from the
    checkpoints of their contact points on.
    """
    mapped = apply_mapping(raw, spec, pepper, keep_raw=True).cache()
    try:
        dead = store.insert_or_ignore("dead_letter", dead_letters(mapped, spec["source"]), ["row_hash"])
        good = mapped.where(F.col("reason").isNull()).drop("reason", "raw_json")
        if totals:
            # Before the merge, by what it will add: if the batch fails in between and is repeated, its
            # tag keeps it from being counted twice.
            new = store.unseen(good).select("contact_point_ref", "lender_id", "occurred_at", "received_at", F.lit(0).cast("bigint").alias("amount"))
            log = store.read("watermarks")
            store.late_state().apply(new, None if log is None else current_watermarks(log), tag)
        counts = store.merge_events(good)
        late = store.mark_late(good).count()
        return counts | {"dead_lettered": dead, "late_marked": late}
    finally:
        mapped.unpersist()


def start_intake(spark: SparkSession, folder: str, schema, store: EventStore, spec: dict[str, Any], checkpoint: str, fmt: str = "json", totals: bool = False):
    """A file stream into the store; each micro-batch goes through ``ingest_batch``."""
    stream = spark.readStream.format(fmt).schema(schema).load(folder)
    return stream.writeStream.foreachBatch(lambda df, n: ingest_batch(store, df, spec, totals=totals, tag=f"{checkpoint}#{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, delay: str = "7 days", width: str = "1 day") -> DataFrame:
    """A streaming aggregate by event time: events per type and window, late ones up to ``delay``."""
    return events.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def fast_path(events: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Stateless rules on a batch or a stream: one row per event and rule that fires."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return events.select("event_id", "lender_id", "contact_point_ref", "occurred_at", F.explode(fired).alias("reason"))


def suppression_log(hits: DataFrame, order: Sequence[str] = ("occurred_at", "event_id"), whole: bool = True) -> DataFrame:
    """The current state per (lender, contact): first reason, all evidence, and a version that grows
    with the order of first hits.

    With ``whole`` false the evidence is counted only (n_evidence); ``suppression_evidence`` has it as a
    table of its own, so that a line shared by many makes no large row. Versions are numbered inside each lender's days and moved by the numbers of the days before, so
    no task orders a lender.
    """
    first = F.min_by("reason", F.struct(*order))
    state = hits.groupBy("lender_id", "contact_point_ref").agg(
        first.alias("reason"), F.min(F.struct(*order)).alias("at"), (F.array_sort(F.collect_set("event_id")).alias("evidence") if whole else F.count_distinct("event_id").alias("n_evidence")), F.count_distinct("reason").alias("n_reasons")
    ).withColumn("day", F.to_date(F.col("at")[order[0]]))
    sizes = state.groupBy("lender_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lender_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("lender_id", "day").orderBy("at", "contact_point_ref"))
    placed = state.withColumn("k", inside).join(sizes.select("lender_id", "day", before.alias("before")), ["lender_id", "day"])
    return placed.select("lender_id", "contact_point_ref", "reason", "evidence" if whole else "n_evidence", "n_reasons", (F.col("before") + F.col("k")).cast("int").alias("version"))


def suppression_evidence(hits: DataFrame) -> DataFrame:
    """One row for each event that speaks for a contact's suppression, with its reasons' number."""
    return hits.groupBy("lender_id", "contact_point_ref", "event_id").agg(F.count_distinct("reason").alias("n_reasons"))


def since_version(log: DataFrame, version: int) -> DataFrame:
    return log.where(F.col("version") > version)
