"""Repeated consecutive events in sequences: each run becomes one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.pointers import resolve_pointers
from tidemark.session import Scratch

#: Length of the time slices that split a sequence, in gaps.
SLICE_GAPS = 12


def link_predecessors(events: DataFrame, keys: Sequence[str], max_gap_s: int) -> DataFrame:
    """id, ptr: the event before, where it matches and is near enough, else the event itself.

    Sequences are cut into slices of ``SLICE_GAPS`` gaps of time; an event in the last gap of a slice
    is also shown to the next one, where it is only a predecessor. Whatever lies further back cannot
    be linked, so a slice sees all that matters and a hot sequence is spread over its slices.
    """
    gap = max_gap_s * 1_000_000
    width = gap * SLICE_GAPS
    us = F.unix_micros("occurred_at")
    slot = F.floor(us / width)
    seen = events.withColumn("us", us).withColumn(
        "copy",
        F.explode(
            F.when(
                F.pmod("us", F.lit(width)) >= width - gap,
                F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))),
            ).otherwise(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own"))))
        ),
    )
    w = Window.partitionBy(*keys, "copy.slot").orderBy("us", "id")
    prev = F.lag(F.struct("id", "us", "value")).over(w)
    linked = (F.col("prev.value") == F.col("value")) & (F.col("us") - F.col("prev.us") <= gap)
    return (
        seen.withColumn("prev", prev)
        .where("copy.own")
        .select(*keys, "id", "occurred_at", "value", F.when(linked, F.col("prev.id")).otherwise(F.col("id")).alias("ptr"))
    )


def collapse_runs(events: DataFrame, keys: Sequence[str], scratch: Scratch, max_gap_s: int = 1800, least: int = 2) -> DataFrame:
    """One row per run of at least ``least`` consecutive events with equal ``value``.

    ``events``: the keys, id (unique), occurred_at (timestamp), value. Events of one key sequence are
    consecutive in the order of (occurred_at, id); a link also needs a gap of at most ``max_gap_s``.
    Matching events point to their predecessor and pointer doubling finds every run's start; runs are
    then aggregated by start with map-side combine.

    Returns the keys, value, first_id, first_at, last_at, n, seconds. Defined cases: an event with a
    null value or id belongs to no run and ends one; rows with a null key or time are left out; equal
    times are ordered by id, null first; an empty table gives no rows.
    """
    # An event without an id keeps its place in the order, where it ends a run.
    usable = events.dropna(subset=[*keys, "occurred_at"]).withColumn("value", F.when(F.col("id").isNotNull(), F.col("value")))
    links, path = scratch.cut(link_predecessors(usable, keys, max_gap_s))
    chained = links.where(F.col("id") != F.col("ptr")).select("id", "ptr")
    starts = resolve_pointers(chained, scratch)
    member = links.join(starts, "id", "left").withColumn("first_id", F.coalesce("root", "id"))
    return (
        member.where(F.col("value").isNotNull())
        .groupBy(*keys, "value", "first_id")
        .agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
        .withColumn("seconds", (F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6)
    )
