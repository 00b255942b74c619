"""Late and out-of-order events: per-day aggregates corrected by checkpoint and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.deliver_once import LEAST_HOT, PARTS
from tidemark.operators.skew import salted
from tidemark.session import Scratch

KEYS = ("contact_point_ref", "lender_id")


def current_watermarks(log: DataFrame) -> DataFrame:
    """The row with the latest ``updated_at`` per key; ties go to the latest watermark.

    Rows with a null key or update time are no marks.
    """
    return (
        log.where(F.col("contact_point_ref").isNotNull() & F.col("lender_id").isNotNull() & F.col("updated_at").isNotNull())
        .groupBy(*KEYS)
        .agg(F.max(F.struct(F.col("updated_at").cast("timestamp").alias("u"), F.col("watermark_ts").cast("timestamp").alias("w"))).alias("m"))
        .select(*KEYS, F.col("m.w").alias("watermark_ts"))
        .where(F.col("watermark_ts").isNotNull())
    )


def hot_keys(events: DataFrame) -> DataFrame:
    """Keys with more than one in ``PARTS`` of all rows, fewer than ``PARTS`` by that definition."""
    counts = events.where(F.col("contact_point_ref").isNotNull() & F.col("lender_id").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tm_n"))
    total = counts.agg((F.coalesce(F.sum("tm_n"), F.lit(0)) / PARTS).alias("tm_share"))
    return counts.where(F.col("tm_n") > LEAST_HOT).crossJoin(F.broadcast(total)).where(F.col("tm_n") > F.col("tm_share")).select(*KEYS)


def classify(events: DataFrame, marks: DataFrame, lateness_days: int, hot: DataFrame | None = None) -> DataFrame:
    """``kind``: 0 in time, 1 late within the limit, 2 beyond the limit.

    The marks of the hot keys are broadcast, and the rows of these keys cross the exchange of the join
    under random numbers, so that no key meets in one task.
    """
    late = (F.col("occurred_at") < F.col("watermark_ts")) & (F.col("received_at") > F.col("watermark_ts"))
    within = F.col("received_at") <= F.col("occurred_at") + F.expr(f"INTERVAL '{lateness_days}' DAY")
    hot = hot_keys(events) if hot is None else hot
    near = hot.join(marks, list(KEYS), "left").select(*KEYS, F.lit(True).alias("tm_hot"), F.col("watermark_ts").alias("tm_hot_ts"))
    ref, lender = KEYS
    spread = events.join(F.broadcast(near), list(KEYS), "left").withColumn("tm_ref", salted(F.col(ref), F.col("tm_hot").isNotNull()))
    joined = spread.join(marks.withColumnRenamed(ref, "tm_ref"), ["tm_ref", lender], "left")
    marked = joined.withColumn("watermark_ts", F.when(F.col("tm_hot").isNotNull(), F.col("tm_hot_ts")).otherwise(F.col("watermark_ts"))).select(*events.columns, "watermark_ts")
    return marked.withColumn("kind", F.when(late & within, 1).when(late, 2).otherwise(0))


def usable_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("contact_point_ref").isNotNull() & F.col("lender_id").isNotNull() & F.col("occurred_at").isNotNull())


def day_counts(events: DataFrame, marks: DataFrame, lateness_days: int, snapshot_days: int, hot: DataFrame | None = None) -> DataFrame:
    """KEYS, event_day, slot, and counts and amounts by kind, aggregated with map-side combine."""
    kind = lambda k: F.col("kind") == k
    amount = F.coalesce(F.col("amount"), F.lit(0).cast("bigint"))
    return (
        classify(usable_events(events), marks, lateness_days, hot)
        .withColumn("event_day", F.to_date("occurred_at"))
        .groupBy(*KEYS, "event_day")
        .agg(
            F.count_if(kind(0)).alias("n0"),
            F.sum(F.when(kind(0), amount).otherwise(0)).alias("a0"),
            F.count_if(kind(1)).alias("n1"),
            F.sum(F.when(kind(1), amount).otherwise(0)).alias("a1"),
            F.count_if(kind(2)).alias("n_too_late"),
        )
        .withColumn("slot", F.floor(F.datediff("event_day", F.lit("1970-01-01").cast("date")) / snapshot_days))
    )


def with_running(days: DataFrame) -> DataFrame:
    """``days`` (n, a) with the running n_to_date and a_to_date of each key."""
    by_day = Window.partitionBy(*KEYS).orderBy("event_day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("n_to_date", F.sum("n").over(by_day)).withColumn("a_to_date", F.sum("a").over(by_day))


def take_snapshots(days: DataFrame) -> DataFrame:
    """KEYS, slot, n, a: the state at the end of every slot that has days."""
    return (
        days.groupBy(*KEYS, "slot")
        .agg(F.max(F.struct("event_day", "n_to_date", "a_to_date")).alias("s"))
        .select(*KEYS, "slot", F.col("s.n_to_date").alias("n"), F.col("s.a_to_date").alias("a"))
    )


def replay(days: DataFrame, snapshots: DataFrame, dirty: DataFrame) -> DataFrame:
    """The corrected suffix of every dirty key (KEYS, from_slot).

    The snapshot that precedes ``from_slot`` is restored; the sorted ``days`` from there on, which hold
    the late ones already, are replayed on top of it.
    """
    at = snapshots.select(*KEYS, F.col("slot").alias("at"), F.col("n").alias("sn"), F.col("a").alias("sa"))
    restored = (
        dirty.join(at, list(KEYS), "left")
        .groupBy(*KEYS, "from_slot")
        .agg(F.max(F.when(F.col("at") < F.col("from_slot"), F.struct("at", "sn", "sa"))).alias("s"))
        .select(*KEYS, "from_slot", F.coalesce(F.col("s.sn"), F.lit(0)).alias("n_before"), F.coalesce(F.col("s.sa"), F.lit(0)).alias("a_before"))
    )
    suffix = days.join(restored, list(KEYS)).where(F.col("slot") >= F.col("from_slot"))
    run = with_running(suffix)
    return run.withColumn("n_to_date", F.col("n_before") + F.col("n_to_date")).withColumn("a_to_date", F.col("a_before") + F.col("a_to_date")).drop("from_slot", "n_before", "a_before")


def correct_late(
    events: DataFrame,
    marks: DataFrame,
    scratch: Scratch,
    lateness_days: int = 7,
    snapshot_days: int = 16,
    hot: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Daily totals per contact point and lender of a whole log, corrected for late events.

    ``events``: contact_point_ref, lender_id, occurred_at, received_at (timestamps), amount; one
    row per event. ``marks``: one watermark per key. ``hot``: keys with very many rows, where known.

    Events are classified and aggregated to days with map-side combine; the rows of hot keys are spread
    over all tasks until then, and a key has as many rows as days after. The in-time days give the first
    outputs and running state; the state is snapshot at the end of every ``snapshot_days``. For a key
    with late events the snapshot preceding its first late day is restored, the sorted days from there
    on are replayed together with the late ones, and these rows replace the first outputs. ``LateState``
    does the same batch by batch over a stored state, without reading the history.

    ``daily`` has one row per key and UTC day: n_events, amount, running n_to_date and
    amount_to_date, n_late (late events within the limit), n_too_late (beyond it, left out of the
    totals), corrected. ``dirty`` has the keys with late events and their first late day.

    Defined cases: rows with a null key or event time belong to no day and are left out; a null
    received_at is in time; null amounts count 0; a key without a watermark has no late events.
    """
    # The days are the state that snapshots are taken of; they are written once and read by each part.
    daily, _ = scratch.cut(day_counts(events, marks, lateness_days, snapshot_days, hot))
    first = with_running(daily.withColumnsRenamed({"n0": "n", "a0": "a"}))
    dirty = daily.where(F.col("n1") > 0).groupBy(*KEYS).agg(F.min("event_day").alias("first_late_day"), F.min("slot").alias("from_slot"))
    whole = daily.select(*KEYS, "event_day", "slot", (F.col("n0") + F.col("n1")).alias("n"), (F.col("a0") + F.col("a1")).alias("a"), "n1", "n_too_late")
    columns = lambda df, late, done: df.select(
        *KEYS, "event_day", F.col("n").alias("n_events"), F.col("a").alias("amount"), "n_to_date", F.col("a_to_date").alias("amount_to_date"), late.alias("n_late"), "n_too_late", F.lit(done).alias("corrected")
    )
    replayed = columns(replay(whole, take_snapshots(first), dirty.select(*KEYS, "from_slot")), F.col("n1"), True)
    kept = columns(
        first.join(dirty.select(*KEYS, "from_slot"), list(KEYS), "left").where(F.col("from_slot").isNull() | (F.col("slot") < F.col("from_slot"))), F.lit(0).cast("bigint"), False
    )
    return {"daily": kept.unionByName(replayed), "replayed": replayed, "dirty": dirty.select(*KEYS, "first_late_day")}


class LateState:
    """Stored daily totals with checkpoints, corrected by batches of events that come in any order.

    One bucketed table holds the days (n_events, amount, running totals, n_late, n_too_late) and, every
    ``snapshot_days``, the running state of each key; a change to both is one commit. A batch is
    aggregated to days; only the buckets of its keys are read; each key's checkpoint before its first
    changed day is restored, the days from there on are replayed, and the buckets are rewritten.
    """

    DAY, SNAPSHOT = "day", "snapshot"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, lateness_days: int = 7, snapshot_days: int = 16):
        from tidemark.sources.buckets import BucketTable

        self.table = BucketTable(spark, root, KEYS, buckets)
        self.spark, self.lateness_days, self.snapshot_days = spark, lateness_days, snapshot_days

    def apply(self, batch: DataFrame, marks: DataFrame | None, tag: str | None = None) -> list[int]:
        """Adds the events of a batch (as for ``correct_late``; each event once over all batches), and
        returns the buckets that were rewritten. A ``tag`` that was applied before changes nothing, so
        a batch can be repeated after a failure."""
        if tag is not None and tag in self.table.tags():
            return []
        if marks is None:
            marks = self.spark.createDataFrame([], "contact_point_ref string, lender_id string, watermark_ts timestamp")
        scratch = Scratch(self.spark, "batch")
        new, path = scratch.cut(day_counts(batch, marks, self.lateness_days, self.snapshot_days))
        new = new.select(*KEYS, "event_day", "slot", (F.col("n0") + F.col("n1")).alias("n"), (F.col("a0") + F.col("a1")).alias("a"), F.col("n1").alias("n_late"), "n_too_late")
        where = self.table.touched(new)
        dirty = new.groupBy(*KEYS).agg(F.min("slot").alias("from_slot"))
        old = self.table.read(where)
        if old is None or not where:
            old_days, old_snaps = new.limit(0).withColumn("n_to_date", F.col("n")).withColumn("a_to_date", F.col("a")), None
        else:
            old_days = old.where(F.col("kind") == self.DAY).select(*KEYS, "event_day", "slot", "n", "a", "n_late", "n_too_late", "n_to_date", "a_to_date")
            old_snaps = old.where(F.col("kind") == self.SNAPSHOT).select(*KEYS, "slot", "n", "a")
        snaps = new.select(*KEYS, "slot", "n", "a").limit(0) if old_snaps is None else old_snaps
        sums = [F.sum(c).alias(c) for c in ("n", "a", "n_late", "n_too_late")]
        suffix = old_days.join(dirty, list(KEYS)).where(F.col("slot") >= F.col("from_slot")).select(new.columns)
        changed = replay(suffix.unionByName(new).groupBy(*KEYS, "event_day", "slot").agg(*sums), snaps, dirty)
        before = lambda df: df.join(dirty, list(KEYS), "left").where(F.col("from_slot").isNull() | (F.col("slot") < F.col("from_slot"))).drop("from_slot")
        days = before(old_days).unionByName(changed)
        marked = before(snaps).unionByName(take_snapshots(changed))
        rows = days.withColumn("kind", F.lit(self.DAY)).unionByName(marked.withColumn("kind", F.lit(self.SNAPSHOT)), allowMissingColumns=True)
        self.table.rewrite(where, rows, tag)
        scratch.drop(path)
        return where

    def daily(self) -> DataFrame | None:
        """contact_point_ref, lender_id, event_day, n_events, amount, n_to_date, amount_to_date, n_late, n_too_late."""
        rows = self.table.read()
        if rows is None:
            return None
        return rows.where(F.col("kind") == self.DAY).select(
            *KEYS, "event_day", F.col("n").alias("n_events"), F.col("a").alias("amount"), "n_to_date", F.col("a_to_date").alias("amount_to_date"), "n_late", "n_too_late"
        )


def new_dirty_marks(dirty: DataFrame, marks_so_far: DataFrame, reason: str = "late_event") -> DataFrame:
    """The keys to add to dirty_contact_points: those not yet marked for ``reason``."""
    have = marks_so_far.where(F.col("reason") == reason).select(*KEYS).distinct()
    return dirty.join(have, list(KEYS), "left_anti").withColumn("reason", F.lit(reason))
