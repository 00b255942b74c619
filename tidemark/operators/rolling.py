"""Rolling totals over trailing periods, by event-contribution deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1000


def rolling_totals(
    events: DataFrame,
    windows: Sequence[int] = (7, 30),
    entity: str = "contact_point_ref",
) -> DataFrame:
    """Attempts, total and average of ``value`` over trailing days, for each entity and UTC day.

    ``events``: the entity, ``occurred_at`` (timestamp), ``value`` (double). Each entity has one row
    for every day from its first to its last event, also those without any.

    Events are summed to days first (map-side combine; an entity with a third of all rows becomes as
    many rows as it has days). Each daily amount is a delta of plus at its date and of minus
    ``window`` days later; the running sum of the deltas is the total, constant between two change
    points, and each such span is spread over its days last. Amounts are summed as integers of
    1/1000, so what was added is subtracted exactly.

    Defined cases: rows with a null entity or time are left out; a null value counts as an attempt
    without a value; an average without any value is null, a total 0. An empty table gives no rows.
    """
    milli = F.round(F.col("value") * SCALE).cast("bigint")
    daily = (
        events.where(F.col(entity).isNotNull() & F.col("occurred_at").isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.to_date("occurred_at").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("k"), F.coalesce(F.sum(milli), F.lit(0).cast("bigint")).alias("v"))
    )
    measures = ("n", "k", "v")
    change = [f"{m}{w}" for w in windows for m in measures]

    def delta(day, active: int, sign: int):
        cells = [
            ((F.col(m) * sign) if sign > 0 or w == active else F.lit(0).cast("bigint")).alias(f"{m}{w}")
            for w in windows
            for m in measures
        ]
        return F.struct(day.alias("day"), *cells, F.lit(sign > 0).alias("real"))

    points = daily.select(
        "entity",
        F.explode(F.array(delta(F.col("d"), 0, 1), *[delta(F.date_add("d", w), w, -1) for w in windows])).alias("p"),
    ).select("entity", "p.*")
    merged = points.groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in change], F.max("real").alias("real"))
    order = Window.partitionBy("entity").orderBy("day")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("entity")
    spans = (
        merged.select(
            "entity",
            "day",
            *[F.sum(c).over(running).alias(c) for c in change],
            F.lead("day").over(order).alias("next_day"),
            F.max(F.when(F.col("real"), F.col("day"))).over(whole).alias("last_day"),
        )
        .where(F.col("day") <= F.col("last_day"))
        .withColumn("until", F.least(F.date_sub(F.coalesce("next_day", F.date_add("last_day", 1)), 1), F.col("last_day")))
    )
    out = [F.col("entity").alias(entity), F.date_format("day", "yyyy-MM-dd").alias("day")]
    for w in windows:
        out += [
            F.col(f"n{w}").alias(f"attempts_{w}d"),
            (F.col(f"v{w}") / F.lit(float(SCALE))).alias(f"total_{w}d"),
            F.when(F.col(f"k{w}") > 0, F.col(f"v{w}") / F.lit(float(SCALE)) / F.col(f"k{w}")).alias(f"avg_{w}d"),
        ]
    return spans.select("entity", F.explode(F.sequence("day", "until")).alias("day"), *change).select(*out)
