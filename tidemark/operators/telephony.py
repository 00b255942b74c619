"""Features of dial attempts and dispositions, one wide aggregation per event family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import CUES, DISPOSITIONS, SHORT_RING_SECONDS, SLOTS, TIMEZONE, WINDOWS_DAYS, any_of
from tidemark.functions.text import months_switched_off
from tidemark.sources.pit import CP_KEYS

RESPONSES = ("switched_off", "not_reachable", "does_not_exist", "no_answer", "busy")


def local(c: Column) -> Column:
    return F.from_utc_timestamp(c, TIMEZONE)


def slot_of(c: Column) -> Column:
    """The time slot of a UTC time, null outside all of them."""
    hour, out = F.hour(local(c)), F
    for name, (lo, hi) in SLOTS.items():
        out = out.when((hour >= lo) & (hour < hi), name)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b, F.lit(0))


def days_since(as_of: Column, c: Column) -> Column:
    return F.datediff(F.to_date(as_of), F.to_date(c))


def keyed(events: DataFrame) -> DataFrame:
    """Rows that belong to a contact point: every key present."""
    return events.dropna(subset=list(CP_KEYS))


def dial_windows(events: DataFrame, as_of: Column, windows: Sequence[int] = WINDOWS_DAYS) -> DataFrame:
    """All trailing-window counts, rates and ring statistics, in one pass with map-side combine."""
    dials = keyed(events).where((F.col("event_type") == "dial_attempt") & (F.col("occurred_at") <= as_of))
    dials = dials.withColumn("slot", slot_of(F.col("occurred_at"))).withColumn("weekend", F.weekday(local(F.col("occurred_at"))) >= 5)
    answered = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    sums, out = [], [F.col(k) for k in CP_KEYS]
    for w in windows:
        inside = F.col("occurred_at") > as_of - F.expr(f"INTERVAL '{w}' DAY")
        n, tag = f"n_attempts_{w}d", f"_{w}d"
        sums += [F.count_if(inside).alias(n), F.count_if(inside & answered).alias(f"n_answered{tag}")]
        sums += [F.count_if(inside & F.coalesce(F.col("network_response") == r, F.lit(False))).alias(f"n_{r}{tag}") for r in RESPONSES]
        for s in SLOTS:
            hit = inside & F.coalesce(F.col("slot") == s, F.lit(False))
            sums += [F.count_if(hit).alias(f"n_attempts_{s}{tag}"), F.count_if(hit & answered).alias(f"ans_{s}{tag}")]
        ring = F.when(inside, F.col("ring_seconds"))
        sums += [
            F.count_if(inside & F.col("weekend")).alias(f"we{tag}"),
            F.avg(ring).alias(f"ring_seconds_mean{tag}"),
            F.stddev_samp(ring).alias(f"ring_seconds_std{tag}"),
            F.count_if(F.coalesce(ring < SHORT_RING_SECONDS, F.lit(False))).alias(f"short{tag}"),
        ]
        out += [F.col(n), F.col(f"n_answered{tag}"), ratio(F.col(f"n_answered{tag}"), F.col(n)).alias(f"answer_rate{tag}")]
        out += [F.col(f"n_{r}{tag}") for r in RESPONSES]
        for s in SLOTS:
            out += [F.col(f"n_attempts_{s}{tag}"), ratio(F.col(f"ans_{s}{tag}"), F.col(f"n_attempts_{s}{tag}")).alias(f"answer_rate_{s}{tag}")]
        out += [
            ratio(F.col(f"we{tag}"), F.col(n)).alias(f"weekend_attempt_share{tag}"),
            F.col(f"ring_seconds_mean{tag}"),
            F.col(f"ring_seconds_std{tag}"),
            ratio(F.col(f"short{tag}"), F.col(n)).alias(f"short_ring_rate{tag}"),
        ]
    return dials.groupBy(*CP_KEYS).agg(*sums).select(*out)


def day_runs(dials: DataFrame, value: Column) -> DataFrame:
    """Per contact point and UTC day: the first and last value, the length of the day's last run, and
    whether the whole day is one run. Days are small; a hot contact point is spread over them."""
    order = F.struct("occurred_at", "received_at", "event_id")
    w = Window.partitionBy(*CP_KEYS, "day").orderBy("occurred_at", "received_at", "event_id")
    marked = dials.withColumn("day", F.to_date("occurred_at")).withColumn("v", F.coalesce(value, F.lit("missing"))).withColumn("k", F.row_number().over(w))
    last = F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        marked.withColumn("last_v", last)
        .groupBy(*CP_KEYS, "day", "last_v")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("v") != F.col("last_v"), F.col("k"))).alias("other"), F.max(order).alias("at"))
        .withColumn("run", F.col("n") - F.coalesce("other", F.lit(0)))
        .withColumn("whole", F.col("other").isNull())
    )


def trailing_run(dials: DataFrame, value: Column, name: str) -> DataFrame:
    """The last value of each contact point and the length of its trailing run.

    Runs are found per day first and then joined over days, so a contact point with a third of all
    rows never meets in one task as more than its days.
    """
    days = day_runs(dials, value)
    w = Window.partitionBy(*CP_KEYS).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    final = F.first("last_v").over(Window.partitionBy(*CP_KEYS).orderBy(F.desc("day")))
    # A day still belongs to the run if every later day is wholly of the final value.
    broken = F.max((~(F.col("whole") & (F.col("last_v") == F.col("final")))).cast("int")).over(w)
    joined = days.withColumn("final", final).withColumn("broken", F.coalesce(broken, F.lit(0)))
    part = F.when((F.col("broken") == 0) & (F.col("last_v") == F.col("final")), F.col("run")).otherwise(0)
    return joined.groupBy(*CP_KEYS).agg(F.max("final").alias(f"last_{name}"), F.sum(part).alias(f"run_{name}"))


def dial_scalars(events: DataFrame, as_of: Column) -> DataFrame:
    """Last response, trailing runs, days since, mean gap, and the portfolio's failures that day."""
    dials = keyed(events).where((F.col("event_type") == "dial_attempt") & (F.col("occurred_at") <= as_of))
    answered = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    ist = F.to_date(local(F.col("occurred_at")))
    scal = dials.groupBy(*CP_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.max(F.when(answered, F.col("occurred_at"))).alias("last_answer"),
    )
    same = trailing_run(dials, F.col("network_response"), "response")
    fail = trailing_run(dials, F.when(answered, "answered").otherwise("failed"), "outcome")
    by_day = dials.groupBy(ist.alias("ist_day")).agg(F.avg(F.when(answered, 0.0).otherwise(1.0)).alias("system_fail_rate_on_last_attempt_day"))
    span = (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(86400e6)
    return (
        scal.join(same, list(CP_KEYS))
        .join(fail, list(CP_KEYS))
        .withColumn("ist_day", F.to_date(local(F.col("last_at"))))
        .join(by_day, "ist_day", "left")
        .select(
            *CP_KEYS,
            F.col("last_response").alias("last_response_type"),
            F.when(F.col("last_outcome") == "answered", 0).otherwise(F.col("run_outcome")).cast("bigint").alias("consecutive_failures"),
            F.col("run_response").cast("bigint").alias("consecutive_same_response"),
            days_since(as_of, F.col("first_at")).alias("days_since_first_attempt"),
            days_since(as_of, F.col("last_at")).alias("days_since_last_attempt"),
            days_since(as_of, F.col("last_answer")).alias("days_since_last_answer"),
            (span / F.nullif(F.col("n") - 1, F.lit(0))).alias("mean_gap_between_attempts_days"),
            "system_fail_rate_on_last_attempt_day",
        )
    )


def dispositions(events: DataFrame, as_of: Column) -> DataFrame:
    """Counts per disposition, remark cues, months switched off, the last disposition and its agent."""
    disp = keyed(events).where((F.col("event_type") == "disposition") & (F.col("occurred_at") <= as_of))
    n = lambda d: F.count_if(F.coalesce(F.col("disposition") == d, F.lit(False)))
    last = F.max_by(F.struct("disposition", "agent_id", "occurred_at"), F.struct("occurred_at", "received_at", "event_id"))
    agg = disp.groupBy(*CP_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[n(d).alias(f"n_{d}") for d in DISPOSITIONS],
        *[F.count_if(F.coalesce(F.col("remarks").rlike(any_of(p)), F.lit(False))).alias(f"n_{c}_cue") for c, p in CUES.items()],
        F.max(months_switched_off(F.col("remarks"))).alias("max_switched_off_months"),
        F.max(F.when(F.col("disposition") == "rpc", F.col("occurred_at"))).alias("last_rpc"),
        last.alias("last"),
    )
    agents = (
        disp.where(F.col("agent_id").isNotNull())
        .groupBy("lender_id", "agent_id")
        .agg(F.avg((F.coalesce(F.col("disposition") == "wrong_number", F.lit(False))).cast("int")).alias("agent_wrong_number_rate"))
    )
    flat = agg.select(
        *CP_KEYS,
        *[F.col(f"n_{d}") for d in DISPOSITIONS],
        ratio(F.col("n_wrong_number"), F.col("n")).alias("wrong_number_rate"),
        *[F.col(f"n_{c}_cue") for c in CUES],
        "max_switched_off_months",
        F.col("last.disposition").alias("last_disposition"),
        days_since(as_of, F.col("last.occurred_at")).alias("days_since_last_disposition"),
        days_since(as_of, F.col("last_rpc")).alias("days_since_last_rpc"),
        F.col("last.agent_id").alias("agent_id"),
    )
    return flat.join(agents, ["lender_id", "agent_id"], "left")
