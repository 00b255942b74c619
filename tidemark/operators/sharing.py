"""Sharing graph, record history, cross-line and field features; point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import VISIT_OUTCOMES, WINDOWS_DAYS
from tidemark.operators.skew import spread_join
from tidemark.operators.telephony import days_since, keyed, local, ratio
from tidemark.session import Scratch
from tidemark.sources.pit import CP_KEYS

BORROWER = ("lender_id", "borrower_id")


def universe(events: DataFrame, contacts: DataFrame) -> DataFrame:
    """The contact table united with the keys that events show, created when first seen there."""
    seen = keyed(events).groupBy(*CP_KEYS).agg(F.min("occurred_at").alias("first_seen"))
    table = contacts.dropna(subset=list(CP_KEYS)).groupBy(*CP_KEYS).agg(F.min("created_at").alias("made"))
    return table.join(seen, list(CP_KEYS), "full_outer").select(*CP_KEYS, F.coalesce("made", "first_seen").alias("created_at"), F.col("made").isNotNull().alias("in_table"))


def shared_counts(univ: DataFrame) -> DataFrame:
    """Borrowers per contact reference, references per borrower, and rank by age within a borrower."""
    by_ref = univ.groupBy("lender_id", "contact_point_ref").agg(F.count_distinct("borrower_id").alias("n_borrowers"))
    by_borrower = univ.groupBy(*BORROWER).agg(F.count_distinct("contact_point_ref").alias("n_contacts"))
    rank = F.row_number().over(Window.partitionBy(*BORROWER).orderBy(F.asc_nulls_last("created_at"), "contact_point_ref"))
    return (
        univ.withColumn("cp_rank", rank)
        .join(by_ref, ["lender_id", "contact_point_ref"])
        .join(by_borrower, list(BORROWER))
        .select(*CP_KEYS, "n_borrowers", (F.col("n_borrowers") > 1).alias("is_shared"), "n_contacts", "cp_rank")
    )


def component_sizes(links: DataFrame, scratch: Scratch, most: int = 100) -> DataFrame:
    """lender_id, borrower_id, component, n_borrowers: borrowers joined by shared contacts of a lender.

    Smallest labels travel from contacts to borrowers and back, and every label is replaced by its
    label's label, until nothing changes, so a chain of n contacts takes about log n rounds. Each round
    is two aggregations with map-side combine, whatever the degree of a contact, and is cut to the
    shared folder.
    """
    edges, _ = scratch.cut(links.select("lender_id", "borrower_id", "contact_point_ref").dropna().distinct())
    label, path = scratch.cut(edges.select(*BORROWER).distinct().withColumn("component", F.col("borrower_id")))
    for _ in range(most):
        at = edges.join(label, list(BORROWER))
        low = at.groupBy("lender_id", "contact_point_ref").agg(F.min("component").alias("low"))
        nearer = edges.join(low, ["lender_id", "contact_point_ref"]).groupBy(*BORROWER).agg(F.min("low").alias("low"))
        moved = label.join(nearer, list(BORROWER)).select(*BORROWER, F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("moved"))
        nearer_now, near_path = scratch.cut(moved.withColumn("tm_at", F.concat_ws("\u0000", "lender_id", "component")))
        jump = nearer_now.select(F.concat_ws("\u0000", *BORROWER).alias("tm_at"), F.col("component").alias("tm_jump"))
        leapt = spread_join(nearer_now, jump, "tm_at")
        new, new_path = scratch.cut(leapt.select(*BORROWER, F.least("component", "tm_jump").alias("component"), (F.col("moved") | (F.col("tm_jump") < F.col("component"))).alias("moved")))
        scratch.drop(near_path)
        again = not new.where("moved").isEmpty()
        scratch.drop(path)
        label, path = new.drop("moved"), new_path
        if not again:
            break
    else:
        raise ValueError("labels did not settle")
    sizes = label.groupBy("lender_id", "component").agg(F.count(F.lit(1)).alias("n_borrowers"))
    return label.join(sizes, ["lender_id", "component"]).select(*BORROWER, "component", "n_borrowers")


def record_history(events: DataFrame, as_of: Column) -> DataFrame:
    """Updates per contact point: how many, and the time, source and flag of the last one received."""
    ups = keyed(events).where(F.col("event_type") == "contact_point_update")
    last = F.max_by(F.struct("occurred_at", "update_source", "update_primary"), F.struct("received_at", "occurred_at", "event_id"))
    return (
        ups.groupBy(*CP_KEYS)
        .agg(F.count(F.lit(1)).alias("n_updates"), last.alias("l"))
        .select(*CP_KEYS, "n_updates", days_since(as_of, F.col("l.occurred_at")).alias("days_since_last_update"), F.col("l.update_source").alias("last_source"), F.col("l.update_primary").alias("last_primary"))
    )


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """For each left row the latest right row of the same keys at or before it.

    Both sides are united and sorted by time inside (keys, UTC day); the last right row of earlier
    days comes from a window over one aggregate per day. So a key with a third of all rows is split
    over its days. At equal times the right row counts; among equal right rows the greatest value.
    """
    fields = [at, *value]
    tagged = left.select("*", F.lit(None).cast(right.select(F.struct(*fields).alias("s")).schema["s"].dataType).alias("tm_r"), F.lit(1).alias("tm_side")).unionByName(
        right.select(*keys, at, F.struct(*fields).alias("tm_r"), F.lit(0).alias("tm_side")), allowMissingColumns=True
    ).withColumn("tm_day", F.to_date(at))
    order = Window.partitionBy(*keys, "tm_day").orderBy(at, "tm_side", "tm_r").rowsBetween(Window.unboundedPreceding, 0)
    daily = tagged.groupBy(*keys, "tm_day").agg(F.max("tm_r").alias("tm_last"))
    before = Window.partitionBy(*keys).orderBy("tm_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select(*keys, "tm_day", F.last("tm_last", ignorenulls=True).over(before).alias("tm_before"))
    found = tagged.withColumn("tm_here", F.last("tm_r", ignorenulls=True).over(order)).where(F.col("tm_side") == 1).join(carried, [*keys, "tm_day"])
    best = F.coalesce("tm_here", "tm_before")
    return found.select(*[c for c in left.columns], *[best[f].alias(prefix + f) for f in fields])


def payment_confirmations(events: DataFrame, days: int = 7) -> DataFrame:
    """Payments confirmed by a contact: each payment of a borrower with a qualifying disposition at
    most ``days`` whole days before it, per contact point that had one.

    The range join is on (borrower, day bucket): a disposition is shown to the two buckets of
    ``days`` + 1 days that its range can reach, so no borrower's rows are paired with all others.
    """
    width = (days + 1) * 86_400_000_000
    disp = keyed(events).where((F.col("event_type") == "disposition") & F.col("disposition").isin("rpc", "promise_to_pay"))
    pay = events.where(F.col("event_type") == "payment").dropna(subset=["lender_id", "borrower_id", "occurred_at"])
    slot = F.floor(F.unix_micros("occurred_at") / width)
    q = disp.select(*CP_KEYS, F.unix_micros("occurred_at").alias("d_us"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    p = pay.select(*BORROWER, F.col("event_id").alias("payment_id"), F.unix_micros("occurred_at").alias("p_us"), slot.alias("slot"))
    gap = F.col("p_us") - F.col("d_us")
    return (
        p.join(q, [*BORROWER, "slot"])
        .where((gap >= 0) & (gap < width))
        .groupBy(*CP_KEYS)
        .agg(F.count_distinct("payment_id").alias("n_confirmed"), F.max("p_us").alias("last_confirmed_us"))
    )


def other_lines(events: DataFrame, as_of: Column, windows: Sequence[int] = WINDOWS_DAYS) -> DataFrame:
    """Attempts and answers on a borrower's other contact points, and the latest answer there."""
    dials = keyed(events).where((F.col("event_type") == "dial_attempt") & (F.col("occurred_at") <= as_of))
    answered = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    inside = lambda w: F.col("occurred_at") > as_of - F.expr(f"INTERVAL '{w}' DAY")
    own = dials.groupBy(*CP_KEYS).agg(
        *[F.count_if(inside(w)).alias(f"a{w}") for w in windows],
        *[F.count_if(inside(w) & answered).alias(f"b{w}") for w in windows],
        F.max(F.when(answered, F.col("occurred_at"))).alias("last_answer"),
    )
    total = own.groupBy(*BORROWER).agg(
        *[F.sum(f"a{w}").alias(f"ta{w}") for w in windows],
        *[F.sum(f"b{w}").alias(f"tb{w}") for w in windows],
        F.max_by("contact_point_ref", F.struct("last_answer", "contact_point_ref")).alias("top_ref"),
        F.max("last_answer").alias("top"),
    )
    joined = own.join(total, list(BORROWER))
    second = joined.where(F.col("contact_point_ref") != F.col("top_ref")).groupBy(*BORROWER).agg(F.max("last_answer").alias("second"))
    joined = joined.join(second, list(BORROWER), "left")
    cols = []
    for w in windows:
        a, b = F.col(f"ta{w}") - F.col(f"a{w}"), F.col(f"tb{w}") - F.col(f"b{w}")
        cols += [a.alias(f"other_attempts_{w}d"), b.alias(f"other_answered_{w}d"), ratio(b, a).alias(f"other_answer_rate_{w}d")]
    other = F.when(F.col("contact_point_ref") == F.col("top_ref"), F.col("second")).otherwise(F.col("top"))
    return joined.select(*CP_KEYS, *cols, days_since(as_of, other).alias("days_since_last_other_line_answer"))


def payments_window(events: DataFrame, as_of: Column, windows: Sequence[int] = WINDOWS_DAYS) -> DataFrame:
    pay = events.where((F.col("event_type") == "payment") & (F.col("occurred_at") <= as_of)).dropna(subset=list(BORROWER))
    inside = lambda w: F.col("occurred_at") > as_of - F.expr(f"INTERVAL '{w}' DAY")
    return pay.groupBy(*BORROWER).agg(*[F.count_if(inside(w)).alias(f"n_payments_{w}d") for w in windows], days_since(as_of, F.max("occurred_at")).alias("days_since_last_payment"))


def visits(events: DataFrame, as_of: Column) -> DataFrame:
    v = keyed(events).where((F.col("event_type") == "field_visit") & (F.col("occurred_at") <= as_of))
    when = local(F.coalesce("visit_time", "occurred_at"))
    hour = F.hour(when) + F.minute(when) / F.lit(60.0)
    last = F.max_by("outcome", F.struct("occurred_at", "received_at", "event_id"))
    return v.groupBy(*CP_KEYS).agg(
        F.count(F.lit(1)).alias("n_visits"),
        *[F.count_if(F.coalesce(F.col("outcome") == o, F.lit(False))).alias(f"n_{o}") for o in VISIT_OUTCOMES],
        F.avg("dwell_seconds").alias("mean_dwell_seconds"),
        F.avg(hour).alias("mean_visit_hour"),
        last.alias("last_outcome"),
        days_since(as_of, F.max("occurred_at")).alias("days_since_last_visit"),
    )
