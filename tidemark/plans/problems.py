"""Queries p1, p2, p6 and p7 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import instant, is_filler, micros, plausible
from tidemark.operators.deliver_once import deliver_once
from tidemark.operators.entity_vectors import column_stems, expand, sparse_cells, sparse_vectors, type_vocabulary
from tidemark.operators.late_events import correct_late, current_watermarks, hot_keys, new_dirty_marks
from tidemark.operators.rolling import rolling_totals
from tidemark.session import Scratch
from tidemark.sources.tables import contact_events, once, table

#: Ring times outside this range (seconds) are no measurement; the attempt still counts.
RING_RANGE = (0.0, 3600.0)
NUMBER_SCHEMA = "ring_seconds string, dwell_seconds string, amount string, units string"


def payload_number() -> Column:
    """The number of an event's payload (ring or dwell seconds, amount or units), null if none."""
    p = F.from_json("payload", NUMBER_SCHEMA)
    num = lambda k: p[k].try_cast("double")
    return (
        F.when(F.col("event_type") == "dial_attempt", plausible(num("ring_seconds"), *RING_RANGE))
        .when(F.col("event_type") == "field_visit", num("dwell_seconds"))
        .when(F.col("event_type") == "payment", num("amount"))
        .when(~F.col("event_type").isin("disposition", "bot_transcript", "contact_point_update"), num("units"))
    )


def payload_milli() -> Column:
    return F.round(payload_number() * 1000).cast("bigint")


# p1 ------------------------------------------------------------------------------------------


def _late(spark: SparkSession, d: str, amounts: bool) -> dict[str, DataFrame]:
    amount = (payload_milli() if amounts else F.lit(0).cast("bigint")).alias("amount")
    ev = once(spark, d, "contact_point_ref", "lender_id", "occurred_at", amount)
    hot = hot_keys(contact_events(spark, d, "contact_point_ref", "lender_id"))
    return correct_late(ev, current_watermarks(table(spark, d, "watermarks")), Scratch(spark, "late"), hot=hot)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hit = _late(spark, d, False)["replayed"].where(F.col("n_late") > 0)
    return hit.select("contact_point_ref", "lender_id", F.date_format("event_day", "yyyy-MM-dd").alias("event_day"))


def p1_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _late(spark, d, True)["daily"]
    return out.select(
        "contact_point_ref",
        "lender_id",
        F.date_format("event_day", "yyyy-MM-dd").alias("event_day"),
        "n_events",
        (F.col("amount") / 1000.0).alias("amount"),
        "n_to_date",
        (F.col("amount_to_date") / 1000.0).alias("amount_to_date"),
        "n_late",
        "n_too_late",
    )


def p1_new_dirty(spark: SparkSession, d: str) -> DataFrame:
    new = new_dirty_marks(_late(spark, d, False)["dirty"], table(spark, d, "dirty_contact_points"))
    return new.select("contact_point_ref", "lender_id", "reason", F.date_format("first_late_day", "yyyy-MM-dd").alias("first_late_day"))


# p2 ------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = deliver_once(contact_events(spark, d, "event_id", "received_at", "ingested_at"))
    return out.where(F.col("n_copies") > 1).select("event_id")


def p2_once(spark: SparkSession, d: str) -> DataFrame:
    return deliver_once(contact_events(spark, d)).select(
        "event_id", "event_type", "account_id", "contact_point_ref", micros(instant(F.col("received_at"))).alias("received_us"), "payload", "n_copies"
    )


# p6 ------------------------------------------------------------------------------------------


def entity_events(spark: SparkSession, d: str) -> DataFrame:
    ev = once(spark, d, "contact_point_ref", "event_type", "occurred_at", payload_milli().alias("amount"))
    return ev.where(~is_filler(F.col("contact_point_ref")))


def p6_features(spark: SparkSession, d: str, as_of=None) -> DataFrame:
    """``as_of`` defaults to the latest ``ingested_at``, so that every event is visible."""
    log = contact_events(spark, d, "event_type", "ingested_at")
    when = F.lit(as_of if as_of is not None else log.agg(F.max("ingested_at")).first()[0]).cast("timestamp")
    types = type_vocabulary(log)
    ev = entity_events(spark, d).where(F.col("received_at") <= when)
    return expand(sparse_vectors(ev, types), types, when)


def p6_cells(spark: SparkSession, d: str, as_of=None) -> DataFrame:
    """The same in the long form, which has no bound on the number of types."""
    when = F.lit(as_of if as_of is not None else contact_events(spark, d, "ingested_at").agg(F.max("ingested_at")).first()[0]).cast("timestamp")
    cells = sparse_cells(entity_events(spark, d).where(F.col("received_at") <= when))
    return cells.select(F.col("entity").alias("contact_point_ref"), "event_type", "n", F.datediff(F.to_date(when), F.to_date("last")).alias("days"), (F.col("total") / F.lit(1000.0)).alias("total"))


# p7 ------------------------------------------------------------------------------------------


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    ev = once(spark, d, "contact_point_ref", "event_type", "occurred_at", payload_number().alias("value"))
    dials = ev.where((F.col("event_type") == "dial_attempt") & ~is_filler(F.col("contact_point_ref")))
    return rolling_totals(dials.select("contact_point_ref", "occurred_at", "value"))


QUERIES = {
    "p1_found": p1_found,
    "p1_daily": p1_daily,
    "p1_new_dirty": p1_new_dirty,
    "p2_found": p2_found,
    "p2_once": p2_once,
    "p6_features": p6_features,
    "p6_cells": p6_cells,
    "p7_rolling": p7_rolling,
}

RAW = r"""raw AS (
  SELECT * EXCLUDE (event_id, occurred_at, received_at),
    CASE WHEN regexp_matches(h, '^[0-9a-f]{32}$') THEN concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12))
         ELSE nullif(lower(trim(event_id)), '') END AS event_id,
    try_cast(occurred_at AS TIMESTAMPTZ) AS occurred_at, try_cast(received_at AS TIMESTAMPTZ) AS received_at
  FROM (SELECT *, regexp_replace(replace(lower(event_id), 'urn:uuid:', ''), '[^0-9a-z]', '', 'g') AS h FROM contact_events)
)"""
ONCE = RAW + """, once AS (
  SELECT * FROM raw WHERE event_id IS NULL
  UNION ALL
  SELECT * FROM raw WHERE event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST, ingested_at) = 1
)"""
FILLER = "({0} IS NULL OR lower(trim({0})) IN ('','unknown','na','n/a','none','null','nil','-','test','dummy','undefined') OR regexp_matches(trim({0}), '^[0._-]+$'))"
NUMBER = """CASE
    WHEN event_type = 'dial_attempt' THEN CASE WHEN try_cast(payload->>'ring_seconds' AS DOUBLE) BETWEEN 0 AND 3600 THEN try_cast(payload->>'ring_seconds' AS DOUBLE) END
    WHEN event_type = 'field_visit' THEN try_cast(payload->>'dwell_seconds' AS DOUBLE)
    WHEN event_type = 'payment' THEN try_cast(payload->>'amount' AS DOUBLE)
    WHEN event_type NOT IN ('disposition', 'bot_transcript', 'contact_point_update') THEN try_cast(payload->>'units' AS DOUBLE) END"""
MARKS = """marks AS (
  SELECT contact_point_ref, lender_id, watermark_ts FROM watermarks WHERE updated_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY contact_point_ref, lender_id ORDER BY updated_at DESC, watermark_ts DESC NULLS LAST) = 1
)"""
KINDS = f"""kinds AS (
  SELECT e.contact_point_ref, e.lender_id, strftime(e.occurred_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS event_day,
    coalesce(CAST(round(({NUMBER}) * 1000) AS BIGINT), 0) AS v,
    CASE WHEN e.occurred_at < m.watermark_ts AND e.received_at > m.watermark_ts
         THEN CASE WHEN e.received_at <= e.occurred_at + INTERVAL 7 DAY THEN 1 ELSE 2 END ELSE 0 END AS kind
  FROM once e LEFT JOIN marks m USING (contact_point_ref, lender_id)
  WHERE e.contact_point_ref IS NOT NULL AND e.lender_id IS NOT NULL AND e.occurred_at IS NOT NULL
)"""

CELLS = f"""WITH {ONCE}, cut AS (SELECT max(ingested_at) AS as_of FROM contact_events),
ev AS (SELECT contact_point_ref, coalesce(nullif(trim(event_type), ''), 'untyped') AS kind, occurred_at, as_of,
    CAST(round(({NUMBER}) * 1000) AS BIGINT) AS v
  FROM once, cut WHERE received_at <= as_of AND NOT {FILLER.format('contact_point_ref')}),
cells AS (SELECT contact_point_ref, kind, count(*) AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS v,
    CAST(datediff('day', CAST(max(occurred_at) AT TIME ZONE 'UTC' AS DATE), CAST(max(as_of) AT TIME ZONE 'UTC' AS DATE)) AS INTEGER) AS days
  FROM ev GROUP BY 1, 2) """


def features_sql(types: list[str]) -> str:
    """The wide table by one conditional aggregate for each column of a list of types."""
    cols = []
    for t, stem in zip(types, column_stems(types), strict=True):
        own = "FILTER (WHERE kind = '" + t.replace("'", "''") + "')"
        cols += [f"coalesce(max(n) {own}, 0) AS {stem}_n", f"max(days) {own} AS {stem}_days", f"coalesce(max(v) {own}, 0) / 1000.0 AS {stem}_total"]
    return CELLS + "SELECT contact_point_ref, " + ", ".join(cols) + " FROM cells GROUP BY 1"


def sql_for(folder: str) -> dict[str, str]:
    """``SQL`` and the statement of p6_features, whose columns are the event types of the table in ``folder``."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    try:
        column = pq.read_table(f"{folder}/contact_events.parquet", columns=["event_type"])["event_type"]
    except OSError:
        return dict(SQL)
    types = sorted({(t or "").strip(" ") or "untyped" for t in pc.unique(column).to_pylist()})
    return SQL | {"p6_features": features_sql(types)}


SQL = {
    "p1_found": f"WITH {ONCE}, {MARKS}, {KINDS} SELECT DISTINCT contact_point_ref, lender_id, event_day FROM kinds WHERE kind = 1",
    "p1_daily": f"""WITH {ONCE}, {MARKS}, {KINDS},
days AS (SELECT contact_point_ref, lender_id, event_day, count(*) FILTER (WHERE kind < 2) AS n_events,
    CAST(coalesce(sum(v) FILTER (WHERE kind < 2), 0) AS BIGINT) AS a,
    count(*) FILTER (WHERE kind = 1) AS n_late, count(*) FILTER (WHERE kind = 2) AS n_too_late
  FROM kinds GROUP BY ALL)
SELECT contact_point_ref, lender_id, event_day, n_events, a / 1000.0 AS amount,
  CAST(sum(n_events) OVER w AS BIGINT) AS n_to_date, CAST(sum(a) OVER w AS BIGINT) / 1000.0 AS amount_to_date, n_late, n_too_late
FROM days WINDOW w AS (PARTITION BY contact_point_ref, lender_id ORDER BY event_day)""",
    "p1_new_dirty": f"""WITH {ONCE}, {MARKS}, {KINDS}
SELECT contact_point_ref, lender_id, 'late_event' AS reason, min(event_day) AS first_late_day
FROM kinds WHERE kind = 1 AND (contact_point_ref, lender_id) NOT IN
  (SELECT (contact_point_ref, lender_id) FROM dirty_contact_points WHERE reason = 'late_event' AND contact_point_ref IS NOT NULL AND lender_id IS NOT NULL)
GROUP BY 1, 2""",
    "p2_found": f"WITH {RAW} SELECT event_id FROM raw WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "p2_once": f"""WITH {RAW}, c AS (SELECT event_id, count(*) AS n_copies FROM raw GROUP BY 1)
SELECT r.event_id, event_type, account_id, contact_point_ref, epoch_us(received_at) AS received_us, payload, coalesce(n_copies, 1) AS n_copies
FROM raw r LEFT JOIN c USING (event_id)
QUALIFY r.event_id IS NULL OR row_number() OVER (PARTITION BY r.event_id ORDER BY received_at NULLS LAST, ingested_at) = 1""",
    "p6_cells": CELLS + "SELECT contact_point_ref, kind AS event_type, n, days, v / 1000.0 AS total FROM cells",
    "p7_rolling": f"""WITH {ONCE},
dials AS (SELECT contact_point_ref, CAST(occurred_at AT TIME ZONE 'UTC' AS DATE) AS d, CAST(round(({NUMBER}) * 1000) AS BIGINT) AS v
  FROM once WHERE event_type = 'dial_attempt' AND occurred_at IS NOT NULL AND NOT {FILLER.format('contact_point_ref')}),
daily AS (SELECT contact_point_ref, d, count(*) AS n, count(v) AS k, coalesce(sum(v), 0) AS v FROM dials GROUP BY 1, 2),
grid AS (SELECT contact_point_ref, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY 1),
g AS (SELECT contact_point_ref, d, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(v, 0) AS v FROM grid LEFT JOIN daily USING (contact_point_ref, d)),
s AS (SELECT contact_point_ref, d, sum(n) OVER a AS n7, sum(k) OVER a AS k7, sum(v) OVER a AS v7, sum(n) OVER b AS n30, sum(k) OVER b AS k30, sum(v) OVER b AS v30 FROM g
  WINDOW a AS (PARTITION BY contact_point_ref ORDER BY d ROWS 6 PRECEDING), b AS (PARTITION BY contact_point_ref ORDER BY d ROWS 29 PRECEDING))
SELECT contact_point_ref, strftime(d, '%Y-%m-%d') AS day,
  CAST(n7 AS BIGINT) AS attempts_7d, CAST(v7 AS BIGINT) / 1000.0 AS total_7d, CASE WHEN k7 > 0 THEN CAST(v7 AS BIGINT) / 1000.0 / CAST(k7 AS BIGINT) END AS avg_7d,
  CAST(n30 AS BIGINT) AS attempts_30d, CAST(v30 AS BIGINT) / 1000.0 AS total_30d, CASE WHEN k30 > 0 THEN CAST(v30 AS BIGINT) / 1000.0 / CAST(k30 AS BIGINT) END AS avg_30d
FROM s""",
}
