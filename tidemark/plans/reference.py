"""Queries of the engine's own operators over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import CUES, DISPOSITIONS, NUMBER_WORDS, SLOTS, VISIT_OUTCOMES, WINDOWS_DAYS, any_of
from tidemark.operators import sharing, telephony
from tidemark.plans.problems import ONCE
from tidemark.session import Scratch
from tidemark.sources.pit import CP_KEYS, ParquetSource

AS_OF = "2026-07-04 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def seen(spark: SparkSession, d: str) -> DataFrame:
    return ParquetSource(spark, d).visible(as_of())


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


KEYS = ", ".join(CP_KEYS)
HAVE_KEYS = " AND ".join(f"{k} IS NOT NULL" for k in CP_KEYS)
T0 = f"TIMESTAMPTZ '{AS_OF}+00'"
CLEAN = r"""regexp_replace(regexp_replace(lower(payload->>'network_response'), '\s*(\(\s*\d+\s*\)|[/:#-]\s*\d+)\s*$', ''), '[^a-z0-9]', '', 'g')"""
RESPONSE = f"CASE {CLEAN} " + " ".join(f"WHEN '{n.replace('_', '')}' THEN '{n}'" for n in ("answered", "no_answer", "busy", "switched_off", "not_reachable", "does_not_exist", "immediate_hangup")) + f" ELSE nullif({CLEAN}, '') END"
TEXT = "nullif(trim(payload->>'{0}'), '')"
TYPED = (
    ONCE
    + f""", typed AS (SELECT event_id, event_type, lender_id, borrower_id, account_id, contact_point_ref, occurred_at, received_at,
  CASE WHEN event_type = 'dial_attempt' THEN {RESPONSE} END AS network_response,
  CASE WHEN event_type = 'dial_attempt' AND try_cast(payload->>'ring_seconds' AS DOUBLE) BETWEEN 0 AND 3600 THEN try_cast(payload->>'ring_seconds' AS DOUBLE) END AS ring_seconds,
  CASE WHEN event_type = 'disposition' THEN lower({TEXT.format('disposition')}) END AS disposition,
  CASE WHEN event_type IN ('disposition', 'field_visit') THEN {TEXT.format('agent_id')} END AS agent_id,
  CASE WHEN event_type IN ('disposition', 'field_visit') THEN {TEXT.format('remarks')} END AS remarks,
  CASE WHEN event_type = 'field_visit' THEN lower({TEXT.format('outcome')}) END AS outcome,
  CASE WHEN event_type = 'field_visit' THEN try_cast(payload->>'visit_time' AS TIMESTAMPTZ) END AS visit_time,
  CASE WHEN event_type = 'field_visit' THEN try_cast(payload->>'dwell_seconds' AS BIGINT) END AS dwell_seconds,
  CASE WHEN event_type = 'payment' THEN try_cast(payload->>'amount' AS DOUBLE) END AS amount,
  CASE WHEN event_type = 'contact_point_update' THEN {TEXT.format('source')} END AS update_source,
  CASE WHEN event_type = 'contact_point_update' THEN try_cast(lower({TEXT.format('is_primary')}) AS BOOLEAN) END AS update_primary
  FROM once), ev AS (SELECT * FROM typed WHERE received_at <= {T0}), kev AS (SELECT * FROM ev WHERE {HAVE_KEYS})"""
)
BASE = "WITH " + TYPED + " "
IST = "({0} AT TIME ZONE 'UTC' + INTERVAL 330 MINUTE)"
DIALS = BASE + f""", dials AS (SELECT *, coalesce(network_response = 'answered', false) AS ans, extract(hour FROM {IST.format('occurred_at')}) AS h,
  isodow({IST.format('occurred_at')}) >= 6 AS we FROM kev WHERE event_type = 'dial_attempt' AND occurred_at <= {T0}) """
SINCE = f"datediff('day', CAST({{0}} AT TIME ZONE 'UTC' AS DATE), CAST({T0} AT TIME ZONE 'UTC' AS DATE))"


def _windows_sql(items: Callable[[int, str], str]) -> str:
    return DIALS + f"SELECT {KEYS}, " + ", ".join(items(w, f"occurred_at > {T0} - INTERVAL {w} DAY") for w in WINDOWS_DAYS) + " FROM dials GROUP BY ALL"


def _pick(df: DataFrame, *stems: str) -> DataFrame:
    keep = [f"{s}_{w}d" for w in WINDOWS_DAYS for s in stems]
    return rounded(df.select(*CP_KEYS, *keep))


# Scans, filters and sets ---------------------------------------------------------------------


@query(BASE + f"SELECT event_type, count(*) AS n, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(received_at)) AS last_us FROM ev GROUP BY 1")
def b22_pit_visible(spark, d):
    return seen(spark, d).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("occurred_at")).alias("first_us"), F.max(F.unix_micros("received_at")).alias("last_us")
    )


@query(BASE + f"SELECT event_type, count(*) AS n, count(DISTINCT contact_point_ref) AS n_refs FROM typed WHERE occurred_at > {T0} - INTERVAL 7 DAY AND occurred_at <= {T0} GROUP BY 1")
def b23_future_window(spark, d):
    out = ParquetSource(spark, d).future(as_of() - F.expr("INTERVAL '7' DAY"), as_of())
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contact_point_ref").alias("n_refs"))


@query(BASE + "SELECT event_id, epoch_us(received_at) AS received_us, network_response, disposition, amount FROM typed WHERE event_id IS NOT NULL")
def e1_dedupe_earliest(spark, d):
    ev = ParquetSource(spark, d).events().where(F.col("event_id").isNotNull())
    return ev.select("event_id", F.unix_micros("received_at").alias("received_us"), "network_response", "disposition", "amount")


@query(
    BASE
    + """SELECT event_type, count(network_response) AS n_response, count(ring_seconds) AS n_ring, count(disposition) AS n_disposition, count(remarks) AS n_remarks, count(outcome) AS n_outcome,
count(visit_time) AS n_visit_time, count(dwell_seconds) AS n_dwell, count(amount) AS n_amount, count(update_source) AS n_source, count(update_primary) AS n_primary FROM ev GROUP BY 1"""
)
def b25_parse_payload(spark, d):
    cols = {"network_response": "n_response", "ring_seconds": "n_ring", "disposition": "n_disposition", "remarks": "n_remarks", "outcome": "n_outcome", "visit_time": "n_visit_time", "dwell_seconds": "n_dwell", "amount": "n_amount", "update_source": "n_source", "update_primary": "n_primary"}
    return seen(spark, d).groupBy("event_type").agg(*[F.count(c).alias(n) for c, n in cols.items()])


# Trailing windows ----------------------------------------------------------------------------


@query(_windows_sql(lambda w, i: f"count(*) FILTER (WHERE {i}) AS n_attempts_{w}d, count(*) FILTER (WHERE {i} AND ans) AS n_answered_{w}d, round(count(*) FILTER (WHERE {i} AND ans)::DOUBLE / nullif(count(*) FILTER (WHERE {i}), 0), 9) AS answer_rate_{w}d"))
def d1_window_counts(spark, d):
    return _pick(telephony.dial_windows(seen(spark, d), as_of()), "n_attempts", "n_answered", "answer_rate")


@query(_windows_sql(lambda w, i: ", ".join(f"count(*) FILTER (WHERE {i} AND network_response = '{r}') AS n_{r}_{w}d" for r in telephony.RESPONSES)))
def d2_response_counts(spark, d):
    return _pick(telephony.dial_windows(seen(spark, d), as_of()), *[f"n_{r}" for r in telephony.RESPONSES])


def _slot_sql(w: int, i: str) -> str:
    cell = "count(*) FILTER (WHERE {i} AND h >= {lo} AND h < {hi}{more})"
    out = []
    for s, (lo, hi) in SLOTS.items():
        n, a = cell.format(i=i, lo=lo, hi=hi, more=""), cell.format(i=i, lo=lo, hi=hi, more=" AND ans")
        out += [f"{n} AS n_attempts_{s}_{w}d", f"round({a}::DOUBLE / nullif({n}, 0), 9) AS answer_rate_{s}_{w}d"]
    return ", ".join(out)


@query(_windows_sql(_slot_sql))
def d3_slot_counts(spark, d):
    return _pick(telephony.dial_windows(seen(spark, d), as_of()), *[f"{x}_{s}" for s in SLOTS for x in ("n_attempts", "answer_rate")])


@query(_windows_sql(lambda w, i: f"round(count(*) FILTER (WHERE {i} AND we)::DOUBLE / nullif(count(*) FILTER (WHERE {i}), 0), 9) AS weekend_attempt_share_{w}d"))
def d4_weekend_share(spark, d):
    return _pick(telephony.dial_windows(seen(spark, d), as_of()), "weekend_attempt_share")


@query(
    _windows_sql(
        lambda w, i: f"round(avg(ring_seconds) FILTER (WHERE {i}), 9) AS ring_seconds_mean_{w}d, round(stddev_samp(ring_seconds) FILTER (WHERE {i}), 6) AS ring_seconds_std_{w}d, round(count(*) FILTER (WHERE {i} AND ring_seconds < 3)::DOUBLE / nullif(count(*) FILTER (WHERE {i}), 0), 9) AS short_ring_rate_{w}d"
    )
)
def d5_ring_stats(spark, d):
    out = _pick(telephony.dial_windows(seen(spark, d), as_of()), "ring_seconds_mean", "ring_seconds_std", "short_ring_rate")
    return out.select(*[F.round(c, 6).alias(c) if "_std_" in c else F.col(c) for c in out.columns])


# Sequences -----------------------------------------------------------------------------------

SCALARS = (
    DIALS
    + f""", o AS (SELECT *, coalesce(network_response, 'missing') AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY {KEYS}) AS n, last_value(coalesce(network_response, 'missing')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv
  FROM dials WINDOW w AS (PARTITION BY {KEYS} ORDER BY occurred_at, received_at, event_id)),
sys AS (SELECT CAST({IST.format('occurred_at')} AS DATE) AS day, avg(CASE WHEN ans THEN 0.0 ELSE 1.0 END) AS f FROM dials GROUP BY 1)
SELECT {KEYS}, any_value(lv) AS last_response_type, max(n) - coalesce(max(k) FILTER (WHERE ans), 0) AS consecutive_failures, max(n) - coalesce(max(k) FILTER (WHERE v <> lv), 0) AS consecutive_same_response,
{SINCE.format('min(occurred_at)')} AS days_since_first_attempt, {SINCE.format('max(occurred_at)')} AS days_since_last_attempt, {SINCE.format('max(occurred_at) FILTER (WHERE ans)')} AS days_since_last_answer,
round((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 86400e6 / nullif(count(*) - 1, 0), 9) AS mean_gap_between_attempts_days,
round((SELECT f FROM sys WHERE day = CAST({IST.format('max(occurred_at)')} AS DATE)), 9) AS system_fail_rate_on_last_attempt_day FROM o GROUP BY ALL"""
)


@query(SCALARS)
def e2_dial_scalars(spark, d):
    """Last response, trailing runs and failures, gaps and the portfolio's failures."""
    return rounded(telephony.dial_scalars(seen(spark, d), as_of()))


CUE_SQL = ", ".join(f"count(*) FILTER (WHERE regexp_matches(remarks, '{any_of(p).replace(chr(39), chr(39) * 2)}')) AS n_{c}_cue" for c, p in CUES.items())
DISP = (
    BASE
    + f""", disp AS (SELECT * FROM kev WHERE event_type = 'disposition' AND occurred_at <= {T0}),
agents AS (SELECT lender_id, agent_id, avg(CASE WHEN disposition = 'wrong_number' THEN 1.0 ELSE 0.0 END) AS r FROM disp WHERE agent_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT {KEYS}, {", ".join(f"count(*) FILTER (WHERE disposition = '{x}') AS n_{x}" for x in DISPOSITIONS)},
  round(count(*) FILTER (WHERE disposition = 'wrong_number')::DOUBLE / count(*), 9) AS wrong_number_rate, {CUE_SQL},
  last(disposition ORDER BY occurred_at, received_at, event_id) AS last_disposition, {SINCE.format('max(occurred_at)')} AS days_since_last_disposition,
  {SINCE.format("max(occurred_at) FILTER (WHERE disposition = 'rpc')")} AS days_since_last_rpc, last(agent_id ORDER BY occurred_at, received_at, event_id) AS agent_id FROM disp GROUP BY ALL)
SELECT g.*, round(r, 9) AS agent_wrong_number_rate FROM g LEFT JOIN agents USING (lender_id, agent_id)"""
)


@query(DISP)
def d6_dispositions(spark, d):
    """Counts per disposition, cues, last disposition and its agent's wrong-number share."""
    return rounded(telephony.dispositions(seen(spark, d), as_of())).drop("max_switched_off_months")


WORDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in NUMBER_WORDS.items())
SPAN = r"(?i)\b(\d+|" + "|".join(NUMBER_WORDS) + r")\s*(mahine|mahina|mahinon|maheene|maihne|tingal\w*|months?|mnth|saals?|sal|years?)\b"


@query(
    BASE
    + f""", r AS (SELECT event_id, remarks FROM ev WHERE event_type = 'disposition' AND regexp_matches(remarks, '{any_of(CUES['switched_off'])}')),
x AS (SELECT event_id, unnest(regexp_extract_all(remarks, '{SPAN}', 1)) AS n, unnest(regexp_extract_all(remarks, '{SPAN}', 2)) AS u FROM r),
m AS (SELECT event_id, max(coalesce(try_cast(n AS BIGINT), CASE lower(n) {WORDS} END) * CASE WHEN regexp_matches(u, '(?i)^(saals?|sal|years?)$') THEN 12 ELSE 1 END) AS months FROM x GROUP BY 1)
SELECT event_id, months FROM m WHERE months > 0"""
)
def h1_months_switched_off(spark, d):
    from tidemark.functions.text import months_switched_off

    ev = seen(spark, d).where(F.col("event_type") == "disposition")
    return ev.select("event_id", months_switched_off(F.col("remarks")).alias("months")).where(F.col("months").isNotNull())


# Sharing, records, other lines, field --------------------------------------------------------

UNIV = (
    BASE
    + f""", tab AS (SELECT {KEYS}, min(try_cast(created_at AS TIMESTAMPTZ)) AS made FROM contact_points WHERE {HAVE_KEYS} AND try_cast(created_at AS TIMESTAMPTZ) <= {T0} GROUP BY ALL),
fs AS (SELECT {KEYS}, min(occurred_at) AS first_seen FROM kev GROUP BY ALL),
univ AS (SELECT {KEYS}, coalesce(made, first_seen) AS created_at, made IS NOT NULL AS in_table FROM tab FULL JOIN fs USING ({KEYS})) """
)


def _universe(spark, d):
    return sharing.universe(seen(spark, d), ParquetSource(spark, d).contact_points(as_of()))


@query(UNIV + f"SELECT {KEYS}, epoch_us(created_at) AS created_us, in_table FROM univ")
def c7_universe_outer(spark, d):
    return _universe(spark, d).select(*CP_KEYS, F.unix_micros("created_at").alias("created_us"), "in_table")


@query(
    UNIV
    + f"""SELECT {KEYS}, n_borrowers, n_borrowers > 1 AS is_shared, n_contacts, row_number() OVER (PARTITION BY lender_id, borrower_id ORDER BY created_at NULLS LAST, contact_point_ref) AS cp_rank
FROM univ JOIN (SELECT lender_id, contact_point_ref, count(DISTINCT borrower_id) AS n_borrowers FROM univ GROUP BY ALL) USING (lender_id, contact_point_ref)
JOIN (SELECT lender_id, borrower_id, count(DISTINCT contact_point_ref) AS n_contacts FROM univ GROUP BY ALL) USING (lender_id, borrower_id)"""
)
def d8_shared_counts(spark, d):
    """Shared contacts, contacts per borrower and rank by age."""
    return sharing.shared_counts(_universe(spark, d))


@query(
    f"""WITH RECURSIVE cp AS (SELECT DISTINCT lender_id, borrower_id, contact_point_ref FROM contact_points WHERE {HAVE_KEYS} AND try_cast(created_at AS TIMESTAMPTZ) <= {T0}),
e AS (SELECT DISTINCT a.lender_id, a.borrower_id AS x, b.borrower_id AS y FROM cp a JOIN cp b USING (lender_id, contact_point_ref)),
r AS (SELECT lender_id, borrower_id AS x, borrower_id AS y FROM (SELECT DISTINCT lender_id, borrower_id FROM cp) UNION SELECT r.lender_id, r.x, e.y FROM r JOIN e ON e.lender_id = r.lender_id AND e.x = r.y)
SELECT lender_id, x AS borrower_id, min(y) AS component, count(*) AS n_borrowers FROM r GROUP BY 1, 2"""
)
def d9_components(spark, d):
    links = ParquetSource(spark, d).contact_points(as_of())
    return sharing.component_sizes(links, Scratch(spark, "components"))


@query(
    BASE
    + f"""SELECT {KEYS}, count(*) AS n_updates, {SINCE.format("last(occurred_at ORDER BY received_at, occurred_at, event_id)")} AS days_since_last_update,
last(update_source ORDER BY received_at, occurred_at, event_id) AS last_source, last(update_primary ORDER BY received_at, occurred_at, event_id) AS last_primary FROM kev WHERE event_type = 'contact_point_update' GROUP BY ALL"""
)
def d10_record_history(spark, d):
    return sharing.record_history(seen(spark, d), as_of())


@query(
    BASE
    + """, p AS (SELECT lender_id, borrower_id, event_id AS payment_id, occurred_at FROM ev WHERE event_type = 'payment' AND lender_id IS NOT NULL AND borrower_id IS NOT NULL),
q AS (SELECT lender_id, borrower_id, occurred_at, max(event_id) AS event_id FROM ev WHERE event_type = 'disposition' AND disposition IN ('rpc', 'promise_to_pay') AND lender_id IS NOT NULL AND borrower_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT p.lender_id, p.borrower_id, payment_id, epoch_us(q.occurred_at) AS prev_us, q.event_id AS prev_event_id FROM p ASOF LEFT JOIN q ON p.lender_id = q.lender_id AND p.borrower_id = q.borrower_id AND p.occurred_at >= q.occurred_at"""
)
def c9_asof_backward(spark, d):
    """For each payment the latest qualifying disposition of its borrower at or before it."""
    ev = seen(spark, d).dropna(subset=["lender_id", "borrower_id"])
    pay = ev.where(F.col("event_type") == "payment").select("lender_id", "borrower_id", F.col("event_id").alias("payment_id"), "occurred_at")
    disp = ev.where((F.col("event_type") == "disposition") & F.col("disposition").isin("rpc", "promise_to_pay")).select("lender_id", "borrower_id", "event_id", "occurred_at")
    out = sharing.asof_backward(pay, disp, ["lender_id", "borrower_id"], "occurred_at", ["event_id"])
    return out.select("lender_id", "borrower_id", "payment_id", F.unix_micros("prev_occurred_at").alias("prev_us"), "prev_event_id")


@query(
    BASE
    + f"""SELECT q.lender_id, q.borrower_id, q.contact_point_ref, count(DISTINCT p.event_id) AS n_confirmed, epoch_us(max(p.occurred_at)) AS last_confirmed_us
FROM kev q JOIN ev p ON p.lender_id = q.lender_id AND p.borrower_id = q.borrower_id AND p.occurred_at >= q.occurred_at AND p.occurred_at < q.occurred_at + INTERVAL 8 DAY
WHERE q.event_type = 'disposition' AND q.disposition IN ('rpc', 'promise_to_pay') AND p.event_type = 'payment' GROUP BY ALL"""
)
def c10_interval_join(spark, d):
    return sharing.payment_confirmations(seen(spark, d))


def _other_sql() -> str:
    own = ", ".join(f"count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL {w} DAY) AS a{w}, count(*) FILTER (WHERE ans AND occurred_at > {T0} - INTERVAL {w} DAY) AS b{w}" for w in WINDOWS_DAYS)
    cols = ", ".join(
        f"CAST(sum(a{w}) OVER b - a{w} AS BIGINT) AS other_attempts_{w}d, CAST(sum(b{w}) OVER b - b{w} AS BIGINT) AS other_answered_{w}d, round((sum(b{w}) OVER b - b{w})::DOUBLE / nullif(sum(a{w}) OVER b - a{w}, 0), 9) AS other_answer_rate_{w}d"
        for w in WINDOWS_DAYS
    )
    last = f"(SELECT max(la) FROM own o2 WHERE o2.lender_id = own.lender_id AND o2.borrower_id = own.borrower_id AND o2.contact_point_ref <> own.contact_point_ref)"
    return DIALS + f", own AS (SELECT {KEYS}, {own}, max(occurred_at) FILTER (WHERE ans) AS la FROM dials GROUP BY ALL) SELECT {KEYS}, {cols}, {SINCE.format(last)} AS days_since_last_other_line_answer FROM own WINDOW b AS (PARTITION BY lender_id, borrower_id)"


@query(_other_sql())
def d11_other_lines(spark, d):
    """Activity on a borrower's other lines and the latest answer there."""
    return rounded(sharing.other_lines(seen(spark, d), as_of()))


@query(
    BASE
    + "SELECT lender_id, borrower_id, "
    + ", ".join(f"count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL {w} DAY) AS n_payments_{w}d" for w in WINDOWS_DAYS)
    + f", {SINCE.format('max(occurred_at)')} AS days_since_last_payment FROM ev WHERE event_type = 'payment' AND occurred_at <= {T0} AND lender_id IS NOT NULL AND borrower_id IS NOT NULL GROUP BY 1, 2"
)
def d12_payments_window(spark, d):
    return sharing.payments_window(seen(spark, d), as_of())


VISIT = IST.format("coalesce(visit_time, occurred_at)")


@query(
    BASE
    + f"""SELECT {KEYS}, count(*) AS n_visits, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in VISIT_OUTCOMES)}, round(avg(dwell_seconds), 9) AS mean_dwell_seconds,
round(avg(extract(hour FROM {VISIT}) + extract(minute FROM {VISIT}) / 60.0), 9) AS mean_visit_hour, last(outcome ORDER BY occurred_at, received_at, event_id) AS last_outcome,
{SINCE.format('max(occurred_at)')} AS days_since_last_visit FROM kev WHERE event_type = 'field_visit' AND occurred_at <= {T0} GROUP BY ALL"""
)
def d13_visits(spark, d):
    return rounded(sharing.visits(seen(spark, d), as_of()))


# Labels, modes and splits --------------------------------------------------------------------

from tidemark.operators import labels, metrics, ranking  # noqa: E402

T1 = f"({T0} - INTERVAL 7 DAY)"
PAIRS = (
    BASE
    + """, pairs AS (SELECT account_id, contact_point_ref, occurred_at, bool_or(event_type = 'dial_attempt') AS has_dial, bool_or(coalesce(event_type = 'dial_attempt' AND network_response = 'answered', false)) AS answered,
  bool_or(coalesce(event_type = 'disposition' AND disposition IN ('rpc', 'promise_to_pay', 'callback', 'dispute'), false)) AS good, bool_or(coalesce(event_type = 'disposition' AND disposition = 'rpc', false)) AS st
  FROM ev WHERE event_type IN ('dial_attempt', 'disposition') AND account_id IS NOT NULL AND contact_point_ref IS NOT NULL AND occurred_at IS NOT NULL GROUP BY 1, 2, 3) """
)


def _week_ago():
    return as_of() - F.expr("INTERVAL '7' DAY")


@query(PAIRS + "SELECT account_id, contact_point_ref, epoch_us(occurred_at) AS us, has_dial, answered, answered AND good AS is_rpc, answered AND st AS is_strict FROM pairs")
def c15_companion_pair(spark, d):
    return labels.companion_pairs(seen(spark, d)).select("account_id", "contact_point_ref", F.unix_micros("occurred_at").alias("us"), "has_dial", "answered", "is_rpc", "is_strict")


@query(
    PAIRS
    + f"""SELECT account_id, contact_point_ref, coalesce(n, 0) AS n_dials, rpc, strict, n IS NULL AS censored
FROM (SELECT DISTINCT account_id, contact_point_ref FROM ev WHERE account_id IS NOT NULL AND contact_point_ref IS NOT NULL)
LEFT JOIN (SELECT account_id, contact_point_ref, count(*) AS n, bool_or(answered AND good) AS rpc, bool_or(answered AND st) AS strict FROM pairs WHERE has_dial AND occurred_at > {T1} AND occurred_at <= {T0} GROUP BY 1, 2) USING (account_id, contact_point_ref)"""
)
def d16_rpc_labels(spark, d):
    """Censored right-party-contact labels of the last week."""
    ev = seen(spark, d)
    return labels.rpc_labels(ev, labels.companion_pairs(ev), _week_ago(), as_of())


@query(PAIRS + f"SELECT account_id, contact_point_ref, bool_or(answered AND good) AS ever_rpc FROM pairs WHERE occurred_at <= {T1} GROUP BY 1, 2")
def d17_ever_rpc(spark, d):
    return labels.ever_rpc(labels.companion_pairs(seen(spark, d)), _week_ago())


@query(
    BASE
    + f"""SELECT {KEYS}, coalesce(bool_or(event_type = 'disposition' AND disposition IN ('rpc', 'promise_to_pay', 'callback', 'dispute')), false) AS rpc_next, bool_or(event_type = 'dial_attempt') AS dialled_next
FROM kev WHERE occurred_at > {T1} AND occurred_at <= {T0} GROUP BY ALL"""
)
def d18_feature_labels(spark, d):
    ev = telephony.keyed(seen(spark, d)).where((F.col("occurred_at") > _week_ago()) & (F.col("occurred_at") <= as_of()))
    rpc = (F.col("event_type") == "disposition") & F.col("disposition").isin("rpc", "promise_to_pay", "callback", "dispute")
    return ev.groupBy(*CP_KEYS).agg(F.coalesce(F.bool_or(rpc), F.lit(False)).alias("rpc_next"), F.bool_or(F.col("event_type") == "dial_attempt").alias("dialled_next"))


@query(
    PAIRS
    + f"""SELECT DISTINCT r.account_id, r.contact_point_ref FROM pairs r JOIN ev p ON p.event_type = 'payment' AND p.account_id = r.account_id AND p.occurred_at >= r.occurred_at AND p.occurred_at <= r.occurred_at + INTERVAL 7 DAY AND p.occurred_at <= {T0}
WHERE r.answered AND r.good AND r.occurred_at <= {T0}"""
)
def c11_pay_weak(spark, d):
    ev = seen(spark, d)
    return labels.weak_payment_labels(labels.companion_pairs(ev), ev.where(F.col("event_type") == "payment"), as_of())


@query(
    BASE
    + """, s AS (SELECT DISTINCT account_id, occurred_at AS start FROM ev WHERE event_type = 'contact_point_update' AND update_source = 'skip_trace' AND account_id IS NOT NULL), p AS (SELECT account_id, occurred_at FROM ev WHERE event_type = 'payment'),
x AS (SELECT s.*, s.start + INTERVAL 30 DAY > (SELECT max(occurred_at) FROM p) AS censored, EXISTS (SELECT 1 FROM p WHERE p.account_id = s.account_id AND p.occurred_at > s.start AND p.occurred_at <= s.start + INTERVAL 30 DAY) AS paid FROM s)
SELECT account_id, epoch_us(start) AS start_us, CASE WHEN NOT censored THEN paid END AS paid, censored FROM x"""
)
def c12_trace_paid(spark, d):
    ev = seen(spark, d)
    starts = ev.where((F.col("event_type") == "contact_point_update") & (F.col("update_source") == "skip_trace")).select("account_id", F.col("occurred_at").alias("start"))
    out = labels.paid_after(starts, ev.where(F.col("event_type") == "payment"), 30)
    return out.select("account_id", F.unix_micros("start").alias("start_us"), "paid", "censored")


@query(
    BASE
    + """, s AS (SELECT account_id, max(occurred_at) AS at FROM ev WHERE event_type = 'contact_point_update' AND update_source = 'skip_trace' AND account_id IS NOT NULL GROUP BY 1)
SELECT s.account_id, count(*) AS n_before, count(*) FILTER (WHERE network_response = 'answered') AS n_answered_before FROM s JOIN ev e ON e.account_id = s.account_id AND e.event_type = 'dial_attempt' AND e.occurred_at <= s.at GROUP BY 1"""
)
def c13_pre_trace(spark, d):
    ev = seen(spark, d)
    at = ev.where((F.col("event_type") == "contact_point_update") & (F.col("update_source") == "skip_trace")).dropna(subset=["account_id"]).groupBy("account_id").agg(F.max("occurred_at").alias("at"))
    dials = ev.where(F.col("event_type") == "dial_attempt").select("account_id", "occurred_at", "network_response")
    return dials.join(at, "account_id").where(F.col("occurred_at") <= F.col("at")).groupBy("account_id").agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.coalesce(F.col("network_response") == "answered", F.lit(False))).alias("n_answered_before"))


@query(
    BASE
    + """SELECT contact_point_ref, account_id, n FROM (SELECT contact_point_ref, account_id, count(*) AS n FROM ev WHERE contact_point_ref IS NOT NULL AND account_id IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY contact_point_ref ORDER BY n DESC, account_id) = 1"""
)
def d14_modal_account(spark, d):
    return labels.mode_of(seen(spark, d).where(F.col("contact_point_ref").isNotNull()), ["contact_point_ref"], "account_id").select("contact_point_ref", "account_id", "n")


@query("SELECT account_id, CAST((('0x' || substr(sha256(account_id), 1, 16))::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr(sha256(account_id), 17, 16))::UHUGEINT) % 5 AS BIGINT) AS fold_high FROM accounts WHERE account_id IS NOT NULL")
def m2_account_folds(spark, d):
    """Fold of the upper 128 bits by the operator's own arithmetic, as SQL can check it."""
    acc = spark.read.parquet(f"{d}/accounts.parquet").where(F.col("account_id").isNotNull())
    digest = F.sha2("account_id", 256)
    rest = F.lit(0).cast("bigint")
    for i in range(0, 32, 8):
        rest = F.pmod(rest * (16**8 % 5) + F.conv(F.substring(digest, i + 1, 8), 16, 10).cast("bigint"), F.lit(5))
    return acc.select("account_id", rest.cast("bigint").alias("fold_high"))


# Metrics -------------------------------------------------------------------------------------

SCORED = (
    BASE
    + f""", h AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (WHERE network_response = 'answered') AS a FROM kev WHERE event_type = 'dial_attempt' AND occurred_at <= {T1} AND received_at <= {T1} GROUP BY ALL),
l AS (SELECT {KEYS}, max(CASE WHEN network_response = 'answered' THEN 1 ELSE 0 END) AS y FROM kev WHERE event_type = 'dial_attempt' AND occurred_at > {T1} AND occurred_at <= {T0} GROUP BY ALL),
scored AS (SELECT {KEYS}, y, round((coalesce(a, 0) + 1) / (coalesce(n, 0) + 2.0), 3) AS p FROM l LEFT JOIN h USING ({KEYS})) """
)


def scored_rows(spark, d) -> DataFrame:
    """Contact points dialled in the last week: answered then, and the answer rate before."""
    src = ParquetSource(spark, d)
    dials = telephony.keyed(src.visible(as_of())).where(F.col("event_type") == "dial_attempt")
    ans = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    before = (F.col("occurred_at") <= _week_ago()) & (F.col("received_at") <= _week_ago())
    after = (F.col("occurred_at") > _week_ago()) & (F.col("occurred_at") <= as_of())
    agg = dials.groupBy(*CP_KEYS).agg(F.count_if(before).alias("n"), F.count_if(before & ans).alias("a"), F.count_if(after).alias("m"), F.max(F.when(after, ans.cast("int"))).alias("y"))
    return agg.where(F.col("m") > 0).select(*CP_KEYS, "y", F.round((F.col("a") + 1) / (F.col("n") + F.lit(2.0)), 3).alias("p"))


@query(
    SCORED
    + """, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM scored)
SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc FROM r"""
)
def d24_roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored_rows(spark, d)))


@query(
    SCORED
    + """, c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER (ORDER BY p DESC) AS cp FROM c)
SELECT round(sum(pos * cp::DOUBLE / cn) / sum(pos), 9) AS average_precision FROM s"""
)
def d25_pr_auc(spark, d):
    return rounded(metrics.pr_auc(scored_rows(spark, d)))


@query(
    SCORED
    + """SELECT lender_id, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss, round(avg(-(5.0 * y * ln(p) + (1 - y) * ln(1 - p))), 9) AS cost_weighted_loss FROM scored GROUP BY 1"""
)
def d26_brier_logloss(spark, d):
    """Brier score, log loss and cost-weighted loss per lender."""
    return rounded(metrics.pointwise(scored_rows(spark, d), ["lender_id"], 5.0, 1.0))


BIN = "CASE " + " ".join(f"WHEN p <= {k / 10} THEN {k}" for k in range(1, 10)) + " ELSE 10 END"


@query(
    SCORED
    + f"""SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mp, 9) AS mean_p, round(r, 9) AS rate FROM generate_series(1, 10) t(b) LEFT JOIN (SELECT {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scored GROUP BY 1) USING (b)"""
)
def d22_reliability(spark, d):
    return rounded(metrics.reliability(scored_rows(spark, d), spark))


@query(SCORED + f"SELECT lender_id, round(sum(n * abs(r - mp)) / sum(n), 9) AS ece FROM (SELECT lender_id, {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scored GROUP BY 1, 2) GROUP BY 1")
def d23_ece(spark, d):
    return rounded(metrics.calibration_error(scored_rows(spark, d), ["lender_id"]))


@query(
    SCORED
    + """, x AS (SELECT t AS threshold, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn FROM scored, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75)) v(t) GROUP BY 1)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall FROM x"""
)
def d27_pr_thresholds(spark, d):
    return rounded(metrics.at_thresholds(scored_rows(spark, d), [0.1, 0.25, 0.5, 0.75]))


@query(SCORED + f"SELECT count(*) AS k, round(sum(y) * 1000.0 / count(*), 9) AS per_1000 FROM (SELECT * FROM scored ORDER BY p DESC, concat_ws('|', {KEYS}) LIMIT 100)")
def d29_rpc_per_1000(spark, d):
    return rounded(metrics.top_hits(scored_rows(spark, d).withColumn("id", F.concat_ws("|", *CP_KEYS)), 100, "id"))


@query(SCORED + "SELECT round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM (SELECT least(20.0, 1.0 / greatest(0.05, least(0.95, p))) AS w FROM scored)")
def d34_ess(spark, d):
    w = F.least(F.lit(20.0), 1.0 / F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("p"))))
    return rounded(metrics.effective_sample_size(scored_rows(spark, d).select(w.alias("w"))), 6)


@query(
    SCORED
    + """, t AS (SELECT lender_id, count(*) AS n, greatest(1, count(*) // 100) AS k FROM scored GROUP BY 1), r AS (SELECT s.*, row_number() OVER (PARTITION BY lender_id ORDER BY p DESC, borrower_id, contact_point_ref) AS rank FROM scored s)
SELECT lender_id, borrower_id, contact_point_ref, p, rank FROM r JOIN t USING (lender_id) WHERE rank <= k"""
)
def e9_review_rank(spark, d):
    """The top percent of each lender by score, at least one."""
    s = scored_rows(spark, d)
    k = s.groupBy("lender_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100)).alias("k"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lender_id").orderBy(F.desc("p"), "borrower_id", "contact_point_ref"))
    return s.withColumn("rank", rank).join(F.broadcast(k), "lender_id").where(F.col("rank") <= F.col("k")).select(*CP_KEYS, "p", "rank")


@query(
    SCORED
    + """, r AS (SELECT lender_id, abs(y - p) AS r FROM scored), o AS (SELECT *, row_number() OVER (PARTITION BY lender_id ORDER BY r) AS k, count(*) OVER (PARTITION BY lender_id) AS n FROM r)
SELECT lender_id, round(coalesce(min(r) FILTER (WHERE k >= ceil(CAST(0.9 AS DOUBLE) * (n + 1))), max(r)), 9) AS radius, max(n) AS n FROM o GROUP BY 1"""
)
def k11_conformal(spark, d):
    return rounded(ranking.conformal_radius(scored_rows(spark, d), 0.1, "lender_id"))


# Shrunken rates, ranks and budgets -----------------------------------------------------------

ATT = DIALS + """, att AS (SELECT lender_id, CASE WHEN h >= 8 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 16 THEN 'afternoon' WHEN h >= 16 AND h < 19 THEN 'evening' ELSE 'off_hours' END AS slot, CASE WHEN ans THEN 1 ELSE 0 END AS y FROM dials),
g AS (SELECT avg(y) AS overall FROM att), c AS (SELECT lender_id, slot, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, (sum(y) + 50.0 * any_value(overall)) / (count(*) + 50.0) AS rate, any_value(overall) AS overall FROM att, g GROUP BY 1, 2),
rates AS (SELECT lender_id, slot, n, hits, rate, CASE WHEN n < 20 THEN 1.0 ELSE least(2.0, greatest(0.5, rate / overall)) END AS multiplier FROM c) """


def _attempts(spark, d):
    dials = telephony.keyed(seen(spark, d)).where((F.col("event_type") == "dial_attempt") & (F.col("occurred_at") <= as_of()))
    slot = F.coalesce(telephony.slot_of(F.col("occurred_at")), F.lit("off_hours"))
    return dials.select("lender_id", slot.alias("slot"), F.coalesce(F.col("network_response") == "answered", F.lit(False)).cast("int").alias("y"))


@query(ATT + "SELECT lender_id, slot, n, hits, round(rate, 9) AS rate, round(multiplier, 9) AS multiplier FROM rates")
def d19_slot_rates(spark, d):
    """Shrunken rate per lender and slot, and its multiplier."""
    return rounded(ranking.slot_rates(_attempts(spark, d), "lender_id", "slot", "y"))


@query(ATT + "SELECT lender_id, CASE WHEN bool_or(multiplier <> 1.0) THEN first(slot ORDER BY multiplier DESC, slot) END AS best_slot FROM rates GROUP BY 1")
def f6_best_slot(spark, d):
    return ranking.best_slot(ranking.slot_rates(_attempts(spark, d), "lender_id", "slot", "y"), "lender_id", "slot")


@query(
    BASE
    + f""", bad AS (SELECT DISTINCT {KEYS} FROM kev WHERE disposition = 'wrong_number'), r AS (SELECT c.source, CASE WHEN b.lender_id IS NULL THEN 0 ELSE 1 END AS bad FROM contact_points c LEFT JOIN bad b USING ({KEYS}) WHERE try_cast(c.created_at AS TIMESTAMPTZ) <= {T0})
SELECT source, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN (sum(bad) + 10.0 * (SELECT avg(bad) FROM r)) / (count(*) + 10.0) ELSE (SELECT avg(bad) FROM r) END, 9) AS prior FROM r GROUP BY 1"""
)
def d20_source_priors(spark, d):
    src = ParquetSource(spark, d)
    bad = telephony.keyed(src.visible(as_of())).where(F.col("disposition") == "wrong_number")
    return rounded(ranking.source_priors(src.contact_points(as_of()), bad, CP_KEYS))


@query(
    BASE
    + f"""SELECT {KEYS}, count(*) AS n, count(*) FILTER (WHERE disposition = 'third_party') AS hits, round((0.1 * 10.0 + count(*) FILTER (WHERE disposition = 'third_party')) / (10.0 + count(*)), 9) AS risk FROM kev WHERE event_type = 'disposition' GROUP BY ALL"""
)
def k15_third_party_risk(spark, d):
    disp = telephony.keyed(seen(spark, d)).where(F.col("event_type") == "disposition")
    agg = disp.groupBy(*CP_KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("disposition") == "third_party", F.lit(False))).alias("hits"))
    return rounded(agg.withColumn("risk", ranking.posterior_mean(F.lit(0.1), 10.0, F.col("hits"), F.col("n"))))


@query(
    SCALARS.replace("SELECT " + KEYS + ", any_value(lv)", ", sc AS (SELECT " + KEYS + ", any_value(lv)")
    + f"""), prim AS (SELECT {KEYS}, bool_or(is_primary) AS prim FROM contact_points WHERE {HAVE_KEYS} AND try_cast(created_at AS TIMESTAMPTZ) <= {T0} GROUP BY ALL)
SELECT {KEYS}, round(greatest(0.0, least(1.0, 0.5 / (1 + consecutive_failures) + 0.05 * CASE WHEN prim THEN 1 ELSE 0 END)), 9) AS p FROM sc LEFT JOIN prim USING ({KEYS})"""
)
def k8_incumbent(spark, d):
    """Streak rule: 0.5 / (1 + trailing failures), a little more for a primary contact."""
    src = ParquetSource(spark, d)
    prim = src.contact_points(as_of()).dropna(subset=list(CP_KEYS)).groupBy(*CP_KEYS).agg(F.bool_or("is_primary").alias("prim"))
    s = telephony.dial_scalars(src.visible(as_of()), as_of()).join(prim, list(CP_KEYS), "left")
    p = 0.5 / (1 + F.col("consecutive_failures")) + 0.05 * F.coalesce(F.col("prim"), F.lit(False)).cast("int")
    return rounded(s.select(*CP_KEYS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p")))


BORROWERS = "borrowers WHERE outstanding IS NOT NULL AND lender_id IS NOT NULL"


@query(
    f"SELECT lender_id, borrower_id, cost, rank FROM (SELECT lender_id, borrower_id, 100.0::DOUBLE AS cost, CAST(row_number() OVER (PARTITION BY lender_id ORDER BY outstanding DESC, borrower_id) AS INTEGER) AS rank FROM {BORROWERS}) WHERE rank <= 25"
)
def e10_budget_equal_cost(spark, d):
    from pyspark.sql import Window

    b = spark.read.parquet(f"{d}/borrowers.parquet").dropna(subset=["outstanding", "lender_id"]).withColumn("cost", F.lit(100.0))
    order = [F.desc("outstanding"), F.col("borrower_id")]
    got = ranking.prefix_budget(b, "lender_id", order, "cost", 2500.0)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("lender_id").orderBy(*order))).select("lender_id", "borrower_id", "cost", "rank")


@query(
    f"""WITH RECURSIVE c AS (SELECT lender_id, borrower_id, outstanding / 100 AS cost, row_number() OVER (PARTITION BY lender_id ORDER BY -outstanding, borrower_id) AS k FROM {BORROWERS} AND outstanding / 100 BETWEEN 0 AND 2500),
w AS (SELECT lender_id, NULL::VARCHAR AS borrower_id, 0::BIGINT AS k, 2500.0::DOUBLE AS budget, NULL::DOUBLE AS cost, 0 AS rank FROM c GROUP BY 1
  UNION ALL SELECT c.lender_id, CASE WHEN c.cost <= w.budget THEN c.borrower_id END, c.k, CASE WHEN c.cost <= w.budget THEN w.budget - c.cost ELSE w.budget END, c.cost, CASE WHEN c.cost <= w.budget THEN w.rank + 1 ELSE w.rank END FROM w JOIN c ON c.lender_id = w.lender_id AND c.k = w.k + 1)
SELECT lender_id, borrower_id, cost, rank FROM w WHERE borrower_id IS NOT NULL"""
)
def e10_budget_greedy(spark, d):
    b = spark.read.parquet(f"{d}/borrowers.parquet").dropna(subset=["outstanding", "lender_id"]).withColumn("cost", F.col("outstanding") / 100)
    return ranking.greedy_budget(b, "lender_id", [-F.col("outstanding")], "cost", 2500.0, "borrower_id")


# Ingest --------------------------------------------------------------------------------------

from tidemark.functions import normalize as norm  # noqa: E402
from tidemark.functions.core import instant, present  # noqa: E402
from tidemark.operators import late_events, mapping  # noqa: E402
from tidemark.sources.tables import contact_events, once, table  # noqa: E402

#: The event log as a raw source of its own, with value maps for the dialler's spellings.
API_SPEC = {
    "source": "api",
    "contact_point": {"raw_field": "contact_point_ref", "kind": "hash_passthrough"},
    "fields": {
        "event_id": {"field": "event_id"},
        "event_type": {"field": "event_type"},
        "lender_id": {"field": "lender_id"},
        "borrower_id": {"field": "borrower_id"},
        "account_id": {"field": "account_id"},
        "occurred_at": {"field": "occurred_at", "format": "iso"},
        "received_at": {"field": "received_at", "format": "iso"},
    },
    "payload_json_field": "payload",
}
DIALER_SPEC = API_SPEC | {
    "source": "dialer",
    "payload_json_field": None,
    "payload": {
        "network_response": {"field": "payload.network_response", "map": {"answered": "answered", "no_answer": "no_answer", "busy": "busy", "switched_off": "switched_off", "not_reachable": "not_reachable", "does_not_exist": "does_not_exist", "immediate_hangup": "immediate_hangup"}},
        "ring_seconds": {"field": "payload.ring_seconds", "type": "float"},
        "channel": {"field": "payload.channel", "default": "voice_bot"},
    },
}
ABSENT = " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in ("event_id", "event_type", "lender_id", "borrower_id", "account_id", "contact_point_ref"))
TYPES = "('dial_attempt', 'disposition', 'bot_transcript', 'field_visit', 'contact_point_update', 'payment')"
SKEWED = "epoch_us(try_cast(received_at AS TIMESTAMPTZ)) - epoch_us(try_cast(occurred_at AS TIMESTAMPTZ)) < -300000000"
BAD_TIME = "try_cast(occurred_at AS TIMESTAMPTZ) IS NULL OR try_cast(received_at AS TIMESTAMPTZ) IS NULL"


@query(
    f"""SELECT coalesce(reason, 'accepted') AS reason, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN {ABSENT} THEN 'missing_required_field' WHEN event_type NOT IN {TYPES} THEN 'unknown_enum'
WHEN payload IS NULL OR trim(payload) = '' THEN 'missing_required_field' WHEN {BAD_TIME} THEN 'bad_timestamp' WHEN {SKEWED} THEN 'time_inversion' END AS reason FROM contact_events) GROUP BY 1, 2"""
)
def b16_validate_reason(spark, d):
    """The whole log through the canonical mapping, by reason."""
    out = mapping.apply_mapping(contact_events(spark, d), API_SPEC)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), "event_type").agg(F.count(F.lit(1)).alias("n"))


KNOWN = "('answered', 'no_answer', 'busy', 'switched_off', 'not_reachable', 'does_not_exist', 'immediate_hangup')"


@query(
    f"""SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN {ABSENT} THEN 'missing_required_field' WHEN trim(payload->>'network_response') <> '' AND payload->>'network_response' NOT IN {KNOWN} THEN 'unknown_enum'
WHEN payload->>'network_response' IS NULL OR trim(payload->>'network_response') = '' OR try_cast(payload->>'ring_seconds' AS DOUBLE) IS NULL THEN 'missing_required_field' WHEN {BAD_TIME} THEN 'bad_timestamp' WHEN {SKEWED} THEN 'time_inversion' END AS reason
FROM contact_events WHERE event_type = 'dial_attempt') GROUP BY 1"""
)
def b3_value_map(spark, d):
    """Dial attempts through a value map: spellings outside it are unknown."""
    dials = contact_events(spark, d).where(F.col("event_type") == "dial_attempt")
    out = mapping.apply_mapping(dials, DIALER_SPEC)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def b19_dead_letters(spark, d):
    raw = contact_events(spark, d)
    dead = mapping.dead_letters(mapping.apply_mapping(raw, API_SPEC, keep_raw=True), "api")
    return dead.select("row_hash", "reason", "source")


@query(
    f"""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(CASE event_type WHEN 'dial_attempt' THEN (payload->>'network_response' IS NOT NULL AND lower(payload->>'network_response') NOT IN {KNOWN}) OR coalesce(try_cast(payload->>'ring_seconds' AS DOUBLE) < 0, false)
WHEN 'disposition' THEN lower(payload->>'disposition') NOT IN ('rpc', 'wrong_number', 'third_party', 'switched_off', 'not_reachable', 'promise_to_pay', 'dispute', 'callback')
WHEN 'field_visit' THEN lower(payload->>'outcome') NOT IN ('locked_premises', 'nobody_of_that_name', 'met_borrower', 'met_third_party', 'address_not_found') OR coalesce(try_cast(payload->>'dwell_seconds' AS BIGINT) < 0, false)
WHEN 'contact_point_update' THEN lower(payload->>'source') NOT IN ('kyc', 'later_update', 'bureau', 'borrower_on_call', 'skip_trace') WHEN 'payment' THEN NOT coalesce(try_cast(payload->>'amount' AS DOUBLE) > 0, false) END, false)) AS n_bad FROM contact_events GROUP BY 1"""
)
def b18_schema_check(spark, d):
    out = mapping.schema_problems(contact_events(spark, d))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("schema_problem").alias("n_bad"))


@query(
    PAIRS.replace("bool_or(coalesce(event_type = 'disposition' AND disposition = 'rpc', false)) AS st", "max(disposition) AS disposition, max(network_response) AS network_response")
    + """SELECT coalesce(disposition IN ('rpc', 'promise_to_pay', 'callback', 'dispute') AND network_response <> 'answered', false) AS quarantined, count(*) AS n FROM pairs GROUP BY 1"""
)
def b21_quarantine_split(spark, d):
    ev = seen(spark, d).where(F.col("event_type").isin("dial_attempt", "disposition")).dropna(subset=["account_id", "contact_point_ref", "occurred_at"])
    joint = ev.groupBy("account_id", "contact_point_ref", "occurred_at").agg(F.max("disposition").alias("disposition"), F.max("network_response").alias("network_response"))
    keep, bad = mapping.split_quarantine(joint)
    return keep.select(F.lit(False).alias("quarantined")).unionByName(bad.select(F.lit(True).alias("quarantined"))).groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


PHONE = "concat(CASE event_id % 4 WHEN 0 THEN '+91-' WHEN 1 THEN '0' WHEN 2 THEN '91 ' ELSE '' END, CAST(5000000000 + user_id * 7919 + event_id AS VARCHAR))"


@query(
    rf"""SELECT event_id, phone, substr(sha256(phone), 1, 16) AS ref FROM (SELECT event_id, CASE WHEN regexp_matches(d, '^(91|0)\d{{10}}$') THEN right(d, 10) ELSE d END AS phone
FROM (SELECT event_id, regexp_replace(regexp_replace({PHONE}, '[\s\-.()]+', '', 'g'), '^\+', '') AS d FROM events))"""
)
def b9_phone_hash(spark, d):
    """Normalised and hashed phone numbers."""
    ev = table(spark, d, "events").select("event_id", F.expr(PHONE.replace("VARCHAR", "STRING")).alias("raw"))
    return ev.select("event_id", norm.normalize_phone(F.col("raw")).alias("phone"), norm.hash_value(F.col("raw"), "phone").alias("ref"))


@query(r"SELECT doc_id, CASE WHEN length(trim(a)) > 0 THEN substr(sha256(a), 1, 16) END AS ref FROM (SELECT doc_id, regexp_replace(lower(trim(text)), '[ \t\n\r\f\x0B]+', ' ', 'g') AS a FROM documents)")
def b10_address_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", norm.hash_value(F.col("text"), "address").alias("ref"))


HMAC_BLOCK = bytes(b"pepper".ljust(64, b"\0"))
HMAC = "substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(account_id)))), 1, 16)".format(
    outer=bytes(x ^ 0x5C for x in HMAC_BLOCK).hex(), inner=bytes(x ^ 0x36 for x in HMAC_BLOCK).hex()
)


@query(
    f"""WITH h AS (SELECT account_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('accounts:' || account_id)) AS h FROM accounts)
SELECT account_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), lower(to_hex((('0x' || substr(h, 17, 1))::INTEGER & 3) | 8)) || substr(h, 18, 3), substr(h, 21, 12)) AS uuid, {HMAC} AS keyed FROM h"""
)
def b8_uuid5(spark, d):
    """Name-based identifiers and keyed hashes of the accounts."""
    acc = table(spark, d, "accounts")
    return acc.select("account_id", norm.uuid5(F.concat(F.lit("accounts:"), F.col("account_id"))).alias("uuid"), norm.hash_value(F.col("account_id"), "id", "pepper").alias("keyed"))


@query("SELECT count(*) FILTER (WHERE borrower_id IS NOT NULL AND trim(borrower_id) <> '') AS borrowers, count(*) FILTER (WHERE account_id IS NOT NULL AND trim(account_id) <> '') AS accounts, count(*) FILTER (WHERE contact_point_ref IS NOT NULL AND trim(contact_point_ref) <> '') AS contacts FROM contact_events")
def b15_is_present(spark, d):
    n = lambda c: F.count_if(present(F.col(c)))
    return contact_events(spark, d).agg(n("borrower_id").alias("borrowers"), n("account_id").alias("accounts"), n("contact_point_ref").alias("contacts"))


@query("SELECT borrower_id, lender_id, product, dpd_bucket, CAST(dpd_days AS BIGINT) AS dpd_start, outstanding, CASE lower(trim(CAST(secured AS VARCHAR))) WHEN 'true' THEN true WHEN 'false' THEN false END AS secured FROM borrowers")
def b26_passthrough(spark, d):
    """Account features: the first column that exists, cast; uncastable values null."""
    b = table(spark, d, "borrowers")
    first = lambda *names: next((F.col(n) for n in names if n in b.columns), F.lit(None))
    flag = F.lower(F.trim(first("secured").cast("string")))
    return b.select(
        "borrower_id", "lender_id", first("product", "portfolio").alias("product"), first("dpd_bucket", "bucket_start").alias("dpd_bucket"), first("dpd_start", "dpd_days").try_cast("bigint").alias("dpd_start"),
        first("outstanding").try_cast("double").alias("outstanding"), F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False).alias("secured"),
    )


# Joins, sets, ranks --------------------------------------------------------------------------


@query(
    """SELECT account_id, lender, count(*) AS n FROM (SELECT e.account_id, coalesce(nullif(e.lender_id, 'L06'), a.lender_id) AS lender FROM contact_events e LEFT JOIN (SELECT account_id, min(lender_id) AS lender_id FROM accounts GROUP BY 1) a USING (account_id)) GROUP BY 1, 2"""
)
def c1_lookup_left(spark, d):
    """Fills a missing lender from the accounts, keeping the one that is there."""
    acc = table(spark, d, "accounts").groupBy("account_id").agg(F.min("lender_id").alias("found"))
    ev = contact_events(spark, d, "account_id", "lender_id").withColumn("lender_id", F.nullif("lender_id", F.lit("L06")))
    return ev.join(acc, "account_id", "left").groupBy("account_id", F.coalesce("lender_id", "found").alias("lender")).agg(F.count(F.lit(1)).alias("n"))


STAGE = "SELECT *, ingested_at >= (SELECT max(ingested_at) FROM contact_events) - INTERVAL 30 DAY AS staged FROM raw WHERE event_id IS NOT NULL"


@query("WITH " + ONCE.split(", once AS")[0] + f", s AS ({STAGE}) SELECT DISTINCT event_id FROM s WHERE staged AND event_id NOT IN (SELECT event_id FROM s WHERE NOT staged)")
def c3_anti_insert(spark, d):
    new, old = _staged(spark, d)
    return new.join(old, "event_id", "left_anti").distinct()


@query("WITH " + ONCE.split(", once AS")[0] + f", s AS ({STAGE}) SELECT count(DISTINCT event_id) AS duplicates FROM s WHERE staged AND event_id IN (SELECT event_id FROM s WHERE NOT staged)")
def c4_semi_dupes(spark, d):
    new, old = _staged(spark, d)
    return new.join(old, "event_id", "left_semi").agg(F.count_distinct("event_id").alias("duplicates"))


def _staged(spark, d):
    from tidemark.functions.core import canonical_id

    log = contact_events(spark, d, "event_id", "ingested_at").withColumn("event_id", canonical_id(F.col("event_id"))).where(F.col("event_id").isNotNull())
    cut = contact_events(spark, d, "ingested_at").agg((F.max("ingested_at") - F.expr("INTERVAL '30' DAY")).alias("cut"))
    tagged = log.crossJoin(F.broadcast(cut))
    return tagged.where(F.col("ingested_at") >= F.col("cut")).select("event_id"), tagged.where(F.col("ingested_at") < F.col("cut")).select("event_id")


@query(
    f"""WITH {ONCE}, marks AS (SELECT contact_point_ref, lender_id, watermark_ts FROM watermarks WHERE updated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contact_point_ref, lender_id ORDER BY updated_at DESC, watermark_ts DESC NULLS LAST) = 1)
SELECT DISTINCT contact_point_ref, lender_id FROM once JOIN marks USING (contact_point_ref, lender_id) WHERE received_at > watermark_ts OR occurred_at < watermark_ts"""
)
def c6_late_join(spark, d):
    from tidemark.sources.store import late_keys

    return late_keys(once(spark, d, "contact_point_ref", "lender_id", "occurred_at"), table(spark, d, "watermarks"))


@query("SELECT contact_point_ref, lender_id, epoch_us(watermark_ts) AS watermark_us FROM watermarks WHERE updated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contact_point_ref, lender_id ORDER BY updated_at DESC, watermark_ts DESC NULLS LAST) = 1")
def a15_current_watermarks(spark, d):
    out = late_events.current_watermarks(table(spark, d, "watermarks"))
    return out.select("contact_point_ref", "lender_id", F.unix_micros("watermark_ts").alias("watermark_us"))


LINKS = """links AS (SELECT borrower_id, lender_id, try_cast(created_at AS TIMESTAMPTZ) AS added FROM contact_points WHERE type = 'phone' AND borrower_id IS NOT NULL AND lender_id IS NOT NULL)"""


@query(BASE + f", {LINKS} SELECT e.event_id, count(l.added) AS k FROM ev e LEFT JOIN links l ON l.lender_id = e.lender_id AND l.borrower_id = e.borrower_id AND l.added <= e.occurred_at WHERE e.event_type = 'disposition' AND e.lender_id IS NOT NULL AND e.borrower_id IS NOT NULL GROUP BY 1")
def c14_rank_lookup(spark, d):
    """For each disposition the number of the borrower's phones added by then: a running count over
    the union, by day buckets, not a pairing of events with links."""
    from pyspark.sql import Window

    keys = ["lender_id", "borrower_id"]
    ev = seen(spark, d).where(F.col("event_type") == "disposition").dropna(subset=keys).select(*keys, "event_id", F.col("occurred_at").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("one"))
    links = table(spark, d, "contact_points").where(F.col("type") == "phone").dropna(subset=keys).select(*keys, F.lit(None).cast("string").alias("event_id"), instant(F.col("created_at")).alias("at"), F.lit(0).alias("side"), F.lit(1).alias("one"))
    both = ev.unionByName(links.where(F.col("at").isNotNull())).withColumn("day", F.to_date("at"))
    daily = both.groupBy(*keys, "day").agg(F.sum("one").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("day")) - F.col("n"))
    here = F.sum("one").over(Window.partitionBy(*keys, "day").orderBy(F.struct("at", "side")))
    out = both.withColumn("here", here).where(F.col("side") == 1).join(daily, [*keys, "day"])
    return out.select("event_id", (F.col("here") + F.col("before")).alias("k"))


@query(
    BASE
    + """, s AS (SELECT lender_id, borrower_id, contact_point_ref, bool_or(network_response = 'answered') AS a FROM kev WHERE event_type = 'dial_attempt' GROUP BY 1, 2, 3)
SELECT lender_id, borrower_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(a, false)) AS n_answering, count(*) FILTER (WHERE NOT coalesce(a, false)) AS n_silent FROM s GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (WHERE coalesce(a, false)) > 0"""
)
def c23_cross_line(spark, d):
    """Borrowers with silent lines beside an answering one."""
    dials = telephony.keyed(seen(spark, d)).where(F.col("event_type") == "dial_attempt")
    line = dials.groupBy(*CP_KEYS).agg(F.max(F.coalesce(F.col("network_response") == "answered", F.lit(False))).alias("a"))
    out = line.groupBy("lender_id", "borrower_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("a").alias("n_answering"), F.count_if(~F.col("a")).alias("n_silent"))
    return out.where((F.col("n_lines") >= 2) & (F.col("n_answering") > 0))


@query(BASE + f"SELECT CAST({IST.format('occurred_at')} AS DATE) AS day, count(*) AS n, round(avg(CASE WHEN coalesce(network_response = 'answered', false) THEN 0.0 ELSE 1.0 END), 9) AS fail_share FROM kev WHERE event_type = 'dial_attempt' GROUP BY 1")
def c24_system_day(spark, d):
    dials = telephony.keyed(seen(spark, d)).where(F.col("event_type") == "dial_attempt")
    ans = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    return rounded(dials.groupBy(F.to_date(telephony.local(F.col("occurred_at"))).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(ans, 0.0).otherwise(1.0)).alias("fail_share")))


@query("SELECT e.contact_point_ref, bool_or(m.contact_point_ref IS NOT NULL) AS marked, count(*) AS n FROM contact_events e LEFT JOIN (SELECT DISTINCT contact_point_ref, lender_id FROM dirty_contact_points WHERE reason = 'late_event') m ON m.contact_point_ref = e.contact_point_ref AND m.lender_id = e.lender_id WHERE e.contact_point_ref IS NOT NULL GROUP BY 1")
def c20_marked_semi(spark, d):
    """Membership of contact points in the marks set so far, per lender."""
    marks = table(spark, d, "dirty_contact_points").where(F.col("reason") == "late_event").select("contact_point_ref", "lender_id").distinct().withColumn("hit", F.lit(True))
    ev = contact_events(spark, d, "contact_point_ref", "lender_id").where(F.col("contact_point_ref").isNotNull())
    n = ev.groupBy("contact_point_ref", "lender_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(marks, ["contact_point_ref", "lender_id"], "left").groupBy("contact_point_ref").agg(F.max(F.coalesce("hit", F.lit(False))).alias("marked"), F.sum("n").alias("n"))


@query(
    """SELECT contact_point_ref, 'both' AS side FROM (SELECT contact_point_ref FROM contact_events WHERE contact_point_ref IS NOT NULL INTERSECT SELECT contact_point_ref FROM contact_points)
UNION ALL SELECT contact_point_ref, 'log only' FROM (SELECT contact_point_ref FROM contact_events WHERE contact_point_ref IS NOT NULL EXCEPT SELECT contact_point_ref FROM contact_points)
UNION ALL SELECT contact_point_ref, 'table only' FROM (SELECT contact_point_ref FROM contact_points WHERE contact_point_ref IS NOT NULL EXCEPT SELECT contact_point_ref FROM contact_events)"""
)
def g3_intersect_except(spark, d):
    """Set operations on contact references."""
    a = contact_events(spark, d, "contact_point_ref").dropna().distinct()
    b = table(spark, d, "contact_points").select("contact_point_ref").dropna().distinct()
    both = a.withColumn("in_log", F.lit(True)).join(b.withColumn("in_table", F.lit(True)), "contact_point_ref", "full_outer")
    side = F.when(F.col("in_log").isNull(), "table only").when(F.col("in_table").isNull(), "log only").otherwise("both")
    return both.select("contact_point_ref", side.alias("side"))


@query(BASE + f", days AS (SELECT unnest(generate_series({T0} - INTERVAL 28 DAY, {T0}, INTERVAL 7 DAY)) AS day) SELECT strftime(day AT TIME ZONE 'UTC', '%Y-%m-%d') AS as_of, lender_id, count(*) FILTER (WHERE event_type = 'dial_attempt') AS n_dials, count(*) FILTER (WHERE network_response = 'answered') AS n_answered FROM typed JOIN days ON received_at <= day AND occurred_at > day - INTERVAL 7 DAY AND occurred_at <= day GROUP BY 1, 2")
def g1_training_stack(spark, d):
    """One plan for several as-of dates: each event is shown to the dates whose week it is in (G1, M1)."""
    ev = ParquetSource(spark, d).events()
    days = F.sequence(as_of() - F.expr("INTERVAL '28' DAY"), as_of(), F.expr("INTERVAL '7' DAY"))
    hit = F.filter(days, lambda x: (F.col("received_at") <= x) & (F.col("occurred_at") > x - F.expr("INTERVAL '7' DAY")) & (F.col("occurred_at") <= x))
    each = ev.select("lender_id", "event_type", "network_response", F.explode(hit).alias("day"))
    return each.groupBy(F.date_format("day", "yyyy-MM-dd").alias("as_of"), "lender_id").agg(
        F.count_if(F.col("event_type") == "dial_attempt").alias("n_dials"), F.count_if(F.coalesce(F.col("network_response") == "answered", F.lit(False))).alias("n_answered")
    )


@query(BASE + "SELECT event_id, event_type, epoch_us(occurred_at) AS us FROM ev WHERE lender_id = 'L01' ORDER BY occurred_at, event_id LIMIT 50 OFFSET 100")
def f4_paginate(spark, d):
    """The third page of 50 of one lender's events: the limit is the feature."""
    ev = seen(spark, d).where(F.col("lender_id") == "L01").select("event_id", "event_type", F.unix_micros("occurred_at").alias("us"))
    return ev.orderBy("us", "event_id").offset(100).limit(50)


@query("SELECT 'accounts' AS name, count(*) AS n FROM accounts UNION ALL SELECT 'borrowers', count(*) FROM borrowers UNION ALL SELECT 'contact_points', count(*) FROM contact_points UNION ALL SELECT 'watermarks', count(*) FROM watermarks UNION ALL SELECT 'contact_events', count(*) FROM contact_events")
def a18_store_counts(spark, d):
    out = None
    for t in ("accounts", "borrowers", "contact_points", "watermarks", "contact_events"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    BASE
    + """, hits AS (SELECT event_id, lender_id, contact_point_ref, occurred_at, unnest(list_filter([CASE WHEN disposition = 'wrong_number' THEN 'recycled' END, CASE WHEN disposition = 'third_party' THEN 'third_party' END, CASE WHEN disposition = 'dispute' THEN 'dispute' END], lambda x: x IS NOT NULL)) AS reason FROM kev),
s AS (SELECT lender_id, contact_point_ref, first(reason ORDER BY occurred_at, event_id) AS reason, list_sort(list(DISTINCT event_id)) AS evidence, count(DISTINCT reason) AS n_reasons, min(struct_pack(o := occurred_at, e := event_id)) AS t0 FROM hits GROUP BY 1, 2)
SELECT lender_id, contact_point_ref, reason, evidence, n_reasons, CAST(row_number() OVER (PARTITION BY lender_id ORDER BY t0, contact_point_ref) AS INTEGER) AS version FROM s"""
)
def i8_suppression_log(spark, d):
    """Stateless rules per event, then the state of the suppression log."""
    from tidemark.streaming.intake import fast_path, suppression_log

    rules = [("recycled", F.col("disposition") == "wrong_number"), ("third_party", F.col("disposition") == "third_party"), ("dispute", F.col("disposition") == "dispute")]
    return suppression_log(fast_path(telephony.keyed(seen(spark, d)), rules))


@query(
    BASE
    + f"""SELECT account_id, list_sort(list(DISTINCT contact_point_ref)) AS refs, count(DISTINCT contact_point_ref) AS n_refs FROM ev WHERE event_type = 'dial_attempt' AND account_id IS NOT NULL AND contact_point_ref IS NOT NULL AND occurred_at > {T1} GROUP BY 1"""
)
def n1_dial_lists(spark, d):
    ev = seen(spark, d).where((F.col("event_type") == "dial_attempt") & (F.col("occurred_at") > _week_ago())).dropna(subset=["account_id", "contact_point_ref"])
    return ev.groupBy("account_id").agg(F.array_sort(F.collect_set("contact_point_ref")).alias("refs"), F.count_distinct("contact_point_ref").alias("n_refs"))


@query(BASE + f"SELECT {KEYS}, last(outcome ORDER BY occurred_at, received_at, event_id) AS last_outcome, CAST(floor(avg(extract(hour FROM {VISIT}) + extract(minute FROM {VISIT}) / 60.0)) AS BIGINT) AS best_hour FROM kev WHERE event_type = 'field_visit' GROUP BY ALL")
def n5_visit_health(spark, d):
    v = sharing.visits(seen(spark, d), as_of())
    return v.select(*CP_KEYS, "last_outcome", F.floor("mean_visit_hour").alias("best_hour"))


@query(BASE + f"SELECT max(epoch_us(received_at)) AS last_received_us, {SINCE.format('max(received_at)')} AS days_stale, count(*) AS n FROM ev")
def i10_freshness(spark, d):
    return seen(spark, d).agg(F.max(F.unix_micros("received_at")).alias("last_received_us"), telephony.days_since(as_of(), F.max("received_at")).alias("days_stale"), F.count(F.lit(1)).alias("n"))


# State tracking and learned models -----------------------------------------------------------

from tidemark.models import hmm, learned  # noqa: E402

UPTO = 20638  # days from 1970-01-01 to AS_OF


def _tracked(spark, d) -> DataFrame:
    src = ParquetSource(spark, d)
    slim = ("event_id", "event_type", *CP_KEYS, "received_at", "network_response", "disposition", "update_source", "contact_type")
    ev, _ = Scratch(spark, "track").cut(src.visible(as_of()).select(*slim))
    return hmm.tracked(ev, src.contact_points(as_of()), src.borrowers(), as_of())


@query()
def k4_hmm_score(spark, d):
    """Filtered, pooled posterior of every known contact point."""
    return rounded(hmm.score(_tracked(spark, d), UPTO), 6)


@query(
    BASE
    + """SELECT lender_id, borrower_id, CASE WHEN event_type = 'payment' THEN '' ELSE contact_point_ref END AS contact_point_ref, CAST(datediff('day', DATE '1970-01-01', CAST(received_at AT TIME ZONE 'UTC' AS DATE)) AS INTEGER) AS day,
CASE event_type WHEN 'dial_attempt' THEN 'net' WHEN 'disposition' THEN 'disp' ELSE 'pay' END AS kind, CASE WHEN event_type = 'payment' THEN 'paid' ELSE coalesce(network_response, disposition) END AS value, count(*) AS n
FROM ev WHERE event_type IN ('dial_attempt', 'disposition', 'payment') AND (event_type = 'payment' OR network_response IS NOT NULL OR disposition IS NOT NULL) AND lender_id IS NOT NULL AND (event_type = 'payment' OR contact_point_ref IS NOT NULL)
AND borrower_id IS NOT NULL AND lower(trim(borrower_id)) NOT IN ('', 'unknown') GROUP BY ALL"""
)
def k1_hmm_observations(spark, d):
    return hmm.observations(seen(spark, d), as_of())


@query()
def k5_hmm_em(spark, d):
    """Log likelihood by EM round, over all lines, with the operator's rounds and tolerance."""
    obs, _ = Scratch(spark, "em").cut(_tracked(spark, d))
    _, history = hmm.fit(obs)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(history)], "round int, loglik double")


def _training(spark, d) -> DataFrame:
    """Features a week ago and whether the line answered since."""
    src = ParquetSource(spark, d)
    before = src.visible(_week_ago())
    feats = telephony.dial_windows(before, _week_ago(), (7, 30)).join(telephony.dial_scalars(before, _week_ago()), list(CP_KEYS))
    return feats.join(scored_rows(spark, d).select(*CP_KEYS, "y"), list(CP_KEYS))


def _fitted(spark, d) -> tuple[DataFrame, list[str]]:
    data, _ = Scratch(spark, "train").cut(_training(spark, d))
    return data, learned.feature_names(data, "y")


@query()
def k7_gbm(spark, d):
    data, names = _fitted(spark, d)
    return rounded(learned.predict(learned.fit_classifier(data, "y", names), data, names).select(*CP_KEYS, "y", "p"), 6)


@query()
def k10_calibrator(spark, d):
    s, _ = Scratch(spark, "scored").cut(scored_rows(spark, d))
    return rounded(learned.SegmentCalibrator().fit(s, "lender_id").transform(s, "lender_id").select(*CP_KEYS, "y", "p", "p_cal"), 6)


@query()
def k13_ipw(spark, d):
    """Logistic propensity and its clipped inverse weights."""
    data, names = _fitted(spark, d)
    model = learned.fit_classifier(data, "y", names, "logistic")
    return rounded(learned.inverse_propensity(learned.predict(model, data, names, "propensity")).select(*CP_KEYS, "propensity", "w"), 6)


@query()
def k14_positive_unlabelled(spark, d):
    data, names = _fitted(spark, d)
    return rounded(learned.positive_unlabelled(data, "y", names).select(*CP_KEYS, "risk"), 6)


# Feature frame and evaluation views ----------------------------------------------------------

from tidemark.operators import evaluation  # noqa: E402
from tidemark.plans.features import build_features  # noqa: E402


@query()
def b27_feature_frame(spark, d):
    """The whole registry for every contact point."""
    return rounded(build_features(ParquetSource(spark, d), as_of(), Scratch(spark, "features")), 6)


@query(
    BASE
    + """, dead AS (SELECT contact_point_ref, min(occurred_at) FILTER (WHERE disposition = 'wrong_number') AS action_at FROM ev WHERE contact_point_ref IS NOT NULL GROUP BY 1 HAVING bool_or(coalesce(network_response = 'does_not_exist', false)))
SELECT contact_point_ref, coalesce(n, 0) AS n_wasted, action_at IS NOT NULL AND coalesce(n, 0) <= 1 AS within_1, action_at IS NOT NULL AND coalesce(n, 0) <= 3 AS within_3, action_at IS NOT NULL AND coalesce(n, 0) <= 6 AS within_6
FROM dead LEFT JOIN (SELECT contact_point_ref, count(*) FILTER (WHERE action_at IS NULL OR occurred_at < action_at) AS n FROM ev JOIN dead USING (contact_point_ref) WHERE event_type = 'dial_attempt' GROUP BY 1) USING (contact_point_ref)"""
)
def d30_wasted_attempts(spark, d):
    ev = seen(spark, d).where(F.col("contact_point_ref").isNotNull())
    dead = ev.groupBy("contact_point_ref").agg(F.min(F.when(F.col("disposition") == "wrong_number", F.col("occurred_at"))).alias("action_at"), F.max(F.coalesce(F.col("network_response") == "does_not_exist", F.lit(False))).alias("gone")).where("gone")
    return evaluation.wasted_attempts(ev.where(F.col("event_type") == "dial_attempt"), dead)


@query(
    SCORED
    + """, a AS (SELECT borrower_id AS account_id, max(CASE WHEN p >= 0.2 THEN 1 ELSE 0 END) AS c FROM scored GROUP BY 1)
SELECT account_id, coalesce(c, 0) = 1 AS covered FROM (SELECT DISTINCT borrower_id AS account_id FROM borrowers) LEFT JOIN a USING (account_id)"""
)
def d31_coverage(spark, d):
    """Borrowers with a contact scored 0.2 or more; the others are orphaned."""
    s = scored_rows(spark, d).withColumnRenamed("borrower_id", "account_id")
    who = table(spark, d, "borrowers").select(F.col("borrower_id").alias("account_id"))
    return evaluation.coverage(s, who, F.lit(False), 0.2)


@query(
    SCORED
    + "SELECT lender_id, borrower_id, count(*) AS n_contacts, round(avg(p), 9) AS p_mean, max(p) AS p_max, round(avg(y), 9) AS y_mean, CAST(max(y) AS DOUBLE) AS y_max FROM scored GROUP BY 1, 2"
)
def d21_account_agg(spark, d):
    s = scored_rows(spark, d).withColumn("account_id", F.concat_ws("|", "lender_id", "borrower_id"))
    out = evaluation.account_aggregate(s.select("account_id", "p", "y"), "none", "account_id")
    cut = F.split("account_id", r"\|")
    return rounded(out.select(cut[0].alias("lender_id"), cut[1].alias("borrower_id"), "n_contacts", "p_mean", "p_max", "y_mean", "y_max"))


@query(SCORED + f"SELECT {KEYS}, p, CAST(row_number() OVER (PARTITION BY lender_id, borrower_id ORDER BY CASE WHEN p >= 0.2 THEN 0 ELSE 1 END, p DESC, contact_point_ref) AS INTEGER) AS position FROM scored")
def e8_score_rank(spark, d):
    s = scored_rows(spark, d)
    return evaluation.rank_contacts(s, ["lender_id", "borrower_id"], F.col("p") >= 0.2, ["p"]).select(*CP_KEYS, "p", "position")


@query(
    SCALARS.replace("SELECT " + KEYS + ", any_value(lv)", ", sc AS (SELECT " + KEYS + ", any_value(lv)")
    + """) SELECT lender_id || '|' || coalesce(last_response_type, 'none') || '|' || CASE WHEN days_since_last_answer IS NULL THEN 'never' WHEN days_since_last_answer <= 1 THEN '0-1' WHEN days_since_last_answer <= 3 THEN '2-3' WHEN days_since_last_answer <= 7 THEN '4-7' WHEN days_since_last_answer <= 14 THEN '8-14' WHEN days_since_last_answer <= 30 THEN '15-30' ELSE '30+' END AS segment, count(*) AS n FROM sc GROUP BY 1"""
)
def m4_segments(spark, d):
    s = telephony.dial_scalars(seen(spark, d), as_of())
    seg = evaluation.segment(F.col("lender_id"), F.col("last_response_type"), evaluation.recency_bucket(F.col("days_since_last_answer")))
    return s.groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query()
def f7_dominant_state(spark, d):
    """The likeliest state of every known contact point after tracking."""
    s = hmm.score(_tracked(spark, d), UPTO)
    return s.select(*CP_KEYS, evaluation.dominant_state(evaluation.normalised({n: F.col(n) for n in hmm.POSTERIOR})).alias("state"))


@query(SCORED + "SELECT round(max(abs(p - 1.0 / 3)), 9) AS max_gap, round(avg(CASE WHEN abs(p - 1.0 / 3) <= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS exact_share FROM scored")
def d35_propensity_exact(spark, d):
    return rounded(learned.propensity_exact_share(scored_rows(spark, d).withColumn("k", F.lit(3)), "p", "k", 0.05))


@query(
    """SELECT source, count(*) AS n, count(DISTINCT contact_point_ref) AS n_refs, round(avg(CASE WHEN r < 0 THEN 0.0 WHEN r > 1 THEN 1.0 ELSE coalesce(r, 0.0) END), 9) AS mean_risk FROM contact_points LEFT JOIN (SELECT contact_point_ref, count(*) / 3.0 AS r FROM dirty_contact_points GROUP BY 1) USING (contact_point_ref) GROUP BY 1"""
)
def c19_risk_merge(spark, d):
    risk = table(spark, d, "dirty_contact_points").groupBy("contact_point_ref").agg((F.count(F.lit(1)) / 3.0).alias("recycled_risk"))
    out = evaluation.merged_risk(table(spark, d, "contact_points"), risk, ["contact_point_ref"])
    return rounded(out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contact_point_ref").alias("n_refs"), F.avg("recycled_risk").alias("mean_risk")))


@query(
    SCORED
    + """, t AS (SELECT greatest(1, count(*) // 100) AS k, sum(y) AS pos FROM scored), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, concat_ws('|', lender_id, borrower_id, contact_point_ref)) AS rank FROM scored)
SELECT any_value(k) AS k, round(sum(y)::DOUBLE / any_value(k), 9) AS precision_at_k, round(sum(y)::DOUBLE / nullif(any_value(pos), 0), 9) AS recall_at_k FROM r, t WHERE rank <= k"""
)
def d37_review_metrics(spark, d):
    """Precision and recall in the best percent of all scores: those above the k-th score all count,
    and the rows at that score are taken in the order of their key."""
    from pyspark.sql import Window

    s = scored_rows(spark, d).withColumn("id", F.concat_ws("|", *CP_KEYS))
    total = s.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100)).alias("k"), F.sum("y").alias("pos"))
    near = metrics.running_counts(s).drop("pos").crossJoin(F.broadcast(total)).where(F.col("above_n") < F.col("k")).select("p", "above_n", "k", "pos")
    w = Window.partitionBy("p").orderBy("id")
    top = s.join(F.broadcast(near.withColumnRenamed("pos", "all_pos")), "p").withColumn("rank", F.col("above_n") + F.row_number().over(w)).where(F.col("rank") <= F.col("k"))
    hits = F.sum("y").cast("double")
    return rounded(top.agg(F.first("k").alias("k"), (hits / F.first("k")).alias("precision_at_k"), (hits / F.nullif(F.first("all_pos"), F.lit(0))).alias("recall_at_k")))
