"""Queries of the evaluation harness, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import learned
from tidemark.operators import harness, labels, metrics, telephony
from tidemark.operators.harness import MINI_RESPONSES
from tidemark.plans.reference import AS_OF, BASE, HAVE_KEYS, KEYS, PAIRS, SCORED, SINCE, T0, T1, UNIV, as_of, rounded, scored_rows, seen
from tidemark.session import Scratch
from tidemark.sources.pit import CP_KEYS, ParquetSource
from tidemark.sources.tables import table

ORIGINS = ("2026-06-13 00:00:00", "2026-06-20 00:00:00", "2026-06-27 00:00:00")
RULES = ("answer_rate", "incumbent", "recency")

PRIMARY = f"prim AS (SELECT {KEYS}, bool_or(is_primary) AS is_primary FROM contact_points WHERE {HAVE_KEYS} AND try_cast(created_at AS TIMESTAMPTZ) <= {T0} GROUP BY ALL)"
ORIGIN_ROWS = "o AS (SELECT t AS origin, CAST(t || '+00' AS TIMESTAMPTZ) AS o_at FROM (VALUES " + ", ".join(f"('{x}')" for x in ORIGINS) + ") v(t))"


def mini_sql(origins: str) -> str:
    """Common table expressions up to ``mini``: the features of every origin."""
    counts = ", ".join(f"count(*) FILTER (WHERE network_response = '{r}') AS n_{r}" for r in MINI_RESPONSES)
    days = "(epoch_us(any_value(o_at)) - epoch_us({0})) / 86400e6"
    return (
        BASE
        + f""", {PRIMARY}, {origins}, d AS (SELECT * FROM typed WHERE event_type = 'dial_attempt' AND {HAVE_KEYS} AND received_at <= {T0}),
h AS (SELECT d.*, origin, o_at, coalesce(network_response = 'answered', false) AS ans,
    row_number() OVER (PARTITION BY origin, {", ".join("d." + k for k in CP_KEYS)} ORDER BY occurred_at, received_at, event_id) AS k
  FROM d JOIN o ON d.occurred_at <= o.o_at AND d.received_at <= o.o_at),
feat AS (SELECT origin, {KEYS}, count(*) AS n_attempts, count(*) FILTER (WHERE ans) AS n_answered, avg(CASE WHEN ans THEN 1.0 ELSE 0.0 END) AS answer_rate,
    count(*) FILTER (WHERE occurred_at >= o_at - INTERVAL 7 DAY) AS n_recent_7d, count(*) FILTER (WHERE occurred_at >= o_at - INTERVAL 30 DAY) AS n_recent_30d,
    CAST(count(*) - coalesce(max(k) FILTER (WHERE ans), 0) AS BIGINT) AS consec_failures, {days.format('max(occurred_at)')} AS days_since_last_attempt,
    {days.format('max(occurred_at) FILTER (WHERE ans)')} AS days_since_last_answer, coalesce(avg(ring_seconds), 0.0) AS avg_ring_seconds, {counts}
  FROM h GROUP BY ALL),
mini AS (SELECT feat.*, CASE WHEN is_primary THEN 1.0::DOUBLE ELSE 0.0 END AS is_primary FROM feat LEFT JOIN prim USING ({KEYS}))"""
    )


MINI_COLUMNS = ("n_attempts", "n_answered", "answer_rate", "n_recent_7d", "n_recent_30d", "consec_failures", "days_since_last_attempt", "days_since_last_answer", "avg_ring_seconds", *[f"n_{r}" for r in MINI_RESPONSES], "is_primary")
_DOUBLES = ("answer_rate", "days_since_last_attempt", "days_since_last_answer", "avg_ring_seconds")
EVALUATED = (
    mini_sql(ORIGIN_ROWS)
    + f""", y AS (SELECT origin, {KEYS}, max(CASE WHEN network_response = 'answered' THEN 1 ELSE 0 END) AS y FROM d JOIN o ON occurred_at > o_at AND occurred_at <= o_at + INTERVAL 7 DAY GROUP BY ALL),
s AS (SELECT origin, y, unnest([{{'scorer': 'answer_rate', 'p': (n_answered + 1) / (n_attempts + 2.0)}},
    {{'scorer': 'incumbent', 'p': 0.5 / (1 + consec_failures) + 0.05 * is_primary}}, {{'scorer': 'recency', 'p': coalesce(1.0 / (1 + days_since_last_answer), 0.0)}}], recursive := true)
  FROM mini JOIN y USING (origin, {KEYS})),
q AS (SELECT origin, scorer, y, greatest(0.0, least(1.0, p))::DOUBLE AS p FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY origin, scorer ORDER BY p) + (count(*) OVER (PARTITION BY origin, scorer, p) - 1) / 2.0 AS k FROM q),
c AS (SELECT origin, scorer, p, count(*) AS n, sum(y) AS pos FROM q GROUP BY ALL),
cc AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM c WINDOW w AS (PARTITION BY origin, scorer ORDER BY p DESC)),
ap AS (SELECT origin, scorer, sum(pos * cp::DOUBLE / cn) / sum(pos) AS average_precision FROM cc GROUP BY ALL),
m AS (SELECT origin, scorer, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
    (sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc,
    avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))))) AS log_loss FROM r GROUP BY ALL)
SELECT origin, scorer, n, positives, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM m JOIN ap USING (origin, scorer)"""
)


def _dials(spark: SparkSession, d: str) -> DataFrame:
    dials = telephony.keyed(seen(spark, d)).where(F.col("event_type") == "dial_attempt")
    return dials.select(*CP_KEYS, "event_id", "occurred_at", "received_at", "network_response", "ring_seconds")


def _primary(spark: SparkSession, d: str) -> DataFrame:
    points = ParquetSource(spark, d).contact_points(as_of()).dropna(subset=list(CP_KEYS))
    return points.groupBy(*CP_KEYS).agg(F.bool_or("is_primary").alias("is_primary"))


def d15_mini_features(spark: SparkSession, d: str) -> DataFrame:
    """The small feature set of the harness, by what was received and happened by then."""
    dials = _dials(spark, d).where(F.col("occurred_at") <= as_of())
    return rounded(harness.mini_features(dials, as_of(), _primary(spark, d)).select(*CP_KEYS, *MINI_COLUMNS), 6)


def m3_eval_loop(spark: SparkSession, d: str) -> DataFrame:
    """Three rolling origins, every registered rule: metrics of the week after."""
    return rounded(harness.evaluate(_dials(spark, d), ORIGINS, RULES, Scratch(spark, "eval"), primary=_primary(spark, d)), 6)


def m3_eval_trees(spark: SparkSession, d: str) -> DataFrame:
    """The same with trees fitted on the origins before each one."""
    return rounded(harness.evaluate(_dials(spark, d), ORIGINS, ("trees",), Scratch(spark, "eval"), primary=_primary(spark, d)), 6)


def b29_dialled_only(spark: SparkSession, d: str) -> DataFrame:
    ev = seen(spark, d)
    lab = labels.rpc_labels(ev, labels.companion_pairs(ev), as_of() - F.expr("INTERVAL '7' DAY"), as_of())
    return harness.dialled_only(lab).select(*labels.PAIR, "n_dials", "rpc")


def b30_split_filters(spark: SparkSession, d: str) -> DataFrame:
    """Labels of training accounts only; a split here is the fold of the account's digest."""
    ev = seen(spark, d)
    pairs = ev.select(*labels.PAIR).dropna().distinct()
    folds = pairs.select("account_id").distinct().withColumn("split", F.when(labels.account_fold(F.col("account_id"), 5) < 3, "train").otherwise("test"))
    return harness.train_accounts_only(pairs, folds)


def c18_modal_account(spark: SparkSession, d: str) -> DataFrame:
    ev = seen(spark, d)
    return harness.modal_account_only(ev.select(*labels.PAIR).dropna().distinct(), ev).select(*labels.PAIR)


def d32_avoiding_dead(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hang up at once against lines that do not exist or stay switched off, by the share of
    dials that rang."""
    dials = _dials(spark, d)
    has = lambda r: F.max(F.coalesce(F.col("network_response") == r, F.lit(False)))
    lines = dials.groupBy(*CP_KEYS).agg(
        has("does_not_exist").alias("gone"), has("switched_off").alias("off"), has("immediate_hangup").alias("hung"), F.avg(F.when(F.col("ring_seconds") > 0, 1.0).otherwise(0.0)).alias("rang")
    )
    state = F.when(F.col("gone"), "invalid").when(F.col("hung"), "avoiding").when(F.col("off"), "switched_off_long")
    return rounded(harness.avoiding_or_dead(lines.withColumn("state", state), "state", "rang"))


def m2_account_refs(spark: SparkSession, d: str) -> DataFrame:
    """Folds by the whole digest, and the number of references whose accounts span several."""
    ev = seen(spark, d).dropna(subset=["account_id", "contact_point_ref"]).select("account_id", "contact_point_ref").distinct().withColumn("fold", labels.account_fold(F.col("account_id"), 5))
    return ev.groupBy("contact_point_ref").agg(F.count_distinct("fold").alias("n_folds")).groupBy("n_folds").agg(F.count(F.lit(1)).alias("n_refs"))


def d33_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the Brier score, a mean."""
    rows = scored_rows(spark, d).withColumn("id", F.concat_ws("|", *CP_KEYS))
    return rounded(harness.bootstrap_mean(rows.withColumn("v", (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), "v"))


def j7_bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the AUC, as of any metric that takes groups."""
    rows = scored_rows(spark, d).withColumn("id", F.concat_ws("|", *CP_KEYS))
    return rounded(harness.bootstrap_metric(rows, metrics.roc_auc, "auc"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    ev = seen(spark, d)
    starts = ev.where((F.col("event_type") == "contact_point_update") & (F.col("update_source") == "skip_trace")).select("account_id", F.col("occurred_at").alias("start"))
    paid = labels.paid_after(starts, ev.where(F.col("event_type") == "payment"), 30)
    hist = ev.where(F.col("event_type").isin("dial_attempt", "payment")).dropna(subset=["account_id"]).select("account_id", "event_type", "network_response", "amount", F.col("occurred_at").alias("at"))
    return learned.trace_history(paid, hist)


def k17_trace_frame(spark: SparkSession, d: str) -> DataFrame:
    """What the trace-outcome model learns from: history before each trace, and its outcome."""
    return rounded(_traces(spark, d).select("account_id", F.unix_micros("start").alias("start_us"), "n_dials", "n_answered", "n_payments", "paid_before", "paid", "censored"), 6)


def k17_trace_outcome(spark: SparkSession, d: str) -> DataFrame:
    """The chance that a traced account pays within 30 days, fitted on the traces that are not censored."""
    data, _ = Scratch(spark, "trace").cut(_traces(spark, d))
    model = learned.TraceOutcome().fit(data)
    return rounded(model.predict(data).select("account_id", F.unix_micros("start").alias("start_us"), "p_recover_30d"), 6)


def k10_beta_calibrator(spark: SparkSession, d: str) -> DataFrame:
    s = scored_rows(spark, d)
    return rounded(learned.BetaCalibrator().fit(s).transform(s).select(*CP_KEYS, "y", "p", "p_cal"), 6)


def k7_account_gbm(spark: SparkSession, d: str) -> DataFrame:
    """Trees over account frames: mean and maximum of the features of an account's contacts."""
    frames = harness.origin_frames(_dials(spark, d), ORIGINS[-1], 7)
    keyed = frames.withColumn("account_id", F.concat_ws("|", "lender_id", "borrower_id")).drop("origin")
    from tidemark.operators.evaluation import account_aggregate

    acc = account_aggregate(keyed.drop(*CP_KEYS), "y").join(keyed.groupBy("account_id").agg(F.max("y").alias("y")), "account_id")
    data, _ = Scratch(spark, "accounts").cut(acc)
    names = learned.feature_names(data, "y")
    return rounded(learned.predict(learned.fit_classifier(data, "y", names), data, names).select("account_id", "y", "p"), 6)


def b27_record_columns(spark: SparkSession, d: str) -> DataFrame:
    """The frame's columns of dials and records, for SQL to compare with their parts."""
    from tidemark.plans.features import build_features

    out = build_features(ParquetSource(spark, d), as_of(), Scratch(spark, "features"))
    return rounded(out.where("has_any_attempt").select(*CP_KEYS, "n_attempts_7d", "n_answered_30d", "answer_rate_30d", "consecutive_failures", "n_updates", "source", "record_age_days", "is_primary", "n_contacts", "contact_type"), 6)


QUERIES = {f.__name__: f for f in (d15_mini_features, m3_eval_loop, m3_eval_trees, b29_dialled_only, b30_split_filters, c18_modal_account, d32_avoiding_dead, m2_account_refs, d33_bootstrap_ci, j7_bootstrap_auc, k17_trace_frame, k17_trace_outcome, k10_beta_calibrator, k7_account_gbm, b27_record_columns)}

FOLD = "CAST(((('0x' || substr(sha256(account_id), 1, 16))::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr(sha256(account_id), 17, 16))::UHUGEINT) % 5 + (('0x' || substr(sha256(account_id), 33, 16))::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr(sha256(account_id), 49, 16))::UHUGEINT) % 5) % 5 AS BIGINT)"

RECORDS = (
    UNIV
    + f""", w AS (SELECT {KEYS}, count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL 7 DAY) AS n_attempts_7d, count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL 30 DAY AND network_response = 'answered') AS n_answered_30d,
    round(count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL 30 DAY AND network_response = 'answered')::DOUBLE / nullif(count(*) FILTER (WHERE occurred_at > {T0} - INTERVAL 30 DAY), 0), 6) AS answer_rate_30d FROM kev WHERE event_type = 'dial_attempt' AND occurred_at <= {T0} GROUP BY ALL),
f AS (SELECT {KEYS}, row_number() OVER w AS k, count(*) OVER (PARTITION BY {KEYS}) AS n, coalesce(network_response = 'answered', false) AS ans FROM kev WHERE event_type = 'dial_attempt' AND occurred_at <= {T0} WINDOW w AS (PARTITION BY {KEYS} ORDER BY occurred_at, received_at, event_id)),
st AS (SELECT {KEYS}, CAST(max(n) - coalesce(max(k) FILTER (WHERE ans), 0) AS BIGINT) AS consecutive_failures FROM f GROUP BY ALL),
u AS (SELECT {KEYS}, count(*) AS n_updates, last(struct_pack(s := update_source, p := update_primary) ORDER BY received_at, occurred_at, event_id) AS l FROM kev WHERE event_type = 'contact_point_update' GROUP BY ALL),
t AS (SELECT {KEYS}, min(lower(type)) AS contact_type, first(source ORDER BY try_cast(created_at AS TIMESTAMPTZ) NULLS LAST, source NULLS FIRST) AS src, bool_or(is_primary) AS prim FROM contact_points WHERE {HAVE_KEYS} AND try_cast(created_at AS TIMESTAMPTZ) <= {T0} GROUP BY ALL),
b AS (SELECT lender_id, borrower_id, count(DISTINCT contact_point_ref) AS n_contacts FROM univ GROUP BY 1, 2)
SELECT {KEYS}, n_attempts_7d, n_answered_30d, answer_rate_30d, consecutive_failures, coalesce(n_updates, 0) AS n_updates, coalesce(l.s, src, 'unknown') AS source,
  CAST({SINCE.format('univ.created_at')} AS INTEGER) AS record_age_days, coalesce(l.p, prim, false) AS is_primary, n_contacts, contact_type
FROM w JOIN st USING ({KEYS}) JOIN univ USING ({KEYS}) JOIN b USING (lender_id, borrower_id) LEFT JOIN u USING ({KEYS}) LEFT JOIN t USING ({KEYS})"""
)

SQL = {
    "b27_record_columns": RECORDS,
    "d15_mini_features": mini_sql(f"o AS (SELECT '{AS_OF}' AS origin, {T0} AS o_at)")
    + f" SELECT {KEYS}, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" if c in _DOUBLES else c for c in MINI_COLUMNS) + " FROM mini",
    "m3_eval_loop": EVALUATED,
    "b29_dialled_only": PAIRS + f"SELECT account_id, contact_point_ref, count(*) AS n_dials, bool_or(answered AND good) AS rpc FROM pairs WHERE has_dial AND occurred_at > {T1} AND occurred_at <= {T0} GROUP BY 1, 2",
    "b30_split_filters": BASE + f"SELECT DISTINCT account_id, contact_point_ref FROM ev WHERE contact_point_ref IS NOT NULL AND account_id IS NOT NULL AND {FOLD} < 3",
    "c18_modal_account": BASE
    + """, n AS (SELECT contact_point_ref, account_id, count(*) AS n FROM ev WHERE contact_point_ref IS NOT NULL AND account_id IS NOT NULL GROUP BY 1, 2)
SELECT account_id, contact_point_ref FROM n QUALIFY row_number() OVER (PARTITION BY contact_point_ref ORDER BY n DESC, account_id) = 1""",
    "d32_avoiding_dead": BASE
    + f""", l AS (SELECT {KEYS}, bool_or(coalesce(network_response = 'does_not_exist', false)) AS gone, bool_or(coalesce(network_response = 'switched_off', false)) AS off,
    bool_or(coalesce(network_response = 'immediate_hangup', false)) AS hung, avg(CASE WHEN ring_seconds > 0 THEN 1.0 ELSE 0.0 END) AS p FROM kev WHERE event_type = 'dial_attempt' GROUP BY ALL),
q AS (SELECT CASE WHEN NOT gone AND hung THEN 1 ELSE 0 END AS y, p FROM l WHERE gone OR hung OR off),
r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM q)
SELECT count(*) AS n, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
  round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc FROM r""",
    "m2_account_refs": BASE
    + f"SELECT n_folds, count(*) AS n_refs FROM (SELECT contact_point_ref, count(DISTINCT {FOLD}) AS n_folds FROM ev WHERE contact_point_ref IS NOT NULL AND account_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "k17_trace_frame": BASE
    + """, s AS (SELECT DISTINCT account_id, occurred_at AS start FROM ev WHERE event_type = 'contact_point_update' AND update_source = 'skip_trace' AND account_id IS NOT NULL), p AS (SELECT account_id, occurred_at FROM ev WHERE event_type = 'payment'),
x AS (SELECT s.*, s.start + INTERVAL 30 DAY > (SELECT max(occurred_at) FROM p) AS censored, EXISTS (SELECT 1 FROM p WHERE p.account_id = s.account_id AND p.occurred_at > s.start AND p.occurred_at <= s.start + INTERVAL 30 DAY) AS paid FROM s)
SELECT x.account_id, epoch_us(start) AS start_us, count(*) FILTER (WHERE event_type = 'dial_attempt') AS n_dials, count(*) FILTER (WHERE network_response = 'answered') AS n_answered,
  count(*) FILTER (WHERE event_type = 'payment') AS n_payments, round(coalesce(CAST(sum(CAST(round(amount * 1000) AS BIGINT)) FILTER (WHERE event_type = 'payment') AS BIGINT), 0) / 1000.0, 6) AS paid_before, CASE WHEN NOT any_value(censored) THEN any_value(paid) END AS paid, any_value(censored) AS censored
FROM x LEFT JOIN ev e ON e.account_id = x.account_id AND e.event_type IN ('dial_attempt', 'payment') AND e.occurred_at <= x.start GROUP BY 1, 2""",
}
