"""Queries p3, p4, p5, p8, p9 and p10 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import canonical_id, clean_response
from tidemark.llm.leakage import find_leaks
from tidemark.llm.pii import redact_text
from tidemark.llm.runs import collapse_runs
from tidemark.llm.splits import component_groups, contract, grouped_splits, relation_edges, vertex
from tidemark.llm.tokenize import decode_column, encode_column
from tidemark.llm.truncation import flag_truncated, length_hazards, truncation_rates
from tidemark.plans.problems import FILLER, ONCE
from tidemark.session import Scratch
from tidemark.sources.tables import contact_events, once, table

# p3 ------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    ev = once(spark, d, "account_id", "contact_point_ref", "event_type", "occurred_at", "payload").where(F.col("event_type") == "dial_attempt")
    dials = ev.select(
        "account_id",
        "contact_point_ref",
        F.col("event_id").alias("id"),
        "occurred_at",
        clean_response(F.get_json_object("payload", "$.network_response")).alias("value"),
    )
    return collapse_runs(dials, ["account_id", "contact_point_ref"], Scratch(spark, "runs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("account_id", "contact_point_ref", F.col("first_id").alias("first_event_id"), F.col("n").alias("n_attempts"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select(
        "account_id", "contact_point_ref", F.col("value").alias("network_response"), F.col("first_id").alias("first_event_id"), F.unix_micros("first_at").alias("first_at_us"), F.col("n").alias("n_attempts"), "seconds"
    )


# p4 ------------------------------------------------------------------------------------------


def _remarks(spark: SparkSession, d: str) -> DataFrame:
    remarks = F.when(F.col("event_type").isin("disposition", "field_visit"), F.get_json_object("payload", "$.remarks"))
    ev = once(spark, d, remarks.alias("remarks")).where(F.col("remarks").isNotNull())
    return redact_text(ev.select("event_id", "remarks"), "remarks")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _remarks(spark, d).select("event_id", F.explode("pii.kinds").alias("pii_type"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _remarks(spark, d).select("event_id", F.col("pii.redacted").alias("remarks"), F.size("pii.found").alias("n_redacted"))


# p5 ------------------------------------------------------------------------------------------

RELATED = ("account_id", "contact_point_ref", "borrower_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    labels = contract(relation_edges(contact_events(spark, d, *RELATED), RELATED), Scratch(spark, "groups"))
    return component_groups(labels).select(F.col("member").alias("account_id"), "group_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = contact_events(spark, d, "event_id", *RELATED).withColumn("event_id", canonical_id(F.col("event_id")))
    return grouped_splits(rows, RELATED, "event_id", Scratch(spark, "splits")).select("event_id", "split")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """The promises of p5_splits, measured on its rows, for SQL to compare with what they must be."""
    rows = contact_events(spark, d, "event_id", *RELATED)
    out, _ = Scratch(spark, "check").cut(grouped_splits(rows, RELATED, "event_id", Scratch(spark, "splits")).select(*RELATED, "split"))
    shared = None
    for i, c in enumerate(RELATED):
        own = out.select(vertex(f"{i}:", F.col(c)).alias("v"), "split").where(F.col("v").isNotNull()).groupBy("v").agg(F.count_distinct("split").alias("n"))
        shared = own if shared is None else shared.unionByName(own)
    row = lambda what, value: F.struct(F.lit(what).alias("what"), value.cast("double").alias("value"))
    part = lambda name, share: F.abs(F.count_if(F.col("split") == name) / F.count(F.lit(1)) - share) <= 0.01
    a = shared.agg(row("shared values", F.count_if(F.col("n") > 1)).alias("r"))
    b = out.agg(F.array(row("splits", F.count_distinct("split")), row("rows", F.count(F.lit(1))), *[row(f"{s} within 1 percent", part(s, p)) for s, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1))]).alias("r"))
    return a.select("r.*").unionByName(b.select(F.inline("r")))


# p8 ------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", encode_column(docs).alias("ids"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many texts come back from their ids unchanged, by source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    coded = docs.withColumn("ids", encode_column(docs))
    back = coded.withColumn("back", decode_column(coded))
    return back.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("back") == F.coalesce("text", F.lit(""))).alias("n_same"), F.sum(F.size("ids")).alias("n_tokens")
    )


def p8_same(spark: SparkSession, d: str) -> DataFrame:
    """By source, how many texts there are and how many come back from their ids unchanged."""
    return p8_round_trip(spark, d).select("source", "n_docs", "n_same")


# p9 ------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, d, "eval_items"), Scratch(spark, "leaks"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """For each item that leaked, in how many documents, how much of it at most, and its answer."""
    found = _leaks(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"), F.count_if("answer_leaked").alias("n_with_answer")
    )
    return table(spark, d, "eval_items").select("item_id", "split").join(found, "item_id")


# p10 -----------------------------------------------------------------------------------------


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return flag_truncated(table(spark, d, "documents").select("doc_id", "source", "text"), Scratch(spark, "truncation"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(_truncated(spark, d))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    return length_hazards(docs.select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("n_chars"))).where("significant")


QUERIES = {
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_check": p5_check,
    "p8_ids": p8_ids,
    "p8_same": p8_same,
    "p8_round_trip": p8_round_trip,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p10_limits": p10_limits,
}

RUNS = (
    "WITH "
    + ONCE
    + r""", dials AS (
  SELECT account_id, contact_point_ref, event_id, occurred_at,
    CASE WHEN event_id IS NOT NULL THEN nullif(regexp_replace(regexp_replace(lower(payload->>'network_response'), '\s*(\(\s*\d+\s*\)|[/:#-]\s*\d+)\s*$', ''), '[^a-z0-9]', '', 'g'), '') END AS r
  FROM once WHERE event_type = 'dial_attempt' AND account_id IS NOT NULL AND contact_point_ref IS NOT NULL AND occurred_at IS NOT NULL),
s AS (SELECT *, coalesce(r = lag(r) OVER w AND occurred_at - lag(occurred_at) OVER w <= INTERVAL 30 MINUTE, false) AS linked
  FROM dials WINDOW w AS (PARTITION BY account_id, contact_point_ref ORDER BY occurred_at, event_id NULLS FIRST)),
g AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY account_id, contact_point_ref ORDER BY occurred_at, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM s),
runs AS (SELECT account_id, contact_point_ref, any_value(r) AS network_response, first(event_id ORDER BY occurred_at, event_id) AS first_event_id,
  epoch_us(min(occurred_at)) AS first_at_us, count(*) AS n_attempts, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1e6 AS seconds
  FROM g WHERE r IS NOT NULL GROUP BY account_id, contact_point_ref, run HAVING count(*) > 1)
"""
)

_VALUE = "CASE WHEN NOT {0} THEN '{1}:' || trim({2}) END"
GROUPS = "WITH RECURSIVE k AS (SELECT DISTINCT " + ", ".join(_VALUE.format(FILLER.format(c), i, c) + f" AS k{i}" for i, c in enumerate(RELATED)) + """ FROM contact_events),
pairs AS (SELECT k0 AS u, k1 AS v FROM k UNION SELECT k0, k2 FROM k UNION SELECT k1, k2 FROM k),
edges AS (SELECT u, v FROM pairs WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM pairs WHERE u IS NOT NULL AND v IS NOT NULL),
reach AS (SELECT DISTINCT k0 AS a, k0 AS x FROM k WHERE k0 IS NOT NULL UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.x)
SELECT substr(a, 3) AS account_id, substr(min(x), 3) AS group_id FROM reach WHERE x LIKE '0:%' GROUP BY a HAVING count(*) > 1"""

#: p5_check states what a split must hold: each value in one split, the proportions, every row once.
SPLIT_CHECK = f"""SELECT 'shared values' AS what, 0.0 AS value UNION ALL SELECT 'splits', 3.0
UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM contact_events
UNION ALL SELECT 'train within 1 percent', 1.0 UNION ALL SELECT 'validation within 1 percent', 1.0 UNION ALL SELECT 'test within 1 percent', 1.0"""
ROUND_TRIP = "SELECT source, count(*) AS n_docs, count(*) AS n_same FROM documents GROUP BY 1"

SQL = {
    "p5_check": SPLIT_CHECK,
    "p8_same": ROUND_TRIP,
    "p5_found": GROUPS,
    "p3_found": RUNS + "SELECT account_id, contact_point_ref, first_event_id, n_attempts FROM runs",
    "p3_runs": RUNS + "SELECT * FROM runs",
}
