"""Readers for the project's tables and the canonical event view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import instant
from tidemark.operators.deliver_once import deliver_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contact_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The event log as delivered, pruned to ``columns``."""
    df = table(spark, sf_dir, "contact_events")
    return df.select(*columns) if columns else df


def once(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """The event log with one row per identifier, ``columns`` computed before anything is shuffled.

    ``received_at`` and, where asked for, ``occurred_at`` come out as timestamps.
    """
    named = {c for c in columns if isinstance(c, str)}
    plain = sorted(named - {"event_id", "received_at", "ingested_at", "occurred_at"})
    made = [c for c in columns if not isinstance(c, str)]
    times = [instant(F.col(c)).alias(c) for c in ("received_at", "occurred_at") if c == "received_at" or c in named]
    df = contact_events(spark, sf_dir).select("event_id", "ingested_at", *plain, *times, *made)
    return deliver_once(df).drop("n_copies", "ingested_at")
