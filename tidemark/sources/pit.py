"""Point-in-time readers: what was visible at a given moment, as lazy DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import clean_response, instant, plausible
from tidemark.functions.fixed_values import NETWORK_RESPONSES
from tidemark.operators.deliver_once import deliver_once

CP_KEYS = ("lender_id", "borrower_id", "contact_point_ref")
CONTACT_COLUMNS = ("contact_point_ref", "borrower_id", "lender_id", "type", "value_hash", "source", "is_primary", "created_at")
BORROWER_COLUMNS = (
    "borrower_id", "lender_id", "product", "dpd_bucket", "dpd_days", "outstanding", "secured", "bureau_score_band", "income_type",
    "preferred_language", "town_id", "dpd_start", "overdue_start", "emi_amount", "other_active_loans", "paid_other_lenders_30d", "last_bounce_reason",
)
PAYLOAD = (
    "network_response string, ring_seconds string, channel string, disposition string, agent_id string, remarks string, transcript string, "
    "who_answered string, language string, outcome string, visit_time string, dwell_seconds string, amount string, payment_mode string, "
    "source string, contact_type string, contact_value string, is_primary string"
)


def response(c: Column) -> Column:
    """A network response by its canonical name; an unknown one in its cleaned spelling."""
    word = clean_response(c)
    out = F
    for name in NETWORK_RESPONSES:
        out = out.when(word == name.replace("_", ""), name)
    return out.otherwise(word)


def payload_columns(payload: Column, kind: Column) -> list[Column]:
    """The payload parsed once, as typed columns that are null for other event types."""
    p = F.from_json(payload, PAYLOAD)
    text = lambda k: F.nullif(F.trim(p[k]), F.lit(""))
    when = lambda t, c: F.when(kind == t, c)
    return [
        when("dial_attempt", response(p["network_response"])).alias("network_response"),
        when("dial_attempt", plausible(p["ring_seconds"].try_cast("double"), 0.0, 3600.0)).alias("ring_seconds"),
        when("disposition", F.lower(text("disposition"))).alias("disposition"),
        F.when(kind.isin("disposition", "field_visit"), text("agent_id")).alias("agent_id"),
        F.when(kind.isin("disposition", "field_visit"), text("remarks")).alias("remarks"),
        when("bot_transcript", text("transcript")).alias("transcript"),
        when("bot_transcript", text("who_answered")).alias("who_answered"),
        when("field_visit", F.lower(text("outcome"))).alias("outcome"),
        when("field_visit", instant(p["visit_time"])).alias("visit_time"),
        when("field_visit", p["dwell_seconds"].try_cast("bigint")).alias("dwell_seconds"),
        when("payment", p["amount"].try_cast("double")).alias("amount"),
        when("payment", text("payment_mode")).alias("payment_mode"),
        when("contact_point_update", text("source")).alias("update_source"),
        when("contact_point_update", F.lower(text("contact_type"))).alias("contact_type"),
        when("contact_point_update", F.lower(text("is_primary")).try_cast("boolean")).alias("update_primary"),
    ]


ENVELOPE = ("event_id", "event_type", "lender_id", "borrower_id", "account_id", "contact_point_ref")


def typed_events(raw: DataFrame, tie_col: str | None = "ingested_at") -> DataFrame:
    """The canonical log, one row per identifier, times and payload typed."""
    tie = [tie_col] if tie_col and tie_col in raw.columns else []
    cols = [*[F.col(c) for c in ENVELOPE], instant(F.col("occurred_at")).alias("occurred_at"), instant(F.col("received_at")).alias("received_at")]
    shaped = raw.select(*cols, *tie, *payload_columns(F.col("payload"), F.col("event_type")))
    return deliver_once(shaped, tie_col=tie_col).drop("n_copies", *tie)


def allowed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` pruned to the allow-list, and the names of what was dropped."""
    keep = [c for c in columns if c in df.columns]
    return df.select(*keep), [c for c in df.columns if c not in columns]


class EventSource(ABC):
    """The contract of a point-in-time source. Every frame is lazy."""

    @abstractmethod
    def events(self) -> DataFrame:
        """All typed events, whenever received."""

    @abstractmethod
    def contact_points(self, as_of: Column) -> DataFrame: ...

    @abstractmethod
    def borrowers(self) -> DataFrame: ...

    def visible(self, as_of: Column) -> DataFrame:
        """Events received at or before ``as_of``."""
        return self.events().where(F.col("received_at") <= as_of)

    def future(self, after: Column, upto: Column) -> DataFrame:
        """Events that happen in (after, upto], whenever received: for labels only."""
        return self.events().where((F.col("occurred_at") > after) & (F.col("occurred_at") <= upto))

    def max_received(self) -> DataFrame:
        return self.events().agg(F.max("received_at").alias("max_received"))

    def describe(self) -> dict[str, object]:
        return {"source": type(self).__name__}


class FrameSource(EventSource):
    """A source over DataFrames in memory or from any reader."""

    def __init__(self, events: DataFrame, contact_points: DataFrame, borrowers: DataFrame):
        self._events = typed_events(events)
        self._contacts, self.dropped_contact_columns = allowed(contact_points, CONTACT_COLUMNS)
        self._borrowers, self.dropped_borrower_columns = allowed(borrowers, BORROWER_COLUMNS)

    def events(self) -> DataFrame:
        return self._events

    def contact_points(self, as_of: Column) -> DataFrame:
        made = instant(F.col("created_at"))
        return self._contacts.withColumn("created_at", made).where(F.col("created_at") <= as_of)

    def borrowers(self) -> DataFrame:
        return self._borrowers

    def describe(self) -> dict[str, object]:
        return super().describe() | {"dropped_contact_columns": self.dropped_contact_columns, "dropped_borrower_columns": self.dropped_borrower_columns}


class ParquetSource(FrameSource):
    """The same over a folder of Parquet tables; a missing table raises FileNotFoundError."""

    def __init__(self, spark: SparkSession, folder: str, events: str = "contact_events"):
        self.folder = folder
        frames = []
        for name in (events, "contact_points", "borrowers"):
            path = f"{folder}/{name}.parquet"
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                raise FileNotFoundError(path)
            frames.append(spark.read.parquet(path))
        super().__init__(*frames)


class StoreSource(EventSource):
    """A source over an event store alone: contacts and borrowers are derived from first events."""

    def __init__(self, stored: DataFrame):
        self._events = typed_events(stored, tie_col=None)

    def events(self) -> DataFrame:
        return self._events

    def contact_points(self, as_of: Column) -> DataFrame:
        seen = self.visible(as_of).where(F.col("contact_point_ref").isNotNull())
        first = F.min_by(F.struct("update_source", "contact_type", "update_primary"), F.struct("received_at", "event_id"))
        out = seen.groupBy(*CP_KEYS).agg(first.alias("f"), F.min("occurred_at").alias("created_at"))
        return out.select(*CP_KEYS, F.col("f.contact_type").alias("type"), F.col("f.update_source").alias("source"), F.col("f.update_primary").alias("is_primary"), "created_at")

    def borrowers(self) -> DataFrame:
        return self._events.select("lender_id", "borrower_id").where(F.col("borrower_id").isNotNull()).distinct()
