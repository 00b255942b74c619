"""An event store of Parquet tables in buckets: merge, insert-or-ignore, upsert, late marks.

Events lie in the buckets of their identifiers, dead letters in those of their hashes, watermarks and
marks in those of their contact points. A batch reads and rewrites the buckets that its own rows fall in;
logs are appended to. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import q
from tidemark.operators.late_events import KEYS, LateState, current_watermarks
from tidemark.sources.buckets import BucketTable

#: The keys whose hash gives the bucket of a row of each table.
TABLE_KEYS = {"events": ("event_id",), "dead_letter": ("row_hash",), "watermarks": KEYS, "dirty_contact_points": KEYS}


class EventStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def table(self, name: str, keys: Sequence[str] | None = None) -> BucketTable:
        return BucketTable(self.spark, f"{self.root}/{name}", keys or TABLE_KEYS[name], self.buckets)

    def late_state(self) -> LateState:
        """The running daily totals of the store, corrected batch by batch."""
        return LateState(self.spark, f"{self.root}/late", self.buckets)

    def read(self, table: str) -> DataFrame | None:
        return self.table(table).read()

    # operations

    def merge_events(self, staged: DataFrame, id_col: str = "event_id", order: Sequence[str] = ("received_at", "occurred_at", "payload")) -> dict[str, int]:
        """Keeps the earliest copy of each identifier over stored and staged rows; ties go by all columns.

        Returns how many identifiers were inserted and how many staged ones were there already. Rows
        without an identifier cannot be matched: each is inserted, and a replayed batch inserts it again.
        """
        events = self.table("events", (id_col,))
        order = [o for o in order if o in staged.columns]
        rank = F.struct(*[F.struct(q(o).isNull(), q(o)) for o in order], F.xxhash64(*[q(c) for c in sorted(staged.columns)]))
        best = lambda df: df.where(q(id_col).isNotNull()).groupBy(q(id_col)).agg(F.min_by(F.struct(*[q(c) for c in staged.columns]), rank).alias("b")).select("b.*")
        nameless = staged.where(q(id_col).isNull())
        new = best(staged)
        where = events.touched(staged)
        old = events.read(where)
        if old is None:
            inserted, there = new.count() + nameless.count(), 0
            events.rewrite(where, new.unionByName(nameless))
            return {"inserted": inserted, "duplicates": there}
        have = old.where(q(id_col).isNotNull()).select(q(id_col), F.lit(True).alias("tm_stored"))
        counts = new.join(have, id_col, "left").agg(F.count_if(F.col("tm_stored").isNull()).alias("i"), F.count_if("tm_stored").alias("d")).first()
        lost = nameless.count()
        known = old.unionByName(new, allowMissingColumns=True).select(*[q(c) for c in staged.columns], *[q(c) for c in old.columns if c not in staged.columns])
        merged = best(known) if set(known.columns) == set(staged.columns) else known.where(q(id_col).isNotNull()).groupBy(q(id_col)).agg(F.min_by(F.struct("*"), rank).alias("b")).select("b.*")
        events.rewrite(where, merged.unionByName(old.where(q(id_col).isNull()), allowMissingColumns=True).unionByName(nameless, allowMissingColumns=True))
        return {"inserted": counts["i"] + lost, "duplicates": counts["d"]}

    def unseen(self, staged: DataFrame, id_col: str = "event_id") -> DataFrame:
        """One row for each staged identifier that the store does not hold yet."""
        events = self.table("events", (id_col,))
        rank = F.xxhash64(*[q(c) for c in sorted(staged.columns)])
        new = staged.where(q(id_col).isNotNull()).groupBy(q(id_col)).agg(F.min_by(F.struct(*[q(c) for c in staged.columns]), F.struct("received_at", rank)).alias("b")).select("b.*")
        old = events.read(events.touched(staged))
        return new if old is None else new.join(old.select(q(id_col)), id_col, "left_anti")

    def insert_or_ignore(self, table: str, rows: DataFrame, keys: Sequence[str]) -> int:
        """Adds rows whose key is new, for each the least by all columns; the number added."""
        at = self.table(table, keys)
        rest = [c for c in rows.columns if c not in keys]
        rows = rows.dropna(subset=list(keys)).groupBy(*[q(k) for k in keys]).agg(F.min(F.struct(*[q(c) for c in rest])).alias("tm_r")).select(*[q(k) for k in keys], "tm_r.*").select(*[q(c) for c in rows.columns])
        old = at.read(at.touched(rows))
        new = rows if old is None else rows.join(old.select(*[q(k) for k in keys]), list(keys), "left_anti")
        n = new.count()
        if n or old is None:
            at.append(new)
        return n

    def upsert_watermark(self, marks: DataFrame) -> None:
        """Appends marks (contact_point_ref, lender_id, watermark_ts, updated_at); the latest counts."""
        self.table("watermarks").append(marks)

    def mark_late(self, staged: DataFrame, reason: str = "late_event") -> DataFrame:
        """Marks keys with a staged event received after their watermark or that happened before it;
        returns the keys newly marked. Only the buckets of the staged keys are read."""
        marks, dirty = self.table("watermarks"), self.table("dirty_contact_points")
        where = marks.touched(staged)
        log = marks.read(where)
        if log is None:
            return staged.select(*KEYS).limit(0)
        late = late_keys(staged, log)
        have = dirty.read(where)
        new = late if have is None else late.join(have.where(F.col("reason") == reason).select(*KEYS), list(KEYS), "left_anti")
        rows = [(r[0], r[1]) for r in new.take(1)]
        out = new.withColumn("reason", F.lit(reason)).withColumn("marked_at", F.current_timestamp())
        if not rows:
            return staged.select(*KEYS).limit(0)
        before = {f for fs in dirty._manifest().get("folders", {}).values() for f in fs}
        dirty.append(out)
        added = sorted(f for fs in dirty._manifest()["folders"].values() for f in fs if f not in before)
        return self.spark.read.schema(dirty._manifest()["schema"]).parquet(*[f"{dirty.root}/{f}" for f in added]).select(*KEYS)

    def vacuum(self, table: str) -> int:
        """Deletes folders of a table that no state names any more; frames over older ones break."""
        return self.table(table).vacuum()

    def read_events(self, received_before: Column | None = None, types: Sequence[str] = (), lender: str | None = None, refs: Sequence[str] = (), borrowers: Sequence[str] = (), accounts: Sequence[str] = (), since: Column | None = None, until: Column | None = None, limit: int | None = None) -> DataFrame | None:
        """Events by filters that reach the Parquet scan, in order of time; strictly before."""
        df = self.read("events")
        if df is None:
            return None
        for cond in (
            F.col("received_at") < received_before if received_before is not None else None,
            F.col("event_type").isin(*types) if types else None,
            F.col("lender_id") == lender if lender else None,
            F.col("contact_point_ref").isin(*refs) if refs else None,
            F.col("borrower_id").isin(*borrowers) if borrowers else None,
            F.col("account_id").isin(*accounts) if accounts else None,
            F.col("occurred_at") >= since if since is not None else None,
            F.col("occurred_at") <= until if until is not None else None,
        ):
            df = df if cond is None else df.where(cond)
        df = df.orderBy("occurred_at", "event_id")
        return df if limit is None else df.limit(limit)

    def counts(self, tables: Sequence[str] = ("events", "dead_letter", "watermarks", "dirty_contact_points")) -> dict[str, int]:
        return {t: (df.count() if (df := self.read(t)) is not None else 0) for t in tables}


def late_keys(events: DataFrame, watermark_log: DataFrame) -> DataFrame:
    """Keys with an event received after their watermark or that happened before it."""
    marks = current_watermarks(watermark_log)
    late = (F.col("received_at") > F.col("watermark_ts")) | (F.col("occurred_at") < F.col("watermark_ts"))
    return events.join(marks, list(KEYS)).where(late).select(*KEYS).distinct()
