"""Messages delivered more than once: exactly one copy of each identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import canonical_id, fresh, instant, pack_id, q, unpack_id


#: An identifier with more than one in ``PARTS`` of all rows is hot, so there are fewer than ``PARTS``.
PARTS = 4096
#: And none is with fewer copies than this.
LEAST_HOT = 10_000


def spread(c: Column) -> Column:
    """``c`` between a byte of 1 and four random bytes: such rows go to all tasks of an exchange alike."""
    salt = F.unhex(F.lpad(F.hex(F.floor(F.rand(3) * 2**32).cast("bigint")), 8, "0"))
    return F.concat(F.unhex(F.lit("01")), c, salt)


def deliver_once(
    new: DataFrame,
    stored: DataFrame | None = None,
    id_col: str = "event_id",
    received_col: str = "received_at",
    copies_col: str = "n_copies",
    tie_col: str | None = "ingested_at",
) -> DataFrame:
    """One row per identifier over all stored and new messages: the copy received first.

    Identifier frequencies are aggregated first, with map-side combine. Rows whose identifier occurs
    once pass straight through; only the repeated groups are ranked, by an aggregation with map-side
    combine. The two results are united. ``copies_col`` counts the copies.

    No identifier meets in one task: the hot ones, at most ``PARTS`` by their definition, are
    broadcast with their counts, and their rows go through the exchange under a random key; so do
    rows without an identifier.

    Defined cases: the identifier comes out canonical (``canonical_id``). Rows with a null or blank
    identifier cannot be matched and all pass, with one copy each. A copy without a readable
    ``received_at`` loses against any other; ties go to the earliest ``tie_col``, then to the
    content hash, so the result does not depend on row order. An empty table gives an empty table.
    Other columns pass as they are; a clash with ``copies_col`` raises ValueError.
    """
    rows = new if stored is None else new.unionByName(stored, allowMissingColumns=True)
    if copies_col in rows.columns:
        raise ValueError(f"the input already has a column {copies_col}")
    names = rows.columns
    n, best, key, hot = (fresh(rows, x) for x in ("tm_n", "tm_best", "tm_key", "tm_hot"))
    # Keys are binary: 16 bytes for a UUID, 17 and more for other texts, none without an identifier.
    rows = rows.withColumn(key, pack_id(canonical_id(q(id_col).cast("string"))))
    counts = rows.where(F.length(q(key)) > 0).groupBy(q(key)).agg(F.count(F.lit(1)).alias(n))
    total = counts.agg((F.coalesce(F.sum(n), F.lit(0)) / PARTS).alias("tm_share"))
    hottest = counts.where(q(n) > LEAST_HOT).crossJoin(F.broadcast(total)).where(q(n) > q("tm_share")).select(q(key), q(n).alias(hot))
    rows = rows.join(F.broadcast(hottest), key, "left")
    # Salted keys equal none of the counted ones: these have 16 bytes, or begin with a byte of 0.
    rows = rows.withColumn(key, F.when((F.length(q(key)) == 0) | q(hot).isNotNull(), spread(q(key))).otherwise(q(key)))
    joined = rows.join(counts.where(q(n) > 1).hint("shuffle_hash"), key, "left")
    plain = F.when(q(hot).isNotNull(), F.substring(q(key), F.lit(2), F.length(q(key)) - 5)).otherwise(F.when(F.length(q(key)) != 5, q(key)))
    flagged = joined.withColumn(id_col, unpack_id(plain)).select(*[q(c) for c in names], F.coalesce(q(hot), q(n)).alias(n))
    hashable = [q(c) for c, kind in flagged.select(*[q(c) for c in names]).dtypes if "map<" not in kind and kind != "variant"]
    # Always true. It keeps later filters and prunings above it, so that the passing branch reads the
    # very exchange that the ranked branch needs whole; else the rows would be shuffled twice.
    here = (F.rand(0) >= 0) | (F.xxhash64(*hashable) == 0)
    singles = flagged.where(q(n).isNull()).where(here).select(*[q(c) for c in names], F.lit(1).cast("bigint").alias(copies_col))
    received = instant(q(received_col))
    order = [received.isNull(), received]
    if tie_col and tie_col in names:
        order += [q(tie_col).isNull(), q(tie_col)]
    order += [F.xxhash64(*hashable)]
    repeated = (
        flagged.where(q(n).isNotNull())
        .groupBy(q(id_col))
        .agg(
            F.min_by(F.struct(*[q(c) for c in names]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(best),
            F.max(q(n)).alias(n),
        )
        .select(*[F.col(f"`{best}`.`{c}`").alias(c) for c in names], q(n).alias(copies_col))
    )
    return singles.unionByName(repeated)
