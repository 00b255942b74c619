"""Per-entity feature table from events, by mergeable sparse vectors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary of event types is collected; more types than this are refused, never dropped.
MAX_TYPES = 4096


def type_vocabulary(events: DataFrame) -> list[str]:
    """The distinct event types in order; a null or blank type is ``untyped``."""
    found = [r[0] for r in events.select(_kind().alias("t")).distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types; they cannot become columns; sparse_cells gives the long form")
    return sorted(found)


def _kind():
    return F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("untyped"))


def sparse_cells(events: DataFrame, entity: str = "contact_point_ref") -> DataFrame:
    """The long form: entity, event_type, n, total, last, one row for each pair that has events.

    It has no bound on the number of types and is the way where they are too many to become columns.
    ``events``: the entity, event_type, occurred_at (timestamp), amount (bigint, in 1/1000, so that
    totals do not depend on the order of addition). Aggregated with map-side combine. Rows with a null
    entity are left out.
    """
    return (
        events.where(F.col(entity).isNotNull())
        .select(F.col(entity).alias("entity"), _kind().alias("event_type"), "occurred_at", "amount")
        .groupBy("entity", "event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("amount"), F.lit(0).cast("bigint")).alias("total"),
            F.max("occurred_at").alias("last"),
        )
    )


def sparse_vectors(events: DataFrame, types: Sequence[str], entity: str = "contact_point_ref") -> DataFrame:
    """One row per entity: ``vec``, a sorted array of (i, n, total, last), i the index of the type.

    ``events`` as for ``sparse_cells``. Types are joined to their indices, at most ``MAX_TYPES`` rows, and
    the cells aggregated per entity and type with map-side combine before they meet in a vector, so a
    vector never has more cells than there are types. Rows with a null entity are left out, and so are
    types that the vocabulary lacks.
    """
    index = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "tm_type string, i int")
    cells = (
        events.where(F.col(entity).isNotNull())
        .select(F.col(entity).alias("entity"), _kind().alias("tm_type"), "occurred_at", "amount")
        .join(F.broadcast(index), "tm_type")
        .groupBy("entity", "i")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("amount"), F.lit(0).cast("bigint")).alias("total"),
            F.max("occurred_at").alias("last"),
        )
    )
    return cells.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("i", "n", "total", "last"))).alias("vec"))


def merge_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """The vectors of two batches of events added: counts and totals sum, the latest time wins."""
    cells = a.unionByName(b).select("entity", F.inline("vec"))
    merged = cells.groupBy("entity", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))
    return merged.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("i", "n", "total", "last"))).alias("vec"))


def column_stem(kind: str) -> str:
    return re.sub(r"[^0-9a-z_]+", "_", kind.lower())


def column_stems(types: Sequence[str]) -> list[str]:
    """The column stem of each type; types whose spellings give one stem are told apart by index."""
    stems = [column_stem(t) for t in types]
    return [s if stems.count(s) == 1 else f"{s}_{i}" for i, s in enumerate(stems)]


def expand(vectors: DataFrame, types: Sequence[str], as_of, entity: str = "contact_point_ref") -> DataFrame:
    """Columns ``T_n``, ``T_days`` and ``T_total`` for every type T.

    Types whose spellings give one column name are told apart by their index. Counts and totals are
    0 and days null where an entity has no event of the type. ``T_days`` counts UTC dates from the
    latest event to ``as_of``.
    """
    stems = column_stems(types)
    # The sorted vector is spread over an array with a place for each type, in one pass; a column is then
    # one look-up by position.
    cell_type = vectors.schema["vec"].dataType.elementType.simpleString()
    empty = F.lit(None).cast(cell_type)

    def piece(x, k):
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get("vec", k - 1)["i"])
        return F.concat(F.array_repeat(empty, x["i"] - before - 1), F.array(x))

    rest = F.array_repeat(empty, F.lit(len(types) - 1) - F.coalesce(F.try_element_at("vec", F.lit(-1))["i"], F.lit(-1)))
    held = vectors.select("entity", F.concat(F.flatten(F.transform("vec", piece)), rest).alias("dense"))
    dense = held.select("entity", *[F.get("dense", F.lit(i)).alias(f"c{i}") for i in range(len(types))])
    out = [F.col("entity").alias(entity)]
    for i, s in enumerate(stems):
        cell = F.col(f"c{i}")
        out += [
            F.coalesce(cell["n"], F.lit(0).cast("bigint")).alias(f"{s}_n"),
            F.datediff(F.to_date(as_of), F.to_date(cell["last"])).alias(f"{s}_days"),
            (F.coalesce(cell["total"], F.lit(0).cast("bigint")) / F.lit(1000.0)).alias(f"{s}_total"),
        ]
    return dense.select(*out)
