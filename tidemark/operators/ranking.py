"""Ranks, budgets and shrunken rates."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_budget(candidates: DataFrame, group: str, order: Sequence[Column], cost: str, budget: float, id_col: str) -> DataFrame:
    """Takes candidates in order while they fit the group's budget, skipping those that do not.

    Skipping makes the choice sequential, so each group is one sorted stream that is read once; only
    what is left of the budget is kept between rows, and the sort spills, so a group may have any size.
    Before that, candidates that cannot matter leave: one dearer than the whole budget never fits.
    """
    fits = candidates.where(F.col(cost).isNotNull() & (F.col(cost) >= 0) & (F.col(cost) <= budget))
    keys = [f"o{i}" for i in range(len(order))]
    named = fits.select(F.col(group).alias("g"), *[o.alias(k) for k, o in zip(keys, order, strict=True)], F.col(id_col).alias("id"), F.col(cost).cast("double").alias("c"))
    rows = named.repartition("g").sortWithinPartitions("g", *keys, "id", "c").select("g", F.col("id").cast("string").alias("id"), "c")
    kind = rows.withColumn("rank", F.lit(0)).schema

    def fold(batches):
        now, left, rank = object(), 0.0, 0
        for b in batches:
            at, ranks = [], []
            for i, (g, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if g != now:
                    now, left, rank = g, float(budget), 0
                if c <= left:
                    left, rank = left - c, rank + 1
                    at.append(i)
                    ranks.append(rank)
            if at:
                kept = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ranks, pa.int32())], names=["g", "id", "c", "rank"])

    return rows.mapInArrow(fold, kind).select(F.col("g").alias(group), F.col("id").alias(id_col), F.col("c").alias(cost), "rank")


def prefix_budget(candidates: DataFrame, group: str, order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """The same where all costs of a group are equal: the running sum decides."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def shrunken_rate(hits: Column, n: Column, overall: Column, strength: float) -> Column:
    """(hits + strength * overall) / (n + strength)."""
    return (hits + strength * overall) / (n + strength)


def slot_rates(attempts: DataFrame, by: str, slot: str, y: str, strength: float = 50.0) -> DataFrame:
    """Shrunken rate per (segment, slot) and its multiplier on the overall rate, held to [0.5, 2]."""
    overall = attempts.agg(F.avg(F.col(y).cast("double")).alias("overall"))
    cells = attempts.groupBy(by, slot).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("hits")).crossJoin(F.broadcast(overall))
    rate = shrunken_rate(F.col("hits"), F.col("n"), F.col("overall"), strength)
    mult = F.least(F.lit(2.0), F.greatest(F.lit(0.5), rate / F.nullif(F.col("overall"), F.lit(0.0))))
    return cells.select(by, slot, "n", "hits", rate.alias("rate"), F.when(F.col("n") < 20, 1.0).otherwise(mult).alias("multiplier"))


def best_slot(rates: DataFrame, by: str, slot: str) -> DataFrame:
    """The slot of the greatest multiplier, the first by name on ties; null where all are neutral."""
    agg = rates.where(F.col(slot).isNotNull()).groupBy(by).agg(F.max("multiplier").alias("m"), F.min_by(slot, F.struct(-F.col("multiplier"), F.col(slot))).alias("s"), F.max(F.col("multiplier") != 1.0).alias("any"))
    return agg.select(by, F.when(F.col("any"), F.col("s")).alias("best_slot"))


def source_priors(contacts: DataFrame, bad: DataFrame, keys: Sequence[str], strength: float = 10.0, least: int = 20) -> DataFrame:
    """Smoothed share of bad contacts per source; a thin source gets the overall share."""
    rows = contacts.join(bad.select(*keys).distinct().withColumn("bad", F.lit(1)), list(keys), "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    overall = rows.agg(F.avg("bad").alias("overall"))
    cells = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("hits")).crossJoin(F.broadcast(overall))
    rate = shrunken_rate(F.col("hits"), F.col("n"), F.col("overall"), strength)
    return cells.select("source", "n", F.when(F.col("n") >= least, rate).otherwise(F.col("overall")).alias("prior"))


def posterior_mean(prior: Column, strength: float, hits: Column, n: Column) -> Column:
    """Mean of the Beta posterior after ``hits`` of ``n`` with a prior of ``strength`` observations."""
    return (prior * strength + hits) / (strength + n)


def conformal_radius(scored: DataFrame, alpha: float, by: str, ranges: int = 1024) -> DataFrame:
    """Per segment the ceil((1 - alpha)(n + 1))-th smallest absolute residual, the largest if there
    are fewer. Residuals are counted by range first; only the range that holds the rank is ordered, so no
    task sorts a segment."""
    res = scored.withColumn("r", F.abs(F.col("y") - F.col("p"))).where(F.col("r").isNotNull())
    cells = res.groupBy(by, "r").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.least(F.col("r"), F.lit(1.0)) * ranges))
    total = cells.groupBy(by).agg(F.sum("n").alias("total"), F.max("r").alias("most")).withColumn("rank", F.ceil(F.lit(1.0 - alpha) * (F.col("total") + 1)))
    below = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = cells.groupBy(by, "range").agg(F.sum("n").alias("rn")).withColumn("before", F.coalesce(F.sum("rn").over(below), F.lit(0)))
    held = whole.join(total, by).where((F.col("before") < F.col("rank")) & (F.col("before") + F.col("rn") >= F.col("rank")))
    inside = Window.partitionBy(by, "range").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    at = cells.join(held.select(by, "range", "before", "rank"), [by, "range"]).withColumn("cum", F.col("before") + F.sum("n").over(inside))
    found = at.where(F.col("cum") >= F.col("rank")).groupBy(by).agg(F.min("r").alias("at"))
    return total.join(found, by, "left").select(by, F.coalesce("at", "most").alias("radius"), F.col("total").alias("n"))
