"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import fresh, q
from tidemark.operators.deliver_once import LEAST_HOT, PARTS


def hot_values(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Values of ``key`` with more than one in ``PARTS`` of all rows, fewer than ``PARTS`` by that
    definition. ``weight``: a column that has the number of rows a row stands for."""
    n = F.count(F.lit(1)) if weight is None else F.sum(q(weight))
    counts = rows.where(q(key).isNotNull()).groupBy(q(key)).agg(n.alias("tm_rows"))
    total = counts.agg((F.coalesce(F.sum("tm_rows"), F.lit(0)) / PARTS).alias("tm_share"))
    return counts.where(F.col("tm_rows") > LEAST_HOT).crossJoin(F.broadcast(total)).where(F.col("tm_rows") > F.col("tm_share")).select(q(key))


def salted(key: Column, hot: Column) -> Column:
    """``key`` as text, and where ``hot`` with a random number after it, which sends such rows to all tasks
    of an exchange alike."""
    return F.when(hot, F.concat_ws("\u0000", key.cast("string"), F.floor(F.rand(11) * 2**30).cast("string"))).otherwise(key.cast("string"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has one row for each value of ``key``.

    The table's rows of the hot values are broadcast, fewer than ``PARTS``; rows with such a value cross
    the exchange under random numbers, so that no value meets in one task, whatever the engine's own skew
    handling does. ``hot`` saves counting where the hot values are known. The columns of ``table`` but
    the key must not be in ``rows``.
    """
    values = [c for c in table.columns if c != key]
    found, salt = fresh(rows, "tm_found", values), fresh(rows, "tm_salt", values)
    near = f"{found}_near"
    hot = hot_values(rows, key) if hot is None else hot
    top = table.join(F.broadcast(hot), key, "left_semi").select(q(key), F.struct(F.lit(True).alias("tm_hit"), *[q(c) for c in values]).alias(near))
    # The salt is part of the one join key: a key column of its own, constant on one side, would be
    # taken out of the join by the optimiser. Hot rows have their match already, whatever theirs meets.
    mixed = rows.join(F.broadcast(top), key, "left").withColumn(salt, salted(q(key), q(near).isNotNull()))
    cold = table.select(q(key).cast("string").alias(salt), F.struct(F.lit(True).alias("tm_hit"), *[q(c) for c in values]).alias(found))
    joined = mixed.join(cold, salt, "left").withColumn(found, F.coalesce(q(near), q(found))).where(q(found).isNotNull())
    return joined.select(*[q(c) for c in rows.columns], *[q(found)[c].alias(c) for c in values])
