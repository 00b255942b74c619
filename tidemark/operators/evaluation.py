"""Evaluation views: wasted dials, coverage, avoidance against invalid lines, segments, account frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.learned import feature_names


def wasted_attempts(dials: DataFrame, dead: DataFrame, ks: Sequence[int] = (1, 3, 6)) -> DataFrame:
    """Dials on each dead reference before the first action on it, and whether at most k were.

    ``dead``: contact_point_ref, action_at (null if none was taken)."""
    cut = dead.groupBy("contact_point_ref").agg(F.min("action_at").alias("action_at"))
    before = F.col("action_at").isNull() | (F.col("occurred_at") < F.col("action_at"))
    n = dials.join(cut, "contact_point_ref").groupBy("contact_point_ref").agg(F.count_if(before).alias("n_wasted"))
    out = cut.join(n, "contact_point_ref", "left").withColumn("n_wasted", F.coalesce("n_wasted", F.lit(0)))
    return out.select("contact_point_ref", "n_wasted", *[(F.col("action_at").isNotNull() & (F.col("n_wasted") <= k)).alias(f"within_{k}") for k in ks])


def coverage(scores: DataFrame, accounts: DataFrame, dead: Column, threshold: float) -> DataFrame:
    """Accounts with a viable contact, and those with none."""
    viable = (~dead) & (F.col("p") >= threshold)
    best = scores.groupBy("account_id").agg(F.max(viable).alias("covered"))
    return accounts.select("account_id").distinct().join(best, "account_id", "left").select("account_id", F.coalesce("covered", F.lit(False)).alias("covered"))


def account_aggregate(features: DataFrame, label: str, key: str = "account_id") -> DataFrame:
    """Mean and maximum of every numeric feature per account, and its number of contacts."""
    names = feature_names(features, label)
    cells = [f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", lambda x: F.avg(F.col(x).cast("double"))), ("max", lambda x: F.max(F.col(x).cast("double"))))]
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("n_contacts"), *cells)


def recency_bucket(days: Column) -> Column:
    """0-1, 2-3, 4-7, 8-14, 15-30, over 30 days; ``never`` for null."""
    out = F.when(days.isNull(), "never")
    for top, name in ((1, "0-1"), (3, "2-3"), (7, "4-7"), (14, "8-14"), (30, "15-30")):
        out = out.when(days <= top, name)
    return out.otherwise("30+")


def segment(*cols: Column) -> Column:
    """Columns joined by ``|``, ``none`` for null."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("none")) for c in cols])


def rank_contacts(scores: DataFrame, group: Sequence[str], viable: Column, order: Sequence[str] = ("p_rpc", "confidence"), tie: str = "contact_point_ref") -> DataFrame:
    """Viable contacts of a group by score, the others after them."""
    w = Window.partitionBy(*group).orderBy(F.when(viable, 0).otherwise(1), *[F.desc_nulls_last(c) for c in order], tie)
    return scores.withColumn("position", F.row_number().over(w))


def dominant_state(posterior: dict[str, Column]) -> Column:
    """The most likely state, the first of equals."""
    top = F.greatest(*posterior.values())
    out = F
    for name, c in posterior.items():
        out = out.when(c == top, name)
    return out.otherwise(None)


def normalised(posterior: dict[str, Column]) -> dict[str, Column]:
    """Masses held at 0 or more, null as 0, summing to 1 where there is any."""
    held = {k: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))) for k, c in posterior.items()}
    total = sum(held.values(), F.lit(0.0))
    return {k: F.when(total > 0, c / total).otherwise(c) for k, c in held.items()}


def stale_confidence(confidence: Column, age_hours: Column, most_hours: float, floor: float) -> Column:
    """A cached confidence that decays with age, down to a floor."""
    return F.round(confidence * F.greatest(F.lit(floor), 1.0 - age_hours / most_hours), 4)


def merged_risk(features: DataFrame, risk: DataFrame, keys: Sequence[str], column: str = "recycled_risk") -> DataFrame:
    """``column`` replaced by the newer risk, 0 where there is none, held to [0, 1]."""
    new = risk.select(*keys, F.col(column).alias("tm_risk"))
    out = features.drop(column).join(new, list(keys), "left")
    return out.withColumn(column, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("tm_risk", F.lit(0.0))))).drop("tm_risk")
