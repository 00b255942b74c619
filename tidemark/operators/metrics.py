"""Metrics of scored rows (y in 0/1, p in [0, 1]) as aggregations; no ranking needs one task.

Ranks come from counts per distinct score: the scores are counted with map-side combine, and running
sums over them go by ranges of the score first, then inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024
#: Cumulative probabilities of a Poisson(1) variable: below the first it is 0, and so on.
POISSON_EDGES = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def running_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: n, pos, and above_n, above_pos (rows with a greater score). A column ``w`` is
    the number of rows a row stands for."""
    w = F.col("w").cast("bigint") if "w" in scored.columns else F.lit(1).cast("bigint")
    cells = scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*by, "p").agg(F.sum(w).alias("n"), F.sum(w * F.col("y").cast("bigint")).alias("pos"))
    cells = cells.withColumn("range", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))) * RANGES))
    whole = cells.groupBy(*by, "range").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp"))
    down = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*by, "range", F.coalesce(F.sum("rn").over(down), F.lit(0)).alias("bn"), F.coalesce(F.sum("rp").over(down), F.lit(0)).alias("bp"))
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(before, [*by, "range"]).select(
        *by,
        "p",
        "n",
        "pos",
        (F.col("bn") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above_n"),
        (F.col("bp") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("above_pos"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC with ties averaged; null where one class is missing."""
    c = running_counts(scored, by)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg * F.col("above_pos") + neg * F.col("pos") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return c.groupBy(*by).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def pr_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, thresholds grouped by distinct score."""
    c = running_counts(scored, by)
    at_n, at_pos = F.col("above_n") + F.col("n"), F.col("above_pos") + F.col("pos")
    return c.groupBy(*by).agg((F.sum(F.col("pos") * at_pos / at_n) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def pointwise(scored: DataFrame, by: Sequence[str] = (), positive_cost: float = 1.0, negative_cost: float = 1.0) -> DataFrame:
    """Brier score, log loss and cost-weighted log loss."""
    y, p = F.col("y").cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p")))
    safe = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("p")))
    loss = -(y * F.log(safe) + (1 - y) * F.log(1 - safe))
    cost = -(positive_cost * y * F.log(safe) + negative_cost * (1 - y) * F.log(1 - safe))
    return scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(cost).alias("cost_weighted_loss")
    )


def bin_of(p: Column, bins: int = 10) -> Column:
    """Right-closed bins of equal width, 1 to ``bins``; 0 belongs to the first."""
    out = F.when(p <= 1.0 / bins, 1)
    for k in range(2, bins):
        out = out.when(p <= k / bins, k)
    return out.otherwise(bins)


def reliability(scored: DataFrame, spark, bins: int = 10) -> DataFrame:
    """bin, n, mean predicted, observed rate; every bin has a row."""
    got = scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def calibration_error(scored: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    b = scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*by, bin_of(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def at_thresholds(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Precision and recall at each threshold, in one pass."""
    ok = scored.where(F.col("p").isNotNull() & F.col("y").isNotNull())
    y = F.col("y") == 1
    sums = [F.count_if(y).alias("pos")]
    for i, t in enumerate(thresholds):
        sums += [F.count_if((F.col("p") >= t) & y).alias(f"tp{i}"), F.count_if((F.col("p") >= t) & ~y).alias(f"fp{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("pos") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)])
    flat = ok.agg(*sums).select(F.inline(rows))
    tp = F.col("tp").cast("double")
    return flat.select("*", (tp / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (tp / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def top_hits(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """Positives among the ``k`` best scores, per 1000; a top-k, ties by id."""
    top = scored.orderBy(F.desc_nulls_last("p"), id_col).limit(k)
    return top.agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("y").cast("bigint")) * 1000.0 / F.count(F.lit(1))).alias("per_1000"))


def effective_sample_size(weights: DataFrame, w: str = "w") -> DataFrame:
    return weights.agg((F.sum(w) * F.sum(w) / F.nullif(F.sum(F.col(w) * F.col(w)), F.lit(0.0))).alias("ess"))
