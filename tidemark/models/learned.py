"""Learned models: boosted trees, calibration, propensity and positive-unlabelled risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import HIDDEN_COLUMNS
from tidemark.session import Scratch

KEYS_OUT = ("lender_id", "borrower_id", "account_id", "contact_point_ref", "event_id", "as_of")


def feature_names(df: DataFrame, label: str, drop: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns that are neither keys, the label nor columns of hidden truth."""
    out = {*KEYS_OUT, *HIDDEN_COLUMNS, label, *drop}
    return [c for c, t in df.dtypes if c not in out and (t in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint"))]


def as_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Doubles; a null recency (days_since_*) becomes 9999, any other null 0."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(9999.0 if c.startswith("days_since") else 0.0)).alias(c) for c in names]
    return df.select(*[c for c in df.columns if c not in names], *cells)


def fit_classifier(df: DataFrame, label: str, names: Sequence[str], kind: str = "gbt", **params):
    """A pipeline model with probability column; refuses labels of one class."""
    data = as_matrix(df, names).withColumn(label, F.col(label).cast("double"))
    seen = {r[0] for r in data.select(label).distinct().limit(3).collect()}
    if seen != {0.0, 1.0}:
        raise ValueError(f"the label must have both classes, got {sorted(seen, key=str)}")
    est = GBTClassifier(labelCol=label, maxIter=20, maxDepth=4, seed=7) if kind == "gbt" else LogisticRegression(labelCol=label, maxIter=50)
    for k, v in params.items():
        est = est.setParams(**{k: v})
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), est]).fit(data)


def predict(model, df: DataFrame, names: Sequence[str], out: str = "p") -> DataFrame:
    scored = model.transform(as_matrix(df, names))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class SegmentCalibrator:
    """Isotonic maps per segment, with a global one where a segment is thin (``least`` rows,
    ``least_pos`` positives, both classes)."""

    def __init__(self, least: int = 50, least_pos: int = 5):
        self.least, self.least_pos = least, least_pos
        self.maps: dict[str | None, list[tuple[float, float]]] = {}

    def fit(self, df: DataFrame, segment: str, y: str = "y", p: str = "p") -> SegmentCalibrator:
        data = df.select(F.col(segment).cast("string").alias("seg"), F.col(y).cast("double").alias("label"), F.col(p).cast("double").alias("f")).dropna(subset=["label", "f"])
        # Isotonic regression pools equal scores anyway, so the rows are read once, for their counts.
        with Scratch(df.sparkSession, "cells") as scratch:
            cells, _ = scratch.cut(data.groupBy("seg", "f").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("pos")).withColumn("rate", F.col("pos") / F.col("n")))
            sizes = {r["seg"]: (r["n"], r["pos"]) for r in cells.groupBy("seg").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
            thick = [s for s, (n, pos) in sizes.items() if s is not None and n >= self.least and self.least_pos <= pos < n]
            for s in [None, *thick]:
                part = cells if s is None else cells.where(F.col("seg") == s)
                model = IsotonicRegression(featuresCol="f", labelCol="rate", weightCol="n").fit(part)
                self.maps[s] = list(zip(map(float, model.boundaries), map(float, model.predictions), strict=True))
        return self

    def transform(self, df: DataFrame, segment: str, p: str = "p", out: str = "p_cal") -> DataFrame:
        spark = df.sparkSession
        rows = [(s, b, v) for s, m in self.maps.items() if s is not None for b, v in m]
        whole = self.maps[None]
        seg = F.col(segment).cast("string")
        table = spark.createDataFrame(rows, "seg string, b double, v double").groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("m")) if rows else spark.createDataFrame([], "seg string, m array<struct<b:double,v:double>>")
        base = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(v).alias("v")) for b, v in whole])
        joined = df.withColumn("tm_seg", seg).join(F.broadcast(table.withColumnRenamed("seg", "tm_seg")), "tm_seg", "left").withColumn("tm_m", F.coalesce("m", base))
        below = F.filter("tm_m", lambda x: x["b"] <= F.col(p))
        above = F.filter("tm_m", lambda x: x["b"] >= F.col(p))
        lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
        width = hi["b"] - lo["b"]
        mid = F.when(width > 0, lo["v"] + (hi["v"] - lo["v"]) * (F.col(p) - lo["b"]) / width).otherwise(lo["v"])
        value = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(mid)
        return joined.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop("tm_seg", "tm_m", "m")


class BetaCalibrator:
    """Beta calibration: a logistic map of log(p) and -log(1 - p); the plain rate where the labels have
    one class. With ``after`` it refuses rows whose split is not later than those the scores were
    fitted on."""

    def __init__(self, eps: float = 1e-6):
        self.eps, self.model, self.rate = eps, None, 0.0

    def _terms(self, df: DataFrame, p: str) -> DataFrame:
        held = F.least(F.lit(1 - self.eps), F.greatest(F.lit(self.eps), F.col(p).cast("double")))
        return df.withColumn("tm_a", F.log(held)).withColumn("tm_b", -F.log(1 - held))

    def fit(self, df: DataFrame, y: str = "y", p: str = "p", time: str | None = None, after: str | None = None) -> BetaCalibrator:
        data = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
        if time is not None and after is not None and not data.where(F.col(time) <= F.lit(after).cast("timestamp")).isEmpty():
            raise ValueError("calibration rows must be later than those the scores were fitted on")
        seen = data.agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count_distinct(y).alias("k")).first()
        self.rate = float(seen["rate"] or 0.0)
        self.model = fit_classifier(self._terms(data, p).select(F.col(y).cast("double").alias("y"), "tm_a", "tm_b"), "y", ["tm_a", "tm_b"], "logistic") if seen["k"] == 2 else None
        return self

    def transform(self, df: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.rate))
        return predict(self.model, self._terms(df, p), ["tm_a", "tm_b"], out).drop("tm_a", "tm_b")


def trace_history(traces: DataFrame, history: DataFrame) -> DataFrame:
    """Traces (account_id, start, ...) with what their account did up to each: n_dials, n_answered,
    n_payments, paid_before.

    ``history``: account_id, event_type, network_response, amount, at. Both sides are cut into days; the
    days of an account are summed first and carried forward by a running sum, and only events of a
    trace's own day meet it singly. Sums are of 1/1000, so they do not depend on order.
    """
    fields = ("n_dials", "n_answered", "n_payments", "milli")
    dial, pay = F.col("event_type") == "dial_attempt", F.col("event_type") == "payment"
    one = history.dropna(subset=["account_id", "at"]).select(
        "account_id",
        "at",
        F.to_date("at").alias("day"),
        dial.cast("bigint").alias("n_dials"),
        (dial & F.coalesce(F.col("network_response") == "answered", F.lit(False))).cast("bigint").alias("n_answered"),
        pay.cast("bigint").alias("n_payments"),
        F.coalesce(F.when(pay, F.round(F.col("amount") * 1000).cast("bigint")), F.lit(0)).alias("milli"),
    )
    daily = one.groupBy("account_id", "day").agg(*[F.sum(c).alias(c) for c in fields])
    starts = traces.withColumn("day", F.to_date("start"))
    marks = starts.select("account_id", "day").distinct()
    w = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    both = daily.unionByName(marks.select("account_id", "day", *[F.lit(0).cast("bigint").alias(c) for c in fields])).groupBy("account_id", "day").agg(*[F.sum(c).alias(c) for c in fields])
    carried = both.select("account_id", "day", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in fields])
    here = starts.select("account_id", "day", "start").join(one, ["account_id", "day"]).where(F.col("at") <= F.col("start")).groupBy("account_id", "start").agg(*[F.sum(c).alias(f"{c}_here") for c in fields])
    out = starts.join(carried, ["account_id", "day"], "left").join(here, ["account_id", "start"], "left")
    total = {c: F.coalesce(f"{c}_before", F.lit(0)) + F.coalesce(f"{c}_here", F.lit(0)) for c in fields}
    return out.select(*traces.columns, *[total[c].alias(c) for c in fields[:3]], (total["milli"] / 1000.0).alias("paid_before"))


class TraceOutcome:
    """P(pays within the window | traced, history before): trees on the uncensored traces; the base rate
    where they have fewer than two rows or one class. Held to [0.01, 0.99]."""

    FEATURES = ("n_dials", "n_answered", "n_payments", "paid_before")

    def __init__(self, **params):
        self.params, self.model, self.rate = params, None, 0.0

    def fit(self, traces: DataFrame) -> TraceOutcome:
        data = traces.where(~F.coalesce(F.col("censored"), F.lit(True)) & F.col("paid").isNotNull()).withColumn("y", F.col("paid").cast("double"))
        seen = data.agg(F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("k")).first()
        self.rate = float(seen["rate"] or 0.0)
        self.model = fit_classifier(data, "y", list(self.FEATURES), **self.params) if seen["n"] >= 2 and seen["k"] == 2 else None
        return self

    def predict(self, traces: DataFrame, out: str = "p_recover_30d") -> DataFrame:
        scored = traces.withColumn(out, F.lit(self.rate)) if self.model is None else predict(self.model, traces, list(self.FEATURES), out)
        return scored.withColumn(out, F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col(out))))


def inverse_propensity(df: DataFrame, p: str = "propensity", lo: float = 0.05, hi: float = 0.95, cap: float = 20.0) -> DataFrame:
    """1 / propensity held to [lo, hi], at most ``cap``."""
    return df.withColumn("w", F.least(F.lit(cap), 1.0 / F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(p)))))


def propensity_exact_share(df: DataFrame, logged: str, k: str, tol: float = 1e-6) -> DataFrame:
    """How well logged propensities equal 1 / k: the largest gap and the share within ``tol``."""
    gap = F.abs(F.col(logged) - 1.0 / F.col(k))
    return df.agg(F.max(gap).alias("max_gap"), F.avg((gap <= tol).cast("double")).alias("exact_share"))


def positive_unlabelled(df: DataFrame, observed: str, names: Sequence[str], out: str = "risk") -> DataFrame:
    """Elkan-Noto: a classifier of being observed, divided by its mean score on observed positives."""
    model = fit_classifier(df, observed, names)
    scored = predict(model, df, names, "s")
    c = scored.where(F.col(observed).cast("double") == 1.0).agg(F.avg("s").alias("c"))
    return scored.crossJoin(F.broadcast(c)).withColumn(out, F.least(F.lit(1.0), F.col("s") / F.nullif(F.col("c"), F.lit(0.0)))).drop("c", "s")


def choose_by_logloss(train: DataFrame, valid: DataFrame, label: str, names: Sequence[str], grid: Sequence[dict]) -> tuple[dict, float]:
    """The grid point with the least validation log loss; the first one wins ties."""
    from tidemark.operators.metrics import pointwise

    best: tuple[dict, float] | None = None
    for point in grid:
        scored = predict(fit_classifier(train, label, names, **point), valid, names)
        loss = pointwise(scored.withColumn("y", F.col(label).cast("int"))).first()["log_loss"]
        if best is None or loss < best[1]:
            best = (point, loss)
    return best
