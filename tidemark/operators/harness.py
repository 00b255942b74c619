"""Evaluation over rolling origins: point-in-time features, registered scorers, metrics with intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.labels import mode_of
from tidemark.operators.telephony import trailing_run
from tidemark.sources.pit import CP_KEYS

DAY_US = 86_400_000_000.0
MINI_RESPONSES = ("switched_off", "not_reachable", "does_not_exist", "no_answer", "immediate_hangup")


# Scorers -------------------------------------------------------------------------------------


class Scorer(Protocol):
    """What scores contact points: ``fit`` sees labelled features (label ``y``), ``score`` adds ``p``."""

    def fit(self, train: DataFrame) -> Scorer: ...

    def score(self, features: DataFrame) -> DataFrame: ...


_SCORERS: dict[str, Callable[[], Scorer]] = {}


def register_scorer(name: str, make: Callable[[], Scorer]) -> None:
    """Makes a scorer known by name; a name can be taken once."""
    if name in _SCORERS:
        raise ValueError(f"there is a scorer {name} already")
    _SCORERS[name] = make


def get_scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"no scorer {name}; known are {sorted(_SCORERS)}")
    return _SCORERS[name]()


def scorer_names() -> list[str]:
    return sorted(_SCORERS)


class RuleScorer:
    """A scorer that is an expression over the features and learns nothing."""

    def __init__(self, rule: Callable[[], Column]):
        self.rule = rule

    def fit(self, train: DataFrame) -> RuleScorer:
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), self.rule())))


class TreeScorer:
    """Boosted trees over all numeric features; the training rate where the labels have one class."""

    def __init__(self, **params):
        self.params, self.model, self.names, self.rate = params, None, [], 0.0

    def fit(self, train: DataFrame) -> TreeScorer:
        from tidemark.models import learned

        self.names = learned.feature_names(train, "y", ("origin",))
        seen = train.agg(F.avg(F.col("y").cast("double")).alias("rate"), F.count_distinct("y").alias("k")).first()
        self.rate = float(seen["rate"] or 0.0)
        self.model = learned.fit_classifier(train, "y", self.names, **self.params) if seen["k"] == 2 else None
        return self

    def score(self, features: DataFrame) -> DataFrame:
        from tidemark.models import learned

        if self.model is None:
            return features.withColumn("p", F.lit(self.rate))
        kept = features.select(*[c for c in features.columns if c not in self.names])
        got = learned.predict(self.model, features, self.names).select(*kept.columns, "p")
        return got


register_scorer("incumbent", lambda: RuleScorer(lambda: 0.5 / (1 + F.col("consec_failures")) + 0.05 * F.col("is_primary")))
register_scorer("answer_rate", lambda: RuleScorer(lambda: (F.col("n_answered") + 1) / (F.col("n_attempts") + 2)))
register_scorer("recency", lambda: RuleScorer(lambda: F.coalesce(1 / (1 + F.col("days_since_last_answer")), F.lit(0.0))))
register_scorer("trees", TreeScorer)


# Features and labels -------------------------------------------------------------------------


def mini_features(dials: DataFrame, as_of: Column, primary: DataFrame | None = None) -> DataFrame:
    """A small point-in-time feature set per contact point from its dials received by ``as_of``.

    ``dials``: the keys, event_id, occurred_at, received_at, network_response, ring_seconds. Counts, the
    answer rate, dials of the last 7 and 30 days, the dials since the last answer in the order of
    (occurred_at, received_at, event_id), exact days since the last dial and answer (null where there
    is none), the mean ring (0 where unknown) and counts by response. ``primary``: keys, is_primary.
    """
    keys = list(CP_KEYS)
    seen = dials.where(F.col("received_at") <= as_of).dropna(subset=keys)
    answered = F.coalesce(F.col("network_response") == "answered", F.lit(False))
    recent = lambda n: F.count_if(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL '{n}' DAY"))
    days = lambda c: (F.unix_micros(as_of) - F.unix_micros(c)) / DAY_US
    counts = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(answered).alias("n_answered"),
        F.avg(answered.cast("double")).alias("answer_rate"),
        recent(7).alias("n_recent_7d"),
        recent(30).alias("n_recent_30d"),
        days(F.max("occurred_at")).alias("days_since_last_attempt"),
        days(F.max(F.when(answered, F.col("occurred_at")))).alias("days_since_last_answer"),
        F.coalesce(F.avg("ring_seconds"), F.lit(0.0)).alias("avg_ring_seconds"),
        *[F.count_if(F.coalesce(F.col("network_response") == r, F.lit(False))).alias(f"n_{r}") for r in MINI_RESPONSES],
    )
    runs = trailing_run(seen, F.when(answered, "answered").otherwise("failed"), "outcome")
    streak = runs.select(*keys, F.when(F.col("last_outcome") == "answered", 0).otherwise(F.col("run_outcome")).cast("bigint").alias("consec_failures"))
    out = counts.join(streak, keys)
    if primary is None:
        return out.withColumn("is_primary", F.lit(0.0))
    return out.join(primary, keys, "left").withColumn("is_primary", F.coalesce(F.col("is_primary").cast("double"), F.lit(0.0)))


def dialled_only(labels: DataFrame) -> DataFrame:
    """Rows that are not censored; an unknown flag counts as censored, and a frame without one has none."""
    if "censored" not in labels.columns:
        return labels.limit(0)
    return labels.where(~F.coalesce(F.col("censored"), F.lit(True)))


def train_accounts_only(labels: DataFrame, splits: DataFrame, split: str = "train") -> DataFrame:
    """Labels of the accounts of one split (account_id, split); other accounts are never a source."""
    own = splits.where(F.col("split") == split).select("account_id").distinct()
    return labels.join(own, "account_id", "left_semi")


def random_arm(events: DataFrame, column: str = "dialling_arm", values: Sequence[str] = ("random", "explore")) -> DataFrame:
    """The rows whose arm was drawn at random; none where the arm was not recorded."""
    return events.where(F.col(column).isin(*values)) if column in events.columns else events.limit(0)


def modal_account_only(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs (account_id, contact_point_ref) whose account is the one most events of the reference name,
    and pairs of references that no event names."""
    top = mode_of(events.where(F.col("contact_point_ref").isNotNull()), ["contact_point_ref"], "account_id").select("contact_point_ref", F.col("account_id").alias("tm_modal"))
    joined = pairs.join(top, "contact_point_ref", "left")
    return joined.where(F.col("tm_modal").isNull() | (F.col("tm_modal") == F.col("account_id"))).drop("tm_modal")


def avoiding_or_dead(scored: DataFrame, state: str, score: str, dead: Sequence[str] = ("recycled", "invalid", "switched_off_long"), at: float = 0.5) -> DataFrame:
    """Among silent lines, those that avoid calls against dead ones: n, AUC and the counts at ``at``."""
    own = scored.where(F.col(state).isin("avoiding", *dead)).select((F.col(state) == "avoiding").cast("int").alias("y"), F.col(score).alias("p"))
    hit, y = F.coalesce(F.col("p") >= at, F.lit(False)), F.col("y") == 1
    counts = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(hit & y).alias("tp"))
    auc = metrics.roc_auc(own)
    return counts.join(F.broadcast(auc), F.lit(True), "left")


# The loop ------------------------------------------------------------------------------------


def origin_frames(dials: DataFrame, origin: str, horizon_days: int, primary: DataFrame | None = None) -> DataFrame:
    """The features at an origin and ``y``: whether a dial within the horizon after it was answered; only
    points with such a dial. Features see what was received and happened by the origin, labels what
    happened after it."""
    t = F.lit(origin).cast("timestamp")
    end = t + F.expr(f"INTERVAL '{horizon_days}' DAY")
    ahead = dials.where((F.col("occurred_at") > t) & (F.col("occurred_at") <= end)).groupBy(*CP_KEYS).agg(F.max(F.coalesce(F.col("network_response") == "answered", F.lit(False)).cast("int")).alias("y"))
    feats = mini_features(dials.where(F.col("occurred_at") <= t), t, primary)
    return feats.join(ahead, list(CP_KEYS)).withColumn("origin", F.lit(origin))


def evaluate(dials: DataFrame, origins: Sequence[str], scorers: Sequence[str], scratch, horizon_days: int = 7, primary: DataFrame | None = None) -> DataFrame:
    """origin, scorer, n, positives, auc, average_precision, brier, log_loss.

    For each origin the scorers are fitted on the frames of the origins whose horizon has ended by then,
    and score the points dialled within the horizon. The origins are few and given; each has its own
    plan over the dials, which are written once. A scorer that must learn has no row at the first origin.
    """
    dials, _ = scratch.cut(dials)
    frames = {o: scratch.cut(origin_frames(dials, o, horizon_days, primary))[0] for o in origins}
    out = None
    for o in origins:
        t = F.lit(o).cast("timestamp")
        past = [f.where(F.col("origin").cast("timestamp") + F.expr(f"INTERVAL '{horizon_days}' DAY") <= t) for e, f in frames.items() if e < o]
        train = None
        for f in past:
            train = f if train is None else train.unionByName(f)
        for name in scorers:
            scorer = get_scorer(name)
            if not isinstance(scorer, RuleScorer):
                if train is None or train.isEmpty():
                    continue
                scorer.fit(train)
            scored = scorer.score(frames[o]).select("y", "p", F.lit(o).alias("origin"), F.lit(name).alias("scorer"))
            out = scored if out is None else out.unionByName(scored)
    by = ["origin", "scorer"]
    out, _ = scratch.cut(out)
    n = out.groupBy(*by).agg(F.sum("y").alias("positives"))
    return metrics.pointwise(out, by).drop("cost_weighted_loss").join(n, by).join(metrics.roc_auc(out, by), by).join(metrics.pr_auc(out, by), by)


# Intervals -----------------------------------------------------------------------------------


def poisson_weight(c: Column, rep: Column, seed: int) -> Column:
    """A Poisson(1) weight as a function of a row's hash, the repetition and the seed."""
    u = F.pmod(F.xxhash64(c, F.lit(seed), rep), F.lit(1_000_003)) / 1_000_003.0
    w = F.lit(0)
    for e in metrics.POISSON_EDGES:
        w = w + (u >= e).cast("int")
    return w


def bootstrap_metric(scored: DataFrame, metric: Callable[[DataFrame, Sequence[str]], DataFrame], column: str, reps: int = 200, seed: int = 13, level: float = 0.95) -> DataFrame:
    """The value and percentile interval of any metric of (y, p) that takes groups.

    ``scored``: id, y, p. Every repetition draws a Poisson(1) weight for each row; equal (rep, y, p) rows
    are counted with map-side combine before the metric sees them, as ``w`` rows each.
    """
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    drawn = scored.where(F.col("y").isNotNull() & F.col("p").isNotNull()).select("id", "y", "p", rep.alias("rep"))
    cells = drawn.withColumn("w", poisson_weight(F.col("id"), F.col("rep"), seed)).groupBy("rep", "y", "p").agg(F.sum("w").alias("w")).where(F.col("w") > 0)
    each = metric(cells, ["rep"]).select(F.col(column).cast("double").alias("m")).where(F.col("m").isNotNull())
    whole = metric(scored.withColumn("w", F.lit(1)), []).select(F.col(column).cast("double").alias("value"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return whole.crossJoin(F.broadcast(each.agg(F.percentile("m", F.lit(lo)).alias("low"), F.percentile("m", F.lit(hi)).alias("high"))))


def bootstrap_mean(scored: DataFrame, value: str, reps: int = 200, seed: int = 13, level: float = 0.95) -> DataFrame:
    """mean, low, high of a column: each Arrow batch adds its part of all repetitions in one product, so
    no row is repeated and a partition passes on ``reps`` rows."""

    def sums(batches):
        total, weight, n, plain = np.zeros(reps), np.zeros(reps), 0, 0.0
        for b in batches:
            h = b["h"].to_numpy(dtype=np.int64).astype(np.uint64)
            v = b["v"].to_numpy(dtype=float)
            for a in range(0, len(v), 4096):
                mix = h[a : a + 4096, None] + np.arange(reps, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                mix = (mix ^ (mix >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mix = (mix ^ (mix >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((mix ^ (mix >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
                w = np.searchsorted(metrics.POISSON_EDGES, u, side="right")
                total += v[a : a + 4096] @ w
                weight += w.sum(axis=0)
            n, plain = n + len(v), plain + float(v.sum())
        yield pd.DataFrame({"rep": np.arange(reps), "t": total, "w": weight, "n": n, "plain": plain})

    rows = scored.select(F.xxhash64("id", F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    parts = rows.mapInPandas(sums, "rep int, t double, w double, n long, plain double")
    each = parts.groupBy("rep").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"), (F.sum("plain") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return each.agg(F.max(F.when(F.col("rep") == 0, F.col("mean"))).alias("mean"), F.percentile("m", F.lit(lo)).alias("low"), F.percentile("m", F.lit(hi)).alias("high"))
