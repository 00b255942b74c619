"""Line-state tracking: a hidden Markov filter per line, pooled over a borrower's lines, and its EM fit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import is_filler
from tidemark.functions.fixed_values import DISPOSITIONS, NETWORK_RESPONSES

# Fixed values.
STATES = ("valid", "temp_unreachable", "switched_off_long", "recycled", "third_party", "invalid")
POSTERIOR = ("valid_reachable", "valid_avoiding", "temp_unreachable", "switched_off_long", "recycled", "third_party", "invalid")
INITIAL = (0.60, 0.10, 0.08, 0.05, 0.07, 0.10)
INITIAL_AVOID = 0.20
MOVE = (
    (0.92, 0.04, 0.02, 0.005, 0.005, 0.01),
    (0.30, 0.55, 0.10, 0.01, 0.02, 0.02),
    (0.10, 0.10, 0.65, 0.06, 0.02, 0.07),
    (0.00, 0.00, 0.00, 0.93, 0.00, 0.07),
    (0.05, 0.05, 0.02, 0.00, 0.80, 0.08),
    (0.00, 0.00, 0.00, 0.00, 0.00, 1.00),
)
MOVE_AVOID = ((0.97, 0.03), (0.05, 0.95))
# Answered, no_answer, busy, switched_off, not_reachable, does_not_exist, immediate_hangup; calm, then avoiding.
NETWORK = (
    ((0.40, 0.40, 0.06, 0.05, 0.05, 0.005, 0.035), (0.03, 0.55, 0.05, 0.15, 0.10, 0.005, 0.115)),
    ((0.12, 0.30, 0.10, 0.25, 0.18, 0.005, 0.045), (0.03, 0.40, 0.07, 0.25, 0.18, 0.005, 0.065)),
    ((0.02, 0.10, 0.03, 0.55, 0.20, 0.05, 0.05), (0.01, 0.10, 0.03, 0.56, 0.20, 0.05, 0.05)),
    ((0.06, 0.20, 0.05, 0.10, 0.14, 0.40, 0.05), (0.06, 0.20, 0.05, 0.10, 0.14, 0.40, 0.05)),
    ((0.45, 0.28, 0.06, 0.08, 0.08, 0.005, 0.045), (0.30, 0.35, 0.06, 0.10, 0.10, 0.005, 0.085)),
    ((0.005, 0.10, 0.02, 0.06, 0.12, 0.65, 0.045), (0.005, 0.10, 0.02, 0.06, 0.12, 0.65, 0.045)),
)
# Rpc, wrong_number, third_party, switched_off, not_reachable, promise_to_pay, dispute, callback; calm, then avoiding.
DISPOSED = (
    ((0.55, 0.02, 0.05, 0.05, 0.05, 0.12, 0.03, 0.13), (0.06, 0.03, 0.12, 0.25, 0.25, 0.03, 0.06, 0.20)),
    ((0.20, 0.03, 0.06, 0.20, 0.20, 0.06, 0.03, 0.22), (0.06, 0.03, 0.12, 0.25, 0.25, 0.03, 0.06, 0.20)),
    ((0.03, 0.04, 0.06, 0.40, 0.28, 0.02, 0.02, 0.15), (0.03, 0.04, 0.06, 0.40, 0.28, 0.02, 0.02, 0.15)),
    ((0.01, 0.55, 0.12, 0.05, 0.10, 0.005, 0.015, 0.15), (0.01, 0.55, 0.12, 0.05, 0.10, 0.005, 0.015, 0.15)),
    ((0.08, 0.05, 0.60, 0.04, 0.05, 0.02, 0.03, 0.13), (0.08, 0.05, 0.60, 0.04, 0.05, 0.02, 0.03, 0.13)),
    ((0.005, 0.45, 0.05, 0.05, 0.15, 0.005, 0.01, 0.28), (0.005, 0.45, 0.05, 0.05, 0.15, 0.005, 0.01, 0.28)),
)
# Fixed values.
SHIFT = {"does_not_exist": (0.55, 0.60), "wrong_number": (0.45, 0.45)}
RESET = 0.95
# Factors of the entry into avoidance by DPD bucket ("current" is the bucket X of zero days), and of the initial
# dead mass by the record's source.
ENTRY_BY_DPD = {"X": 0.5, "current": 0.5, "1-30": 0.8, "31-60": 1.0, "61-90": 1.3, "90+": 1.6}
DEAD_BY_SOURCE = {"kyc": 1.0, "later_update": 0.9, "bureau": 1.4, "borrower_on_call": 0.4, "skip_trace": 1.2}
ANSWER_ADDRESS = 0.1
BLOCK = 16  # equal observations taken at once
SCORE_GAP, FIT_GAP = 366, 60
KAPPA, STRONG, WEAK, ANSWER_CALM, TAU = 3.0, 1.0, 0.5, 0.35, 30.0

N = len(STATES)
LINE = ("lender_id", "borrower_id", "contact_point_ref")


@dataclass(frozen=True)
class Tracker:
    """Parameters of the joint chain of line state and avoidance; joint index a * 6 + s."""

    initial: np.ndarray = field(default_factory=lambda: np.array(INITIAL))
    avoid: float = INITIAL_AVOID
    move: np.ndarray = field(default_factory=lambda: np.array(MOVE))
    move_avoid: np.ndarray = field(default_factory=lambda: np.array(MOVE_AVOID))
    network: np.ndarray = field(default_factory=lambda: np.array(NETWORK))
    disposed: np.ndarray = field(default_factory=lambda: np.array(DISPOSED))

    def start(self, source: str | None = None) -> np.ndarray:
        """The initial distribution; recycled and invalid weigh by the record's source, unknown ones as KYC."""
        factor = DEAD_BY_SOURCE.get((source or "").strip().lower(), 1.0)
        states = self.initial * np.where(np.isin(np.arange(N), (3, 5)), factor, 1.0)
        states = states / states.sum()
        return np.concatenate([(1 - self.avoid) * states, self.avoid * states])

    def step(self, dpd: str | None = None) -> np.ndarray:
        """The daily transition; entry into avoidance weighs by the borrower's DPD bucket, unknown ones not."""
        avoid = self.move_avoid.copy()
        if dpd in ENTRY_BY_DPD:
            entry = min(0.99, avoid[0, 1] * ENTRY_BY_DPD[dpd])
            avoid[0] = 1 - entry, entry
        return np.kron(avoid, self.move)

    def emission(self, kind: str, value: int) -> np.ndarray:
        table = self.network if kind == "net" else self.disposed
        return np.concatenate([table[:, 0, value], table[:, 1, value]])


def observations(events: DataFrame, as_of: Column) -> DataFrame:
    """Counts per line, UTC day of receipt and observed value, with map-side combine.

    Dials, dispositions and payments up to ``as_of``; rows of filler borrowers or without a key are
    left out, so a borrower's group holds days times values, not events. A payment is a row of its
    borrower with an empty contact reference.
    """
    kind = F.when(F.col("event_type") == "dial_attempt", "net").when(F.col("event_type") == "disposition", "disp").when(F.col("event_type") == "payment", "pay")
    value = F.when(F.col("event_type") == "payment", "paid").otherwise(F.coalesce("network_response", "disposition"))
    known = (F.col("event_type") == "payment") | F.col("network_response").isin(*NETWORK_RESPONSES) | F.col("disposition").isin(*DISPOSITIONS)
    rows = events.where((F.col("received_at") <= as_of) & known & kind.isNotNull() & ~is_filler(F.col("borrower_id")) & F.col("lender_id").isNotNull())
    ref = F.when(F.col("event_type") == "payment", F.lit("")).otherwise(F.col("contact_point_ref"))
    day = F.datediff(F.to_date("received_at"), F.lit("1970-01-01").cast("date"))
    return rows.select("lender_id", "borrower_id", ref.alias("contact_point_ref"), day.alias("day"), kind.alias("kind"), value.alias("value")).where(F.col("contact_point_ref").isNotNull()).groupBy(*LINE, "day", "kind", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def tracked(events: DataFrame, contacts: DataFrame, borrowers: DataFrame, as_of: Column) -> DataFrame:
    """Observations with the ``type`` and ``source`` of their line and the ``dpd_bucket`` of their
    borrower; a known point without any comes as one row of kind ``none``.

    Known are the points of ``contacts`` and those of any visible event but payments, of borrowers
    that are no fillers. The source is that of the latest contact_point_update that names one, else
    the record's; the type the record's, else the latest update's. What is missing stays null.
    """
    point = ~is_filler(F.col("contact_point_ref")) & ~is_filler(F.col("borrower_id")) & F.col("lender_id").isNotNull()
    when = F.struct("received_at", "event_id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), when))
    said = events.where((F.col("received_at") <= as_of) & (F.col("event_type") != "payment") & point).groupBy(*LINE).agg(latest("update_source").alias("said_source"), latest("contact_type").alias("said_type"))
    made = F.struct("created_at", "value_hash", "source", "type")
    record = contacts.where(point).groupBy(*LINE).agg(F.max_by(F.struct("source", "type"), made).alias("r"))
    known = record.join(said, list(LINE), "full_outer").select(*LINE, F.coalesce("said_source", "r.source").alias("source"), F.lower(F.trim(F.coalesce("r.type", "said_type"))).alias("type"))
    rows = observations(events, as_of).join(known, list(LINE), "full_outer")
    dpd = borrowers.groupBy("lender_id", "borrower_id").agg(F.max("dpd_bucket").alias("dpd_bucket"))
    return rows.join(dpd, ["lender_id", "borrower_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("none")))


def _shift_dead(alpha: np.ndarray, amount: float, to_invalid: float) -> np.ndarray:
    """Moves a share of the live mass to recycled and invalid."""
    a = alpha.reshape(2, N).copy()
    live = a[:, [0, 1, 2, 4]].sum(axis=1) * amount
    a[:, [0, 1, 2, 4]] *= 1 - amount
    a[:, 5] += live * to_invalid
    a[:, 3] += live * (1 - to_invalid)
    return a.ravel()


def _reset_avoidance(alpha: np.ndarray, share: float = RESET) -> np.ndarray:
    """Moves a share of the avoiding mass to calm, by calm's own distribution of states."""
    a = alpha.reshape(2, N).copy()
    moved = share * a[1].sum()
    calm = a[0].sum()
    a[0] += moved * (a[0] / calm if calm > 0 else np.full(N, 1 / N))
    a[1] *= 1 - share
    return a.ravel()


def _observe(alpha: np.ndarray, p: Tracker, kind: str, value: str, n: int) -> np.ndarray:
    """``n`` equal observations; many go by the power of their linear map, until nothing changes."""
    emission = p.emission(kind, (NETWORK_RESPONSES if kind == "net" else DISPOSITIONS).index(value))

    def once(a: np.ndarray) -> np.ndarray:
        if value in SHIFT:
            a = _shift_dead(a, *SHIFT[value])
        if value in ("rpc", "promise_to_pay"):
            own = a.reshape(2, N)
            a = np.zeros((2, N))
            a[:, 0] = own.sum(axis=1)
            a = a.ravel()
        return a * emission

    left = n
    if n > BLOCK:
        each = np.array([once(row) for row in np.eye(2 * N)])
        block = np.linalg.matrix_power(each / each.max(), BLOCK)
        while left >= BLOCK:
            new = alpha @ block
            new = new / max(new.sum(), 1e-300)
            left -= BLOCK
            if np.array_equal(new, alpha):
                left %= BLOCK
            alpha = new
    for _ in range(left):
        alpha = once(alpha)
        alpha = alpha / max(alpha.sum(), 1e-300)
    return alpha


def _powers(step: np.ndarray, most: int) -> list[np.ndarray]:
    out = [np.eye(len(step))]
    for _ in range(most):
        out.append(out[-1] @ step)
    return out


def _by_dpd(p: Tracker, most: int) -> dict[str | None, list[np.ndarray]]:
    return {dpd: _powers(p.step(dpd), most) for dpd in (None, *ENTRY_BY_DPD)}


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def filter_line(days: dict[int, list[tuple[str, str, int]]], resets: set[int], upto: int, p: Tracker, powers: list[np.ndarray], source: str | None = None) -> tuple[np.ndarray, int | None]:
    """The state distribution of a line on day ``upto``, and its last day with information."""
    alpha, last = p.start(source), None
    for day in sorted({*days, *resets}):
        if last is not None:
            alpha = alpha @ powers[min(day - last, SCORE_GAP)]
        if day in resets:
            alpha = _reset_avoidance(alpha)
        for kind, value, n in sorted(days.get(day, ())):
            alpha = _observe(alpha, p, kind, value, n)
        last = day
    if last is not None:
        alpha = alpha @ powers[min(max(upto - last, 0), SCORE_GAP)]
    return alpha / alpha.sum(), last


def _seven(joint: np.ndarray) -> np.ndarray:
    post = np.array([joint[0, 0], joint[1, 0], *joint[:, 1:].sum(axis=0)])
    return post / post.sum()


def score_borrower(pdf: pd.DataFrame, upto: int, p: Tracker, powers: list[np.ndarray], by_dpd: dict[str | None, list[np.ndarray]] | None = None) -> pd.DataFrame:
    """Posterior of every point of one borrower: filtered, avoidance pooled, silence weighed.

    A point without observations gets the prior of its source, an address the plain prior and an
    answer probability of its own, both without confidence; the observations of an address still
    count in the pool. ``by_dpd``: powers by DPD bucket, in place of ``powers``.
    """
    keys = (pdf["lender_id"].iloc[0], pdf["borrower_id"].iloc[0])
    sources: dict[str, str | None] = {}
    addresses: set[str] = set()
    idle: list[str] = []
    if "source" in pdf:
        for ref, kind, source, of in zip(pdf["contact_point_ref"], pdf["kind"], pdf["source"], pdf["type"], strict=True):
            sources[ref] = _text(source)
            if of == "address":
                addresses.add(ref)
            elif kind == "none":
                idle.append(ref)
        if by_dpd:
            powers = by_dpd.get(next(filter(None, map(_text, pdf["dpd_bucket"])), None), by_dpd[None])
        pdf = pdf[pdf["kind"] != "none"]
    lines: dict[str, dict[int, list]] = {}
    resets: set[int] = set()
    answered: set[int] = set()
    for ref, day, kind, value, n in zip(pdf["contact_point_ref"], pdf["day"], pdf["kind"], pdf["value"], pdf["n"], strict=True):
        if kind == "pay" or value in ("rpc", "promise_to_pay"):
            resets.add(int(day))
        if kind != "pay":
            lines.setdefault(ref, {}).setdefault(int(day), []).append((kind, value, int(n)))
        if value == "answered":
            answered.add(int(day))
    out = []
    for ref in (*idle, *sorted(addresses)):
        post = _seven(p.start(None if ref in addresses else sources[ref]).reshape(2, N))
        out.append((*keys, ref, *post, post[0] * (ANSWER_ADDRESS if ref in addresses else ANSWER_CALM), post[4], 0.0))
    if not lines:
        return pd.DataFrame(out, columns=list(SCORE_COLUMNS))
    found = {ref: filter_line(days, resets, upto, p, powers, sources.get(ref)) for ref, days in lines.items()}
    prior = np.array([1 - p.avoid, p.avoid])
    logs = np.sum([np.log(np.maximum(a.reshape(2, N).sum(axis=1), 1e-12)) for a, _ in found.values()], axis=0) - (len(found) - 1) * np.log(prior)
    pooled = np.exp(logs - logs.max())
    pooled /= pooled.sum()
    for ref, (alpha, last) in found.items():
        if ref in addresses:
            continue
        a = alpha.reshape(2, N)
        own = a.sum(axis=1, keepdims=True)
        a = np.where(own > 0, a / np.maximum(own, 1e-300), 0) * pooled[:, None]
        weight = sum((STRONG if d in resets else WEAK) for d, obs in lines[ref].items() if (d in resets or d in answered) and any(k == "net" for k, _, _ in obs) and not any(v == "answered" for _, v, _ in obs))
        if weight:
            sigma = 1 - np.exp(-weight / KAPPA)
            gone = a[:, 0] * sigma
            pull = a[:, 1:] + 0.1 * p.initial[None, 1:] * a.sum(axis=1, keepdims=True)
            a[:, 0] -= gone
            a[:, 1:] += gone[:, None] * pull / np.maximum(pull.sum(axis=1, keepdims=True), 1e-300)
        post = _seven(a)
        entropy = -np.sum(post * np.log(np.maximum(post, 1e-300)))
        gap = max(upto - max([last, *[r for r in resets if r <= upto]]), 0)
        sure = (1 - entropy / np.log(len(post))) * np.exp(-gap / TAU)
        out.append((*keys, ref, *post, post[0] * ANSWER_CALM, post[4], sure))
    return pd.DataFrame(out, columns=list(SCORE_COLUMNS))


SCORE_COLUMNS = (*LINE, *POSTERIOR, "p_rpc", "recycled_risk", "confidence")
SCORE_SCHEMA = ", ".join([*(f"{c} string" for c in LINE), *(f"{c} double" for c in SCORE_COLUMNS[3:])])


def score(obs: DataFrame, upto: int, p: Tracker | None = None) -> DataFrame:
    """One row per point: seven-state posterior, answer probability, recycled risk and confidence.

    ``obs``: rows of ``tracked``, or of ``observations`` where neither sources nor DPD are known."""
    p = p or Tracker()
    by_dpd = _by_dpd(p, SCORE_GAP)
    shared = obs.sparkSession.sparkContext.broadcast((p, by_dpd[None], by_dpd))
    return obs.groupBy("lender_id", "borrower_id").applyInPandas(lambda pdf: score_borrower(pdf, upto, *shared.value), SCORE_SCHEMA)


def expected_counts(days: dict[int, list[tuple[str, str, int]]], p: Tracker, powers: list[np.ndarray], source: str | None = None) -> dict[str, np.ndarray]:
    """Expected transition, emission and initial counts of one line (forward-backward in logarithms,
    which no number of equal observations takes out of range)."""
    order = sorted(days)
    logs = lambda x: np.log(np.maximum(x, 1e-300))
    like = [sum((n * logs(p.emission(kind, (NETWORK_RESPONSES if kind == "net" else DISPOSITIONS).index(value))) for kind, value, n in days[d]), np.zeros(2 * N)) for d in order]
    with np.errstate(divide="ignore"):
        steps = [np.log(powers[min(b - a, FIT_GAP)]) for a, b in zip(order, order[1:], strict=False)]
    fw = [logs(p.start(source)) + like[0]]
    for s, e in zip(steps, like[1:], strict=True):
        fw.append(_log_sum(fw[-1][:, None] + s, 0) + e)
    bw = [np.zeros(2 * N)]
    for s, e in zip(reversed(steps), reversed(like[1:]), strict=True):
        bw.append(_log_sum(s + (e + bw[-1])[None, :], 1))
    bw.reverse()
    total = _log_sum(fw[-1], 0)
    gamma = [np.exp(f + b - total) for f, b in zip(fw, bw, strict=True)]
    net, disp, move = np.zeros((2 * N, 7)), np.zeros((2 * N, 8)), np.zeros((2 * N, 2 * N))
    for d, g in zip(order, gamma, strict=True):
        for kind, value, n in days[d]:
            (net if kind == "net" else disp)[:, (NETWORK_RESPONSES if kind == "net" else DISPOSITIONS).index(value)] += g * n
    for i, s in enumerate(steps):
        if order[i + 1] - order[i] == 1:
            move += np.exp(fw[i][:, None] + s + (like[i + 1] + bw[i + 1])[None, :] - total)
    return {"net": net, "disp": disp, "move": move, "start": gamma[0], "loglik": np.array([total])}


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp(x))) along ``axis``."""
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


SIZES = {"net": 2 * N * 7, "disp": 2 * N * 8, "move": 4 * N * N, "start": 2 * N, "loglik": 1}


def fit(obs: DataFrame, p: Tracker | None = None, rounds: int = 12, tol: float = 1e-4, fit_share: float = 1.0, seed: int = 7) -> tuple[Tracker, list[float]]:
    """EM over all lines: each round broadcasts the parameters, sums expected counts per partition and
    then over partitions, and re-estimates on the driver with Dirichlet priors. Only sums of a fixed
    size reach the driver. Addresses are left out, as in the reference. ``fit_share`` below 1 fits on a hash sample of borrowers, a documented
    bound; the default uses all."""
    p = p or Tracker()
    prior = p
    spark = obs.sparkSession
    data = obs.where(F.col("kind").isin("net", "disp"))
    if "source" in data.columns:
        data = data.where(F.coalesce("type", F.lit("phone")) == "phone")
    else:
        data = data.withColumns({c: F.lit(None).cast("string") for c in ("source", "dpd_bucket")})
    if fit_share < 1:
        data = data.where(F.pmod(F.xxhash64("borrower_id", F.lit(seed)), F.lit(10_000)) < int(fit_share * 10_000))
    lines = data.groupBy(*LINE).agg(F.collect_list(F.struct("day", "kind", "value", "n")).alias("obs"), F.first("source").alias("source"), F.first("dpd_bucket").alias("dpd")).select("obs", "source", "dpd").persist()
    width = sum(SIZES.values())
    history: list[float] = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((p, _by_dpd(p, FIT_GAP)))

        def part(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            p, powers = shared.value
            total = np.zeros(width)
            for b in batches:
                for rows, source, dpd in zip(b["obs"], b["source"], b["dpd"], strict=True):
                    days: dict[int, list] = {}
                    for r in rows:
                        days.setdefault(int(r["day"]), []).append((r["kind"], r["value"], int(r["n"])))
                    c = expected_counts(days, p, powers.get(_text(dpd), powers[None]), _text(source))
                    total += np.concatenate([c[k].ravel() for k in SIZES])
            yield pd.DataFrame({"i": np.arange(width), "v": total})

        sums = np.zeros(width)
        for r in lines.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[r["i"]] = r["v"]
        at, c = 0, {}
        for k, n in SIZES.items():
            c[k] = sums[at : at + n]
            at += n
        history.append(float(c["loglik"][0]))
        p = _estimate({k: c[k] for k in SIZES}, prior)
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tol * abs(history[-2]):
            break
    lines.unpersist()
    return p, history


def _estimate(c: dict[str, np.ndarray], prior: Tracker) -> Tracker:
    rows = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)
    net = c["net"].reshape(2, N, 7).transpose(1, 0, 2) + 10.0 * prior.network
    disp = c["disp"].reshape(2, N, 8).transpose(1, 0, 2) + 10.0 * prior.disposed
    joint = c["move"].reshape(2, N, 2, N)
    move = joint.sum(axis=(0, 2)) + 20.0 * prior.move
    avoid = joint.sum(axis=(1, 3)) + 150.0 * prior.move_avoid
    start = c["start"].reshape(2, N)
    init = start.sum(axis=0) + 5.0 * prior.initial
    share = (start[1].sum() + 40.0 * prior.avoid) / (start.sum() + 40.0)
    floor = lambda x: rows(np.maximum(rows(x), 1e-4))
    return replace(prior, network=floor(net), disposed=floor(disp), move=rows(move), move_avoid=rows(avoid), initial=init / init.sum(), avoid=float(share))


def to_json(p: Tracker) -> dict[str, Any]:
    return {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in p.__dict__.items()}


def from_json(d: dict[str, Any]) -> Tracker:
    return Tracker(**{k: (np.array(v) if isinstance(v, list) else v) for k, v in d.items()})
