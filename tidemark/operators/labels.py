"""Outcome labels, splits and per-key modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import RPC_DISPOSITIONS

PAIR = ("account_id", "contact_point_ref")


def companion_pairs(events: DataFrame) -> DataFrame:
    """Dial and disposition rows of one (account, contact, time) as one attempt, without a self-join.

    ``is_rpc`` needs an answered dial and a sanctioned disposition; ``strict`` the disposition rpc.
    Rows with a null key or time form no attempt.
    """
    dial = F.col("event_type") == "dial_attempt"
    disp = F.col("event_type") == "disposition"
    ev = events.dropna(subset=[*PAIR, "occurred_at"]).where(dial | disp)
    answered = F.max(F.coalesce(dial & (F.col("network_response") == "answered"), F.lit(False)))
    good = F.max(F.coalesce(disp & F.col("disposition").isin(*RPC_DISPOSITIONS), F.lit(False)))
    strict = F.max(F.coalesce(disp & (F.col("disposition") == "rpc"), F.lit(False)))
    return ev.groupBy(*PAIR, "occurred_at").agg(F.max(dial).alias("has_dial"), answered.alias("answered"), (answered & good).alias("is_rpc"), (answered & strict).alias("is_strict"))


def rpc_labels(universe: DataFrame, pairs: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Per (account, contact) of the universe: dials in (after, upto] and whether one was right-party
    contact; null and censored where it was not dialled."""
    inside = pairs.where(F.col("has_dial") & (F.col("occurred_at") > after) & (F.col("occurred_at") <= upto))
    got = inside.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.max("is_rpc").alias("rpc"), F.max("is_strict").alias("strict"))
    return universe.select(*PAIR).dropna().distinct().join(got, list(PAIR), "left").select(
        *PAIR, F.coalesce("n", F.lit(0)).alias("n_dials"), "rpc", "strict", F.col("n").isNull().alias("censored")
    )


def ever_rpc(pairs: DataFrame, as_of: Column) -> DataFrame:
    return pairs.where(F.col("occurred_at") <= as_of).groupBy(*PAIR).agg(F.max("is_rpc").alias("ever_rpc"))


def weak_payment_labels(pairs: DataFrame, payments: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Right-party contacts whose account paid within ``days`` after, both up to ``as_of``.

    The range semi-join is bucketed by ``days``: a payment is shown to its own bucket and the one
    before.
    """
    width = days * 86_400_000_000
    slot = F.floor(F.unix_micros("occurred_at") / width)
    r = pairs.where(F.col("is_rpc") & (F.col("occurred_at") <= as_of)).withColumn("slot", slot).withColumn("us", F.unix_micros("occurred_at"))
    p = payments.where(F.col("occurred_at") <= as_of).select("account_id", F.unix_micros("occurred_at").alias("p_us"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    near = [r["account_id"] == p["account_id"], r["slot"] == p["slot"], p["p_us"] >= r["us"], p["p_us"] <= r["us"] + width]
    return r.join(p, near, "left_semi").select(*PAIR).distinct()


def paid_after(starts: DataFrame, payments: DataFrame, days: int) -> DataFrame:
    """account_id, start: whether the account paid in (start, start + days]; null and censored where
    the window passes the last payment known."""
    last = payments.agg(F.max("occurred_at").alias("last_payment"))
    width = days * 86_400_000_000
    slot = F.floor(F.unix_micros("start") / width)
    s = starts.select("account_id", "start").dropna().distinct().withColumn("slot", slot)
    p = payments.select("account_id", F.col("occurred_at").alias("paid_at"), F.explode(F.array(F.floor(F.unix_micros("occurred_at") / width), F.floor(F.unix_micros("occurred_at") / width) - 1)).alias("slot"))
    end = F.col("start") + F.expr(f"INTERVAL '{days}' DAY")
    hits = s.join(p, ["account_id", "slot"]).where((F.col("paid_at") > F.col("start")) & (F.col("paid_at") <= end)).select("account_id", "start").distinct().withColumn("paid", F.lit(True))
    out = s.drop("slot").join(hits, ["account_id", "start"], "left").crossJoin(F.broadcast(last))
    censored = F.coalesce(end > F.col("last_payment"), F.lit(True))
    return out.select("account_id", "start", F.when(~censored, F.coalesce("paid", F.lit(False))).alias("paid"), censored.alias("censored"))


def mode_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on ties; counted before it is ranked."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(top, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(value).alias(value)).select(*keys, value, "n")


def account_fold(account: Column, folds: int) -> Column:
    """The fold of an account: its SHA-256, read as an integer, modulo ``folds``.

    The 64 hexadecimal digits are folded in from the left, seven at a time, so every step fits a
    bigint: the remainder of a long number by Horner's rule.
    """
    if not 0 < folds < 2**31:
        raise ValueError("folds must lie between 1 and 2**31 - 1")
    digest = F.sha2(account, 256)
    rest = F.lit(0).cast("bigint")
    for i in range(0, 64, 7):
        n = min(7, 64 - i)
        part = F.conv(F.substring(digest, i + 1, n), 16, 10).cast("bigint")
        rest = F.pmod(rest * (16**n % folds) + F.pmod(part, F.lit(folds)), F.lit(folds))
    return rest


def rolling_origins(first: str, step_days: int, n: int, train_days: int, embargo_days: int, test_days: int) -> list[dict[str, str]]:
    """Training and test windows of ``n`` origins, as SQL interval expressions on ``first``."""
    out = []
    for i in range(n):
        at = f"TIMESTAMP '{first}' + INTERVAL '{i * step_days}' DAY"
        out.append(
            {
                "train_from": f"{at} - INTERVAL '{train_days}' DAY",
                "train_to": at,
                "test_from": f"{at} + INTERVAL '{embargo_days}' DAY",
                "test_to": f"{at} + INTERVAL '{embargo_days + test_days}' DAY",
            }
        )
    return out
