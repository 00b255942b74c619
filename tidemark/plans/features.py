"""The point-in-time feature frame: a registry of columns, and the one plan that fills them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import CUES, DISPOSITIONS, HOLIDAYS, SLOTS, VISIT_OUTCOMES, WINDOWS_DAYS
from tidemark.operators import sharing, telephony
from tidemark.session import Scratch
from tidemark.sources.pit import CP_KEYS, EventSource


@dataclass(frozen=True)
class Feature:
    """A column: its family, type, and whether it is 0 (a count) or null where nothing happened."""

    name: str
    family: str
    kind: str
    zero: bool = False


def registry() -> list[Feature]:
    out: list[Feature] = []
    count = lambda n, fam: out.append(Feature(n, fam, "bigint", True))
    rate = lambda n, fam: out.append(Feature(n, fam, "double"))
    number = lambda n, fam: out.append(Feature(n, fam, "int"))
    text = lambda n, fam: out.append(Feature(n, fam, "string"))
    for w in WINDOWS_DAYS:
        for n in ("n_attempts", "n_answered", *[f"n_{r}" for r in telephony.RESPONSES], *[f"n_attempts_{s}" for s in SLOTS]):
            count(f"{n}_{w}d", "telephony")
        for n in ("answer_rate", *[f"answer_rate_{s}" for s in SLOTS], "weekend_attempt_share", "ring_seconds_mean", "ring_seconds_std", "short_ring_rate"):
            rate(f"{n}_{w}d", "telephony")
    text("last_response_type", "telephony")
    for n in ("consecutive_failures", "consecutive_same_response"):
        out.append(Feature(n, "telephony", "bigint"))
    for n in ("days_since_first_attempt", "days_since_last_attempt", "days_since_last_answer"):
        number(n, "telephony")
    for n in ("mean_gap_between_attempts_days", "system_fail_rate_on_last_attempt_day"):
        rate(n, "telephony")
    for d in DISPOSITIONS:
        count(f"n_{d}_disposition", "disposition")
    rate("wrong_number_rate", "disposition")
    for c in CUES:
        count(f"n_{c}_cue", "text")
    out.append(Feature("max_switched_off_months", "text", "bigint"))
    text("last_disposition", "disposition")
    for n in ("days_since_last_disposition", "days_since_last_rpc"):
        number(n, "disposition")
    rate("agent_wrong_number_rate", "disposition")
    for n in ("n_borrowers", "n_contacts"):
        out.append(Feature(n, "shared", "bigint"))
    out += [Feature("is_shared", "shared", "boolean"), Feature("cp_rank", "shared", "int"), Feature("component_size", "shared", "bigint")]
    count("n_updates", "record")
    number("days_since_last_update", "record")
    text("last_source", "record")
    out.append(Feature("last_primary", "record", "boolean"))
    count("n_confirmed", "record")
    out += [Feature("source", "record", "string"), Feature("record_age_days", "record", "int"), Feature("is_primary", "record", "boolean")]
    out += [Feature("confirmed_by_payment", "record", "boolean"), Feature("days_since_confirmed", "record", "int")]
    for w in WINDOWS_DAYS:
        count(f"other_attempts_{w}d", "cross_line")
        count(f"other_answered_{w}d", "cross_line")
        rate(f"other_answer_rate_{w}d", "cross_line")
        count(f"n_payments_{w}d", "cross_line")
    for n in ("days_since_last_other_line_answer", "days_since_last_payment"):
        number(n, "cross_line")
    count("n_visits", "field")
    for o in VISIT_OUTCOMES:
        count(f"n_{o}", "field")
    for n in ("mean_dwell_seconds", "mean_visit_hour"):
        rate(n, "field")
    text("last_outcome", "field")
    number("days_since_last_visit", "field")
    for n in ("product", "dpd_bucket", "bureau_score_band", "income_type", "preferred_language", "town_id"):
        text(n, "account")
    rate("outstanding", "account")
    out += [Feature("contact_type", "core", "string"), Feature("has_any_attempt", "core", "boolean")]
    out += [Feature("as_of_weekday", "calendar", "int"), Feature("as_of_day", "calendar", "int"), Feature("as_of_holiday", "calendar", "boolean")]
    return out


def snapshot_id(as_of: str, watermark: object) -> str:
    """Names a snapshot by the registry, the moment and the data seen."""
    body = json.dumps([[asdict(f) for f in registry()], as_of, str(watermark)], sort_keys=True)
    return "fs_" + hashlib.sha256(body.encode()).hexdigest()[:16]


def build_features(source: EventSource, as_of: Column, scratch: Scratch, quarantined: tuple[str, ...] = ()) -> DataFrame:
    """One row per contact point known at ``as_of``, with the registry's columns.

    Each event family is one aggregation over the visible events, which are made once; the families
    are then joined on the same keys. ``quarantined`` account columns come out null.
    """
    ev, _ = scratch.cut(source.visible(as_of))
    contacts = source.contact_points(as_of)
    univ, _ = scratch.cut(sharing.universe(ev, contacts))
    sizes = sharing.component_sizes(univ, scratch).select("lender_id", "borrower_id", F.col("n_borrowers").alias("component_size"))
    disp = telephony.dispositions(ev, as_of)
    disp = disp.select(*CP_KEYS, *[F.col(c).alias(f"{c}_disposition") if c in {f"n_{d}" for d in DISPOSITIONS} else F.col(c) for c in disp.columns if c not in (*CP_KEYS, "agent_id")])
    # Of repeated rows of a contact the one made first counts, then the least source; a flag set in any holds.
    first_source = F.min_by("source", F.struct(F.col("created_at").isNull(), "created_at", "source"))
    kinds = contacts.dropna(subset=list(CP_KEYS)).groupBy(*CP_KEYS).agg(F.min(F.lower("type")).alias("contact_type"), first_source.alias("table_source"), F.bool_or("is_primary").alias("table_primary"))
    age = univ.select(*CP_KEYS, telephony.days_since(as_of, F.col("created_at")).alias("record_age_days"))
    accounts = source.borrowers()
    fields = [f.name for f in registry() if f.family == "account"]
    account = accounts.groupBy("lender_id", "borrower_id").agg(*[F.min(c).alias(c) for c in fields if c in accounts.columns and c not in quarantined])
    out = univ.select(*CP_KEYS)
    for part, on in (
        (telephony.dial_windows(ev, as_of), CP_KEYS),
        (telephony.dial_scalars(ev, as_of).withColumn("has_any_attempt", F.lit(True)), CP_KEYS),
        (disp, CP_KEYS),
        (sharing.shared_counts(univ), CP_KEYS),
        (sharing.record_history(ev, as_of), CP_KEYS),
        (sharing.payment_confirmations(ev), CP_KEYS),
        (sharing.other_lines(ev, as_of), CP_KEYS),
        (sharing.visits(ev, as_of), CP_KEYS),
        (kinds, CP_KEYS),
        (age, CP_KEYS),
        (sizes, CP_KEYS[:2]),
        (sharing.payments_window(ev, as_of), CP_KEYS[:2]),
        (account, CP_KEYS[:2]),
    ):
        out = out.join(part, list(on), "left")
    calendar = {
        "as_of_weekday": F.weekday(telephony.local(as_of)),
        "as_of_day": F.dayofmonth(telephony.local(as_of)),
        "as_of_holiday": F.date_format(telephony.local(as_of), "yyyy-MM-dd").isin(*HOLIDAYS),
    }
    # The latest update speaks for a record, else the table.
    calendar["source"] = F.coalesce("last_source", "table_source", F.lit("unknown"))
    calendar["is_primary"] = F.coalesce("last_primary", "table_primary", F.lit(False))
    calendar["confirmed_by_payment"] = F.coalesce(F.col("n_confirmed") > 0, F.lit(False))
    calendar["days_since_confirmed"] = telephony.days_since(as_of, F.timestamp_micros("last_confirmed_us"))
    cols = []
    for f in registry():
        c = calendar.get(f.name, F.col(f.name) if f.name in out.columns else F.lit(None)).try_cast(f.kind)
        if f.zero:
            c = F.coalesce(c, F.lit(0).cast(f.kind))
        cols.append((F.coalesce(c, F.lit(False)) if f.name == "has_any_attempt" else c).alias(f.name))
    return out.select(*CP_KEYS, *cols)
