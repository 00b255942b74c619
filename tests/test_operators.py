"""Core operators against brute force and hand-made cases."""

import datetime as dt
import hashlib
import hmac
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import normalize as norm
from tidemark.functions.core import canonical_id, clean_response, instant, is_filler, pack_id, unpack_id
from tidemark.functions.text import months_switched_off
from tidemark.models import learned
from tidemark.operators import harness, labels, metrics, ranking, sharing, telephony
from tidemark.operators.deliver_once import deliver_once
from tidemark.operators.entity_vectors import sparse_cells, expand, merge_vectors, sparse_vectors, type_vocabulary
from tidemark.operators.late_events import LateState, classify, correct_late, current_watermarks, hot_keys, new_dirty_marks
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.skew import spread_join
from tidemark.session import Scratch
from tidemark.sources.pit import CP_KEYS

UTC = dt.timezone.utc
DAY0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
MSG = "event_id string, received_at string, ingested_at timestamp, payload string, n int"
U = "0aef1234-5678-49ab-8cde-0123456789ab"


def at(days=0.0, **kw):
    return DAY0 + dt.timedelta(days=days, **kw)


def test_canonical_id(spark):
    spelled = [U, U.upper(), U.replace("-", ""), "{" + U + "}", " " + U + "\t", "urn:uuid:" + U, "(" + U.upper() + ")"]
    rows = spark.createDataFrame([(x,) for x in spelled], "i string").select(canonical_id(F.col("i")).alias("o")).collect()
    assert {r.o for r in rows} == {U}
    other = spark.createDataFrame([("Call-7 ",), ("",), (None,), ("  ",)], "i string").select(canonical_id(F.col("i")).alias("o")).collect()
    assert [r.o for r in other] == ["call-7", None, None, None]


def test_packed_ids(spark):
    ids = [U, "call-7", "0123456789abcdef", "x", "ಕರೆ", None, "a" * 300]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k int, i string").select("k", "i", pack_id(F.col("i")).alias("p"))
    out = df.select("k", "i", "p", unpack_id(F.col("p")).alias("o")).collect()
    assert all(r.i == r.o for r in out) and len({bytes(r.p) for r in out}) == len(ids) and [len(r.p) for r in out if r.k == 0] == [16]


def test_small_functions(spark):
    df = spark.createDataFrame([("No Answer (408)",), ("NO_ANSWER/408",), ("noanswer",), (" ",), (None,)], "v string")
    assert [r[0] for r in df.select(clean_response(F.col("v"))).collect()] == ["noanswer"] * 3 + [None, None]
    df = spark.createDataFrame([("UNKNOWN",), ("0000000000000000",), ("",), (None,), ("BR00000000",), ("8d42",)], "v string")
    assert [r[0] for r in df.select(is_filler(F.col("v"))).collect()] == [True] * 4 + [False, False]
    df = spark.createDataFrame([("2026-01-01T05:30:00+05:30",), ("2026-01-01T00:00:00Z",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(F.unix_seconds(instant(F.col("v")))).collect()] == [1767225600, 1767225600, None, None]


def test_deliver_once_cases(spark):
    rows = [
        (U, "2026-01-02T00:00:00Z", at(1), "late", 1),
        (U.upper(), "2026-01-01T00:00:00+00:00", at(2), "first", 2),
        ("{" + U + "}", None, at(0), "unread", 3),
        ("solo", "2026-01-01T00:00:00Z", None, None, None),
        (None, None, None, None, 5),
        (None, None, None, None, 5),
        ("tie", "2026-01-01T00:00:00Z", at(3), "b", 6),
        ("tie", "2026-01-01T00:00:00Z", at(2), "a", 7),
    ]
    out = deliver_once(spark.createDataFrame(rows, MSG)).collect()
    got = sorted((r.event_id or "", r.n, r.n_copies) for r in out if r.event_id != "solo")
    assert got == [("", 5, 1), ("", 5, 1), (U, 2, 3), ("tie", 7, 2)]
    assert [r.n_copies for r in out if r.event_id == "solo"] == [1]


def test_deliver_once_stored_empty_and_clash(spark):
    stored = spark.createDataFrame([("a", "2026-01-01T00:00:00Z", at(0), "old", 1)], MSG)
    new = spark.createDataFrame([("A", "2025-12-31T00:00:00Z", at(1), "new", 2)], MSG)
    assert [(r.n, r.n_copies) for r in deliver_once(new, stored).collect()] == [(2, 2)]
    empty = spark.createDataFrame([], MSG)
    assert deliver_once(empty).count() == 0
    extra = new.withColumn("tm_n", F.lit(9)).withColumn("tm_key", F.lit("k")).withColumn("tm_best", F.lit(1))
    assert deliver_once(extra).select("tm_n", "tm_key").collect()[0] == (9, "k")
    with pytest.raises(ValueError):
        deliver_once(new.withColumn("n_copies", F.lit(1)))


def test_deliver_once_hot_identifier(spark):
    n = 3000
    rows = [("hot" if i % 3 == 0 else f"x{i}", f"2026-01-{1 + (i * 7) % 28:02d}T00:00:00Z", at(i), "p" * 50, i) for i in range(n)]
    out = {r.event_id: (r.n_copies, r.received_at) for r in deliver_once(spark.createDataFrame(rows, MSG)).collect()}
    assert len(out) == 2001 and out["hot"] == (1000, "2026-01-01T00:00:00Z")


EV = "contact_point_ref string, lender_id string, occurred_at timestamp, received_at timestamp, amount bigint"
MARK = "contact_point_ref string, lender_id string, watermark_ts timestamp, updated_at timestamp"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_late_events_brute_force(spark, seed):
    r = random.Random(seed)
    ev = []
    for _ in range(800):
        o = at(r.random() * 60)
        lag = r.choice([0.01, 0.5, 3, 6.9, 7.0, 7.1, 20, -0.2])
        ev.append((r.choice("abc" + "a" * 5), r.choice(["L1", "L2", None]), o, r.choice([o + dt.timedelta(days=lag)] * 9 + [None]), r.choice([None, 1000, 2500])))
    marks = [(k, "L1", at(r.random() * 60), at(u)) for k in "ab" for u in range(3)] + [("c", None, at(1), at(1)), ("c", "L2", None, at(3))]
    wm = current_watermarks(spark.createDataFrame(marks, MARK))
    out = correct_late(spark.createDataFrame(ev, EV), wm, Scratch(spark, "t"), snapshot_days=5)
    now = {k: max((m for m in marks if m[:2] == k), key=lambda m: m[3])[2] for k in {m[:2] for m in marks if m[1]}}
    day = defaultdict(lambda: [0, 0, 0, 0])
    for c, l, o, rec, a in ev:
        if l is None:
            continue
        w = now.get((c, l))
        late = w is not None and o < w and rec is not None and rec > w
        ok = not late or rec <= o + dt.timedelta(days=7)
        d = day[(c, l, o.date())]
        d[0] += ok
        d[1] += (a or 0) if ok else 0
        d[2] += late and ok
        d[3] += late and not ok
    got = {(x.contact_point_ref, x.lender_id, x.event_day): (x.n_events, x.amount, x.n_late, x.n_too_late, x.n_to_date, x.amount_to_date) for x in out["daily"].collect()}
    assert len(got) == len(day)
    run = defaultdict(lambda: [0, 0])
    for k in sorted(day):
        run[k[:2]][0] += day[k][0]
        run[k[:2]][1] += day[k][1]
        assert got[k] == (day[k][0], day[k][1], day[k][2], day[k][3], *run[k[:2]])
    dirty = {(c, l) for (c, l, _), v in day.items() if v[2]}
    assert {(x.contact_point_ref, x.lender_id) for x in out["dirty"].collect()} == dirty
    have = spark.createDataFrame([("a", "L1", "late_event"), ("b", "L1", "manual")], "contact_point_ref string, lender_id string, reason string")
    assert {(x.contact_point_ref, x.lender_id) for x in new_dirty_marks(out["dirty"], have).collect()} == dirty - {("a", "L1")}


def test_late_events_empty(spark):
    out = correct_late(spark.createDataFrame([], EV), current_watermarks(spark.createDataFrame([], MARK)), Scratch(spark, "t"))
    assert out["daily"].count() == 0 and out["dirty"].count() == 0


def _days(df):
    return sorted(tuple(r) for r in df.select("contact_point_ref", "lender_id", "event_day", "n_events", "amount", "n_to_date", "amount_to_date", "n_late", "n_too_late").collect())


def test_late_state_by_batches_equals_the_whole(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    ev = []
    for _ in range(500):
        o = at(r.random() * 50)
        ev.append((r.choice([f"c{i}" for i in range(20)]), "L1", o, o + dt.timedelta(days=r.choice([0.1, 2, 6, 9])), r.choice([None, 1000])))
    ev.sort(key=lambda e: e[3])
    wm = spark.createDataFrame([(f"c{i}", "L1", at(r.random() * 50)) for i in range(15)], "contact_point_ref string, lender_id string, watermark_ts timestamp")
    whole = correct_late(spark.createDataFrame(ev, EV), wm, Scratch(spark, "t"), snapshot_days=5)["daily"]
    state = LateState(spark, f"file://{tmp_path}/late", buckets=16, snapshot_days=5)
    state.apply(spark.createDataFrame(ev[:300], EV), wm, "b0")
    state.apply(spark.createDataFrame(ev[300:], EV), wm, "b1")
    assert state.apply(spark.createDataFrame(ev[300:], EV), wm, "b1") == []
    assert _days(state.daily()) == _days(whole)
    # One late event reads and rewrites the bucket of its key only.
    read = []
    real = state.table.read
    monkeypatch.setattr(state.table, "read", lambda buckets=None: read.append(buckets) or real(buckets))
    before = state.table._manifest()["folders"]
    late = [("c3", "L1", at(2), at(3), 500)]
    where = state.apply(spark.createDataFrame(late, EV), wm, "b2")
    assert len(where) == 1 and read == [where]
    assert sum(before[b] != f for b, f in state.table._manifest()["folders"].items()) == 1
    monkeypatch.undo()
    assert _days(state.daily()) == _days(correct_late(spark.createDataFrame(ev + late, EV), wm, Scratch(spark, "t"), snapshot_days=5)["daily"])


def test_hot_keys_without_the_engines_skew_join(spark, monkeypatch):
    """A key with a third of all rows, and a tenth of the rows without an identifier."""
    for m in ("late_events", "deliver_once"):
        monkeypatch.setattr(f"tidemark.operators.{m}.LEAST_HOT", 50)
        monkeypatch.setattr(f"tidemark.operators.{m}.PARTS", 8)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 3000
        rows = [(None if i % 10 == 1 else "hot" if i % 3 == 0 else f"x{i}", f"2026-01-{1 + (i * 7) % 28:02d}T00:00:00Z", at(i), "p" * 50, i) for i in range(n)]
        out = deliver_once(spark.createDataFrame(rows, MSG))
        got = defaultdict(list)
        for x in out.collect():
            got[x.event_id].append(x.n_copies)
        hot = sum(x[0] == "hot" for x in rows)
        assert got["hot"] == [hot] and len(got[None]) == sum(x[0] is None for x in rows) and set(got[None]) == {1}
        ev = [("hot" if i % 3 == 0 else f"c{i}", "L1", at(i % 40), at(i % 40 + (i % 5)), 1000) for i in range(n)]
        frame = spark.createDataFrame(ev, EV)
        assert [tuple(r) for r in hot_keys(frame).collect()] == [("hot", "L1")]
        wm = spark.createDataFrame([("hot", "L1", at(20)), ("c1", "L1", at(3))], "contact_point_ref string, lender_id string, watermark_ts timestamp")
        kinds = classify(frame, wm, 7)
        sizes = [r["count"] for r in kinds.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < 0.35 * n
        want = sum(c == "hot" and o < at(20) < r for c, _, o, r, _ in ev)
        assert kinds.where("contact_point_ref = 'hot' and kind = 1").count() == want > 0
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_join_with_one_hot_value(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.skew.LEAST_HOT", 50)
    monkeypatch.setattr("tidemark.operators.skew.PARTS", 8)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 40}", i) for i in range(3000)]
        table = [("hot", "H"), ("k1", "one"), ("k2", None), ("unused", "u")]
        df = spark.createDataFrame(rows, "k string, v int")
        out = spread_join(df, spark.createDataFrame(table, "k string, w string"), "k")
        known = dict(table)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(((k, v, known[k]) for k, v in rows if k in known), key=repr)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.6 * sum(sizes)
        assert spread_join(df.limit(0), spark.createDataFrame(table, "k string, w string"), "k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rolling_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), at(r.choice([0, 1, 2, 9, 40, 41, 90]) + r.random()), r.choice([None, 1.5, 2.25, 0.1])) for _ in range(200)] + [(None, at(1), 1.0), ("c", None, 1.0), ("d", at(5), None)]
    out = rolling_totals(spark.createDataFrame(rows, "contact_point_ref string, occurred_at timestamp, value double")).collect()
    by = defaultdict(list)
    for c, o, v in rows:
        if c and o:
            by[c].append(((o - DAY0).days, v))
    assert len(out) == sum(max(d for d, _ in x) - min(d for d, _ in x) + 1 for x in by.values())
    for x in out:
        d = (dt.date.fromisoformat(x.day) - DAY0.date()).days
        for w, n, total, avg in ((7, x.attempts_7d, x.total_7d, x.avg_7d), (30, x.attempts_30d, x.total_30d, x.avg_30d)):
            inside = [v for e, v in by[x.contact_point_ref] if d - w < e <= d]
            vals = [v for v in inside if v is not None]
            assert n == len(inside) and total == pytest.approx(sum(vals), abs=1e-9)
            assert avg is None if not vals else avg == pytest.approx(sum(vals) / len(vals))
    assert rolling_totals(spark.createDataFrame([], "contact_point_ref string, occurred_at timestamp, value double")).count() == 0


def test_entity_vectors(spark):
    kind = "contact_point_ref string, event_type string, occurred_at timestamp, amount bigint"
    a = spark.createDataFrame([("x", "call", at(1), 1000), ("x", "call", at(3), None), ("x", None, at(2), 5), (None, "call", at(1), 1)], kind)
    b = spark.createDataFrame([("x", "call", at(2), 500), ("y", "SMS sent", at(0), None)], kind)
    types = type_vocabulary(a.unionByName(b))
    assert types == ["SMS sent", "call", "untyped"]
    whole = expand(sparse_vectors(a.unionByName(b), types), types, F.lit(at(10)).cast("timestamp"))
    merged = expand(merge_vectors(sparse_vectors(a, types), sparse_vectors(b, types)), types, F.lit(at(10)).cast("timestamp"))
    key = lambda df: sorted(map(tuple, df.select("contact_point_ref", *sorted(set(df.columns) - {"contact_point_ref"})).collect()))
    assert key(whole) == key(merged)
    x = whole.where("contact_point_ref = 'x'").first()
    assert (x.call_n, x.call_days, x.call_total, x.sms_sent_n, x.sms_sent_days, x.sms_sent_total, x.untyped_n) == (3, 7, 1.5, 0, None, 0.0, 1)
    cells = {(r.entity, r.event_type): (r.n, r.total) for r in sparse_cells(a.unionByName(b)).collect()}
    assert cells == {("x", "call"): (3, 1500), ("x", "untyped"): (1, 5), ("y", "SMS sent"): (1, 0)}
    none = spark.createDataFrame([], kind)
    assert expand(sparse_vectors(none, types), types, F.lit(at(1)).cast("timestamp")).count() == 0 and type_vocabulary(none) == []


def test_hashing_matches_python(spark):
    df = spark.createDataFrame([("+91 98765-43210",), ("098765 43210",), ("9876543210",), ("12",), (" ",), (None,)], "v string")
    out = [r[0] for r in df.select(norm.normalize_phone(F.col("v"))).collect()]
    assert out[:4] == ["9876543210", "9876543210", "9876543210", "12"]
    ref = [r[0] for r in df.select(norm.hash_value(F.col("v"), "phone")).collect()]
    assert ref[0] == hashlib.sha256(b"9876543210").hexdigest()[:16] and ref[4:] == [None, None]
    keyed = [r[0] for r in df.select(norm.hash_value(F.col("v"), "phone", "pepper")).collect()]
    assert keyed[0] == hmac.new(b"pepper", b"9876543210", hashlib.sha256).hexdigest()[:16]
    u = [r[0] for r in df.select(norm.uuid5(F.concat(F.lit("src:"), "v"))).collect()]
    assert u[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "src:+91 98765-43210")) and u[5] is None


def test_account_fold_matches_python(spark):
    names = [f"AC{i:05d}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    for folds in (5, 7, 1000):
        got = [r[0] for r in df.select(labels.account_fold(F.col("a"), folds)).collect()]
        assert got == [int(hashlib.sha256(n.encode()).hexdigest(), 16) % folds for n in names]


def test_months_switched_off(spark):
    df = spark.createDataFrame([("number band hai 9 mahine se",), ("switched off, teen months ya 1 saal",), ("9 mahine",), ("phone off 0 months",), (None,)], "v string")
    assert [r[0] for r in df.select(months_switched_off(F.col("v"))).collect()] == [9, 12, None, None, None]


def dial_rows(r, n=400):
    out = []
    for i in range(n):
        o = at(r.choice(range(12)), hours=r.choice(range(24)))
        out.append((f"e{i:04d}", "dial_attempt", "L1", r.choice("BC"), r.choice("pqr"), o, o, r.choice(["answered", "busy", "busy", None]), None))
    return out


DIAL = "event_id string, event_type string, lender_id string, borrower_id string, contact_point_ref string, occurred_at timestamp, received_at timestamp, network_response string, ring_seconds double"


@pytest.mark.parametrize("seed", [1, 5])
def test_trailing_runs_brute_force(spark, seed):
    rows = dial_rows(random.Random(seed))
    got = {tuple(x[k] for k in CP_KEYS): x for x in telephony.dial_scalars(spark.createDataFrame(rows, DIAL), F.lit(at(20)).cast("timestamp")).collect()}
    by = defaultdict(list)
    for e in rows:
        by[e[2:5]].append(e)
    for k, es in by.items():
        es.sort(key=lambda e: (e[5], e[6], e[0]))
        vals = [e[7] or "missing" for e in es]
        run = next((i for i, v in enumerate(reversed(vals)) if v != vals[-1]), len(vals))
        fails = next((i for i, v in enumerate(reversed(vals)) if v == "answered"), len(vals))
        assert (got[k].last_response_type, got[k].consecutive_same_response, got[k].consecutive_failures) == (vals[-1], run, fails)


def test_asof_backward_brute_force(spark):
    r = random.Random(3)
    left = [(r.choice("ab"), i, at(r.randint(0, 40) / 4)) for i in range(80)]
    right = [(r.choice("ab"), f"r{i:02d}", at(r.randint(0, 40) / 4)) for i in range(40)]
    out = sharing.asof_backward(spark.createDataFrame(left, "k string, i int, t timestamp"), spark.createDataFrame(right, "k string, v string, t timestamp"), ["k"], "t", ["v"]).collect()
    assert len(out) == 80
    for x in out:
        k, _, t = left[x.i]
        best = max(((q, v) for kk, v, q in right if kk == k and q <= t), default=(None, None))
        assert x.prev_v == best[1]


def test_components(spark):
    links = [("L1", f"b{i}", f"c{i}") for i in range(6)] + [("L1", f"b{i + 1}", f"c{i}") for i in range(3)] + [("L2", "b0", "c5"), ("L2", "b9", "c5"), ("L1", None, "c0")]
    out = sharing.component_sizes(spark.createDataFrame(links, "lender_id string, borrower_id string, contact_point_ref string"), Scratch(spark, "t"))
    got = {(x.lender_id, x.borrower_id): (x.component, x.n_borrowers) for x in out.collect()}
    assert got[("L1", "b3")] == ("b0", 4) and got[("L1", "b5")] == ("b5", 1) and got[("L2", "b9")] == ("b0", 2)


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_a_long_chain_of_shared_contacts(spark):
    """More links than rounds: the labels leap."""
    n = 300
    rows = [("L", f"b{i:03d}", f"c{i}") for i in range(n)] + [("L", f"b{i:03d}", f"c{i + 1}") for i in range(n)]
    got = sharing.component_sizes(spark.createDataFrame(rows, "lender_id string, borrower_id string, contact_point_ref string"), Scratch(spark, "t"), most=25).collect()
    assert {(r.component, r.n_borrowers) for r in got} == {("b000", n)} and len(got) == n


def test_scratch_is_dropped_at_its_end(spark):
    import os

    with Scratch(spark, "t") as s:
        s.cut(spark.range(3))
        where = s.base.removeprefix("file://")
        assert os.path.isdir(where)
    assert not os.path.isdir(where)


def test_metrics_pinned(spark):
    s = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert metrics.roc_auc(s).first().auc == pytest.approx(0.75)
    assert metrics.pr_auc(s).first().average_precision == pytest.approx(0.8333333)
    assert metrics.pointwise(scored(spark, [(1, 0.5), (0, 0.5)])).first().brier == pytest.approx(0.25)
    assert metrics.roc_auc(scored(spark, [(1, 0.5)])).first().auc is None
    rel = {r.bin: r.n for r in metrics.reliability(scored(spark, [(0, 0.0), (1, 0.1), (1, 1.0), (0, 0.11)]), spark).collect()}
    assert rel[1] == 2 and rel[2] == 1 and rel[10] == 1 and len(rel) == 10


def test_auc_brute_force(spark):
    r = random.Random(8)
    rows = [(r.randint(0, 1), r.randint(0, 30) / 30) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(scored(spark, rows)).first().auc == pytest.approx(want)


def test_bootstrap(spark):
    s = spark.createDataFrame([(str(i), float(i % 7), i % 2, round(0.3 * (i % 2) + (i % 10) / 15, 3)) for i in range(500)], "id string, v double, y int, p double")
    x = harness.bootstrap_mean(s, "v", reps=60).first()
    assert x.low < x["mean"] < x.high and x.high - x.low < 1 and x["mean"] == pytest.approx(sum(i % 7 for i in range(500)) / 500)
    assert harness.bootstrap_mean(s.repartition(5), "v", reps=60).first() == pytest.approx(tuple(x))
    auc = harness.bootstrap_metric(s, metrics.roc_auc, "auc", reps=30).first()
    assert auc.low <= auc.value <= auc.high and auc.high - auc.low < 0.2
    assert auc.value == pytest.approx(metrics.roc_auc(s).first().auc)


def test_scorer_registry():
    assert {"incumbent", "trees", "answer_rate"} <= set(harness.scorer_names())
    with pytest.raises(KeyError):
        harness.get_scorer("nobody")
    with pytest.raises(ValueError):
        harness.register_scorer("trees", harness.TreeScorer)


def test_filters_of_labels(spark):
    lab = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "account_id string, censored boolean")
    assert [r[0] for r in harness.dialled_only(lab).collect()] == ["a"] and harness.dialled_only(lab.drop("censored")).count() == 0
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "account_id string, split string")
    assert [r[0] for r in harness.train_accounts_only(lab, splits).collect()] == ["a"]
    ev = spark.createDataFrame([("e", "random"), ("f", "rule")], "event_id string, dialling_arm string")
    assert [r[0] for r in harness.random_arm(ev).collect()] == ["e"] and harness.random_arm(ev.drop("dialling_arm")).count() == 0


def test_avoiding_against_dead(spark):
    rows = [("avoiding", 0.9), ("avoiding", 0.4), ("invalid", 0.2), ("recycled", 0.6), ("alive", 0.99), (None, 0.1)]
    x = harness.avoiding_or_dead(spark.createDataFrame(rows, "s string, a double"), "s", "a").first()
    assert (x.n, x.tn, x.fp, x.fn, x.tp, x.auc) == (4, 1, 1, 1, 1, 0.75)
    assert harness.avoiding_or_dead(spark.createDataFrame([], "s string, a double"), "s", "a").first().n == 0


def test_trace_history_and_outcome(spark):
    traces = [(f"a{i}", at(10 + i % 3), bool(i % 2), i % 5 == 4) for i in range(40)]
    hist = [(f"a{i}", "dial_attempt", "answered" if i % 2 else "busy", None, at(9 + d)) for i in range(40) for d in range(4)] + [("a1", "payment", None, 12.5, at(9)), ("a1", "payment", None, 1.0, at(30))]
    t = spark.createDataFrame(traces, "account_id string, start timestamp, paid boolean, censored boolean")
    h = spark.createDataFrame(hist, "account_id string, event_type string, network_response string, amount double, at timestamp")
    got = {r.account_id: r for r in learned.trace_history(t, h).collect()}
    for a, start, *_ in traces:
        assert got[a].n_dials == sum(x[0] == a and x[1] == "dial_attempt" and x[4] <= start for x in hist)
    assert (got["a1"].n_payments, got["a1"].paid_before, got["a1"].n_answered) == (1, 12.5, got["a1"].n_dials)
    out = learned.TraceOutcome().fit(learned.trace_history(t, h)).predict(learned.trace_history(t, h)).collect()
    assert all(0.01 <= r.p_recover_30d <= 0.99 for r in out) and min(r.p_recover_30d for r in out if r.account_id == "a1") > 0.5
    one = learned.TraceOutcome().fit(learned.trace_history(t.where("paid"), h)).predict(learned.trace_history(t, h)).first()
    assert one.p_recover_30d == 0.99


def test_beta_calibration(spark):
    rows = [(float(r < 0.8 * p), p, at(i)) for i in range(30) for p in (0.1, 0.3, 0.5, 0.7, 0.9) for r in (0.1, 0.3, 0.5, 0.7, 0.9)]
    df = spark.createDataFrame(rows, "y double, p double, t timestamp")
    cal = learned.BetaCalibrator().fit(df)
    out = sorted({(r.p, r.p_cal) for r in cal.transform(df).collect()})
    assert [c for _, c in out] == sorted(c for _, c in out) and out[-1][1] < 0.9
    with pytest.raises(ValueError):
        learned.BetaCalibrator().fit(df, time="t", after="2026-01-05")
    assert learned.BetaCalibrator().fit(df.where("y = 1")).transform(df).first().p_cal == 1.0


def test_greedy_budget(spark):
    rows = [("g", "a", 60.0, 9), ("g", "b", 50.0, 8), ("g", "c", 40.0, 7), ("g", "d", 500.0, 99), ("h", "e", 10.0, 1), ("g", "n", None, 50)]
    df = spark.createDataFrame(rows, "grp string, id string, cost double, v int")
    got = {(x.grp, x.id): x["rank"] for x in ranking.greedy_budget(df, "grp", [-F.col("v")], "cost", 100.0, "id").collect()}
    assert got == {("g", "a"): 1, ("g", "c"): 2, ("h", "e"): 1}


def test_greedy_budget_of_a_large_group(spark):
    """A group of 120,000 candidates, in the order of a fold over all of them; costs of cents, so that the budget's last part depends on the order of subtraction."""
    df = spark.range(120_003).select(
        F.when(F.col("id") >= 3, "big").when(F.col("id") > 0, "small").alias("grp"), F.concat(F.lit("k"), F.col("id")).alias("id"), (F.pmod(F.col("id") * 7919, F.lit(4001)) / 100).alias("cost"), F.pmod(F.col("id") * 31, F.lit(977)).alias("v")
    ).repartition(7)
    want = {}
    left, rank = defaultdict(lambda: 2500.0), defaultdict(int)
    for r in sorted(df.collect(), key=lambda r: (-r.v, r.id)):
        if r.cost <= left[r.grp]:
            left[r.grp] -= r.cost
            rank[r.grp] += 1
            want[r.grp, r.id] = (rank[r.grp], r.cost)
    out = ranking.greedy_budget(df, "grp", [-F.col("v")], "cost", 2500.0, "id")
    assert out.columns == ["grp", "id", "cost", "rank"] and [t for _, t in out.dtypes] == ["string", "string", "double", "int"]
    assert {(r.grp, r.id): (r["rank"], r.cost) for r in out.collect()} == want and rank["big"] > 100 and rank["small"] == 2 and rank[None] == 1


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("k", None), ("z", "q")], "k string, v string")
    assert {x.k: (x.v, x.n) for x in labels.mode_of(df, ["k"], "v").collect()} == {"k": ("a", 2), "z": ("q", 1)}


def test_conformal_radius(spark):
    df = spark.createDataFrame([("s", 0, i / 10) for i in range(1, 10)], "seg string, y int, p double")
    assert ranking.conformal_radius(df, 0.5, "seg").first().radius == pytest.approx(0.5)
    assert ranking.conformal_radius(df, 0.01, "seg").first().radius == pytest.approx(0.9)


def test_registry_schema_is_stable(spark):
    out = telephony.dial_windows(spark.createDataFrame([], DIAL), F.lit(at(1)).cast("timestamp"))
    assert out.count() == 0 and len(out.columns) == 3 + 18 * 5
    assert isinstance(out.schema["answer_rate_7d"].dataType, T.DoubleType)
