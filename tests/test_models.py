"""Tracker, learned models, feature frame and evaluation views on small fixtures."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import hmm, learned
from tidemark.operators import evaluation
from tidemark.plans import features
from tidemark.session import Scratch
from tidemark.sources.pit import FrameSource


def obs(rows):
    return pd.DataFrame(rows, columns=["lender_id", "borrower_id", "contact_point_ref", "day", "kind", "value", "n"])


def scored(rows, upto=7, p=None):
    p = p or hmm.Tracker()
    out = hmm.score_borrower(obs(rows), upto, p, hmm._powers(p.step(), hmm.SCORE_GAP))
    return out.set_index("contact_point_ref")


def test_dead_line_and_answering_line():
    dead = scored([("L", "b", "x", d, "net", "does_not_exist", 1) for d in range(3)]).loc["x"]
    assert dead[["recycled", "invalid"]].sum() > 0.9 and dead["p_rpc"] < 0.02
    good = scored([("L", "b", "x", 6, "net", "answered", 1), ("L", "b", "x", 6, "disp", "rpc", 1)]).loc["x"]
    assert good["valid_reachable"] > 0.8
    for row in (dead, good):
        assert sum(row[c] for c in hmm.POSTERIOR) == pytest.approx(1.0)


def test_payment_lowers_avoidance_and_silence_counts():
    silent = [("L", "b", "x", d, "net", "no_answer", 1) for d in range(5)]
    paid = [*silent, ("L", "b", "", 5, "pay", "paid", 1)]
    assert scored(paid).loc["x", "valid_avoiding"] < scored(silent).loc["x", "valid_avoiding"]
    other = [*silent, *[("L", "b", "y", d, "net", "answered", 1) for d in range(5)]]
    alone = scored(silent).loc["x"]
    both = scored(other).loc["x"]
    assert both["valid_reachable"] + both["valid_avoiding"] < alone["valid_reachable"] + alone["valid_avoiding"]
    assert len(scored([("L", "b", "", 5, "pay", "paid", 1)])) == 0


def test_equal_observations_all_count():
    p = hmm.Tracker()
    powers = hmm._powers(p.step(), hmm.FIT_GAP)
    for kind, value in (("net", "no_answer"), ("net", "does_not_exist"), ("disp", "rpc"), ("disp", "wrong_number")):
        one = hmm._observe(p.start(), p, kind, value, 1)
        for _ in range(299):
            one = hmm._observe(one, p, kind, value, 1)
        assert np.allclose(hmm._observe(p.start(), p, kind, value, 300), one, rtol=1e-9, atol=1e-250)
    many = hmm.expected_counts({0: [("net", "no_answer", 3000)], 1: [("net", "answered", 2000)]}, p, powers)
    assert many["net"].sum() == pytest.approx(5000) and many["loglik"][0] < -3000 * np.log(1 / 0.55)
    e, f = p.emission("net", 1), p.emission("net", 0)
    some = hmm.expected_counts({0: [("net", "no_answer", 60)], 1: [("net", "answered", 70)]}, p, powers)
    assert some["loglik"][0] == pytest.approx(np.log((p.start() * e**60) @ p.step() @ f**70))


def test_tracker_reads_dpd_and_source_and_scores_every_point(spark):
    p = hmm.Tracker()
    assert p.start("bureau ")[[3, 5]].sum() > p.start("KYC")[[3, 5]].sum() > p.start("borrower_on_call")[[3, 5]].sum()
    assert p.start("skip_trace").sum() == pytest.approx(1) and np.allclose(p.start(None), p.start("KYC"))
    assert p.step("90+")[0, 6:].sum() == pytest.approx(0.048) and p.step("current")[0, 6:].sum() == pytest.approx(0.015) and np.allclose(p.step("90+").sum(axis=1), 1)
    columns = "event_id string, event_type string, lender_id string, borrower_id string, contact_point_ref string, received_at string, network_response string, disposition string, update_source string, contact_type string"
    dial = lambda i, b, ref: (i, "dial_attempt", "L", b, ref, "1970-01-03", "no_answer", None, None, None)
    moved = ("e4", "contact_point_update", "L", "low", "said", "1970-01-02", None, None, "bureau", "phone")
    ev = spark.createDataFrame([dial("e1", "low", "x"), dial("e2", "high", "x"), dial("e3", "low", "home"), moved], columns).withColumn("received_at", F.col("received_at").cast("timestamp"))
    contacts = spark.createDataFrame([("x", "low", "phone", "KYC"), ("x", "high", "phone", "KYC"), ("idle", "low", None, "skip_trace"), ("home", "low", "address", "bureau"), ("far", "alone", "address", None)], "contact_point_ref string, borrower_id string, type string, source string")
    contacts = contacts.withColumn("lender_id", F.lit("L")).withColumn("value_hash", F.lit("h")).withColumn("created_at", F.lit("1970-01-01").cast("timestamp"))
    borrowers = spark.createDataFrame([("L", "low", "1-30"), ("L", "high", "90+")], "lender_id string, borrower_id string, dpd_bucket string")
    got = {(r.borrower_id, r.contact_point_ref): r for r in hmm.score(hmm.tracked(ev, contacts, borrowers, F.lit("1970-02-10").cast("timestamp")), 40).collect()}
    assert set(got) == {("low", "x"), ("high", "x"), ("low", "idle"), ("low", "said"), ("low", "home"), ("alone", "far")}
    assert got["high", "x"].valid_avoiding > got["low", "x"].valid_avoiding
    assert got["low", "said"].recycled > got["low", "idle"].recycled > hmm.INITIAL[3] and got["low", "idle"].confidence == 0
    assert got["low", "home"].p_rpc == pytest.approx(0.1 * 0.8 * 0.6) and got["low", "home"].recycled == pytest.approx(hmm.INITIAL[3]) and got["alone", "far"].confidence == 0


def test_em_raises_likelihood_and_keeps_distributions(spark):
    r = np.random.default_rng(3)
    rows = [("L", f"b{i % 40}", f"c{i}", int(d), "net", r.choice(["answered", "no_answer", "busy"], p=[0.6, 0.3, 0.1]), 1) for i in range(80) for d in range(6)]
    p, history = hmm.fit(spark.createDataFrame(obs(rows)), rounds=4)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))
    assert np.allclose(p.network.sum(axis=2), 1) and np.allclose(p.move.sum(axis=1), 1) and p.network[0, 0, 0] > 0.4
    again = hmm.from_json(hmm.to_json(p))
    assert np.allclose(again.move, p.move) and again.avoid == p.avoid


def test_em_query_runs_the_operators_rounds(monkeypatch):
    from tidemark.plans import reference

    asked = []
    spark = SimpleNamespace(createDataFrame=lambda rows, schema: rows)
    monkeypatch.setattr(reference, "Scratch", lambda *_: SimpleNamespace(cut=lambda df: (df, "")))
    monkeypatch.setattr(reference, "_tracked", lambda *_: "rows")
    monkeypatch.setattr(reference.hmm, "fit", lambda obs, **more: (asked.append((obs, more)), (None, [-2.0, -1.0]))[1])
    assert reference.QUERIES["k5_hmm_em"](spark, "d") == [(0, -2.0), (1, -1.0)] and asked == [("rows", {})]


def test_gbm_query_fits_the_operators_trees(monkeypatch):
    from tidemark.plans import reference

    asked = []
    scored = SimpleNamespace(select=lambda *_: "rows")
    monkeypatch.setattr(reference, "_fitted", lambda *_: ("data", ["a"]))
    monkeypatch.setattr(reference, "rounded", lambda df, digits: df)
    monkeypatch.setattr(reference.learned, "fit_classifier", lambda *a, **more: asked.append((a, more)))
    monkeypatch.setattr(reference.learned, "predict", lambda *_: scored)
    assert reference.QUERIES["k7_gbm"](None, "d") == "rows" and asked == [(("data", "y", ["a"]), {})]


def test_calibrator_is_monotone_with_fallback(spark):
    r = np.random.default_rng(5)
    f = r.random(600)
    pdf = pd.DataFrame({"seg": np.where(np.arange(600) < 560, "big", "thin"), "p": f, "y": (r.random(600) < f**2).astype(int)})
    df = spark.createDataFrame(pdf)
    cal = learned.SegmentCalibrator().fit(df, "seg")
    assert set(cal.maps) == {None, "big"}
    out = cal.transform(df, "seg").orderBy("p").toPandas()
    big = out[out.seg == "big"]["p_cal"].to_numpy()
    assert (np.diff(big) >= -1e-12).all() and len(out) == 600 and out["p_cal"].between(0, 1).all()


def test_calibrator_query_computes_its_rows_once(spark, monkeypatch):
    """The rows are computed once for all maps, which are those of the single rows."""
    from tidemark.plans import reference

    r = np.random.default_rng(11)
    lender, p = r.choice(["A", "B", "C", "thin"], 900, p=[0.4, 0.3, 0.28, 0.02]), np.round(r.random(900), 2)
    pdf = pd.DataFrame({"lender_id": lender, "borrower_id": [f"b{i}" for i in range(900)], "contact_point_ref": "c", "y": (r.random(900) < p**2).astype(int), "p": p})
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(reference, "scored_rows", lambda *_: df.mapInPandas(counted, df.schema))
    got = {x.borrower_id: x.p_cal for x in reference.QUERIES["k10_calibrator"](spark, "d").collect()}
    assert made.value == 900

    def isotonic(part, at):
        blocks = []
        for x, g in part.groupby("p"):
            blocks.append([x, x, g.y.sum(), len(g)])
            while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
                _, hi, pos, n = blocks.pop()
                blocks[-1][1:] = [hi, blocks[-1][2] + pos, blocks[-1][3] + n]
        xs, ys = [e for b in blocks for e in b[:2]], [b[2] / b[3] for b in blocks for _ in range(2)]
        return np.interp(at, xs, ys)

    want = {}
    for name, part in pdf.groupby("lender_id"):
        want.update(zip(part.borrower_id, isotonic(pdf if name == "thin" else part, part.p), strict=True))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_classifier_refuses_one_class_and_hides_truth(spark):
    df = spark.createDataFrame([(1, 0.5, 1, "k"), (1, 0.7, 2, "k")], "y int, a double, true_state int, event_id string")
    assert learned.feature_names(df, "y") == ["a"]
    with pytest.raises(ValueError):
        learned.fit_classifier(df, "y", ["a"])


def test_grid_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2)) for i in range(40)], "y int, a double")
    point, loss = learned.choose_by_logloss(df, df, "y", ["a"], [{"maxIter": 2}, {"maxIter": 2}])
    assert point == {"maxIter": 2} and loss < 0.6


EVENTS = "event_id string, event_type string, lender_id string, borrower_id string, account_id string, contact_point_ref string, occurred_at string, received_at string, payload string"


def test_feature_frame_follows_its_registry(spark):
    ev = spark.createDataFrame(
        [
            ("e1", "dial_attempt", "L1", "b1", "a1", "r1", "2026-01-01T05:00:00Z", "2026-01-01T05:00:00Z", '{"network_response": "ANSWERED/200", "ring_seconds": 2.5}'),
            ("e2", "dial_attempt", "L1", "b1", "a1", "r1", "2026-01-02T05:00:00Z", "2026-01-20T05:00:00Z", '{"network_response": "busy", "ring_seconds": 9}'),
            ("e3", "dial_attempt", None, "b1", "a1", "r1", "2026-01-02T05:00:00Z", "2026-01-02T05:00:00Z", None),
        ],
        EVENTS,
    )
    contacts = spark.createDataFrame([("r1", "b1", "L1", "phone", "2025-01-01T00:00:00Z"), ("r2", "b1", "L1", None, "2025-01-01T00:00:00Z")], "contact_point_ref string, borrower_id string, lender_id string, type string, created_at string").withColumn("source", F.lit("KYC")).withColumn("is_primary", F.lit(True)).withColumn("value_hash", F.lit("h"))
    borrowers = spark.createDataFrame([("b1", "L1", "gold", 5.0)], "borrower_id string, lender_id string, product string, outstanding double")
    src = FrameSource(ev, contacts, borrowers)
    build = lambda at: {r.contact_point_ref: r for r in features.build_features(src, F.lit(at).cast("timestamp"), Scratch(spark, "t"), ("outstanding",)).collect()}
    early, late = build("2026-01-03"), build("2026-01-25")
    names = [f.name for f in features.registry()]
    assert list(early["r1"].asDict())[3:] == names and len(set(names)) == len(names)
    assert early["r1"].n_attempts_7d == 1 and early["r1"].n_answered_7d == 1 and late["r1"].n_attempts_30d == 2
    never = early["r2"]
    assert never.n_attempts_7d == 0 and never.answer_rate_7d is None and never.has_any_attempt is False and never.days_since_last_attempt is None
    assert early["r1"].product == "gold" and early["r1"].outstanding is None
    assert features.snapshot_id("2026-01-03", 1) != features.snapshot_id("2026-01-04", 1)


def test_evaluation_views(spark):
    dials = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("y", 1)], "contact_point_ref string, occurred_at int")
    dead = spark.createDataFrame([("x", 4), ("z", None)], "contact_point_ref string, action_at int")
    got = {r.contact_point_ref: (r.n_wasted, r.within_1, r.within_3) for r in evaluation.wasted_attempts(dials, dead).collect()}
    assert got == {"x": (2, False, True), "z": (0, False, False)}
    post = spark.createDataFrame([(0.5, 0.5), (-1.0, None), (0.0, 2.0)], "a double, b double")
    n = evaluation.normalised({"a": F.col("a"), "b": F.col("b")})
    assert [r[0] for r in post.select(evaluation.dominant_state(n)).collect()] == ["a", "a", "b"]
    age = spark.createDataFrame([(0.0,), (12.0,), (100.0,)], "h double")
    assert [r[0] for r in age.select(evaluation.stale_confidence(F.lit(0.8), F.col("h"), 24.0, 0.1)).collect()] == [0.8, 0.4, 0.08]
