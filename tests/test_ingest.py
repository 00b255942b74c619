"""Mapping, store and streaming intake."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mapping
from tidemark.plans.reference import API_SPEC
from tidemark.sources.pit import FrameSource, ParquetSource, StoreSource
from tidemark.sources.buckets import BucketTable
from tidemark.sources.dimensions import write_output, write_report
from tidemark.sources.readers import UnsupportedInput, load_input, split_corrupt
from tidemark.sources.store import EventStore
from tidemark.streaming.intake import fast_path, ingest_batch, start_intake, suppression_evidence, suppression_log

DIALER = {
    "source": "dialer",
    "contact_point": {"raw_field": "mobile", "kind": "phone"},
    "fields": {
        "event_id": {"field": "call_id", "uuid5": True},
        "event_type": {"const": "dial_attempt"},
        "lender_id": {"field": "lender"},
        "borrower_id": {"field": "cust"},
        "account_id": {"field": "loan"},
        "occurred_at": {"field": "start_ms", "format": "epoch_ms"},
        "received_at": {"field": "recv", "format": "%d-%m-%Y %H:%M:%S", "tz": "Asia/Kolkata"},
    },
    "payload": {
        "network_response": {"field": "code", "map": {"ANS": "answered", "BUSY": "busy"}},
        "ring_seconds": {"field": "ring", "type": "float"},
        "dialled": {"contact_ref": True},
        "channel": {"field": "chan", "map": {"VB": "voice_bot"}},
    },
}
COLS = "call_id string, lender string, cust string, loan string, mobile string, start_ms string, recv string, code string, ring string, chan string, true_state string"
GOOD = ("c1", "L1", "b1", "a1", "+91 98765 43210", "1767225600000", "01-01-2026 05:31:00", "ANS", "4.5", "VB", "x")


def change(**kw):
    names = [c.split()[0] for c in COLS.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_mapping_reasons(spark):
    rows = [GOOD, change(lender=" "), change(code="??"), change(code=None), change(start_ms="soon"), change(recv="01-01-2026 05:20:00"), change(mobile=None), change(ring="x", code="BUSY")]
    out = mapping.apply_mapping(spark.createDataFrame(rows, COLS), DIALER).collect()
    assert [r.reason for r in out] == [None, "missing_required_field", "unknown_enum", "missing_required_field", "bad_timestamp", "time_inversion", "missing_required_field", "missing_required_field"]
    p = json.loads(out[0].payload)
    assert p["network_response"] == "answered" and p["ring_seconds"] == 4.5 and p["dialled"] == out[0].contact_point_ref and list(p) == sorted(p)
    assert "true_state" not in out[0].asDict()


def test_wall_clock_that_a_zone_skips_or_repeats(spark):
    df = spark.createDataFrame([("2026-03-29 02:30:00",), ("2026-10-25 02:30:00",), ("2026-06-01 12:00:00",), (None,)], "t string")
    out = [r[0] for r in df.select(F.unix_seconds(mapping.parse_time(F.col("t"), "%Y-%m-%d %H:%M:%S", "Europe/Berlin"))).collect()]
    assert out == [None, None, 1780308000, None]


def test_nested_paths_and_bad_specs(spark):
    df = spark.createDataFrame([('{"a": {"b": "7"}}',)], "j string").withColumn("s", F.struct(F.lit("x").alias("y")))
    assert df.select(mapping.column_at(df, "j.a.b"), mapping.column_at(df, "s.y"), mapping.column_at(df, "s.no")).first() == ("7", "x", None)
    assert mapping.column_at(df, "gone.b") is None
    with pytest.raises(mapping.MappingError):
        mapping.as_spec(3)
    with pytest.raises(mapping.MappingError):
        mapping.java_pattern("%Q")


def test_dead_letters_hide_contacts(spark):
    bad = spark.createDataFrame([change(code="??"), change(code="??")], COLS)
    rows = mapping.dead_letters(mapping.apply_mapping(bad, DIALER, keep_raw=True), "dialer").collect()
    assert len(rows) == 1 and "98765" not in rows[0].raw_json and mapping.REDACTED in rows[0].raw_json


def canonical(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_type string, lender_id string, borrower_id string, account_id string, contact_point_ref string, occurred_at string, received_at string, payload string")


def event(i, received="2026-01-02T00:00:00Z", disposition="RPC", occurred="2026-01-01T00:00:00Z"):
    return (f"{i:032x}", "disposition", "L1", "b1", "a1", "ref1", occurred, received, json.dumps({"disposition": disposition}))


def test_store_is_idempotent_and_order_free(spark, tmp_path):
    one, two = EventStore(spark, f"file://{tmp_path}/one", 4), EventStore(spark, f"file://{tmp_path}/two", 4)
    early, late = canonical(spark, [event(1), event(2)]), canonical(spark, [event(1, "2026-01-03T00:00:00Z", "dispute"), event(3)])
    bad = canonical(spark, [("", *event(4)[1:])])
    assert ingest_batch(one, early.unionByName(bad), API_SPEC) == {"inserted": 2, "duplicates": 0, "dead_lettered": 1, "late_marked": 0}
    assert ingest_batch(one, late, API_SPEC)["duplicates"] == 1
    assert ingest_batch(one, early.unionByName(bad), API_SPEC) == {"inserted": 0, "duplicates": 2, "dead_lettered": 0, "late_marked": 0}
    ingest_batch(two, late, API_SPEC)
    ingest_batch(two, early.unionByName(bad), API_SPEC)
    rows = lambda s: sorted(map(tuple, s.read_events().collect()))
    assert rows(one) == rows(two) and one.counts()["events"] == 3
    assert "RPC" in rows(one)[0][-1]


def test_late_marks_once(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/s", 4)
    store.upsert_watermark(spark.sql("SELECT 'ref1' AS contact_point_ref, 'L1' AS lender_id, TIMESTAMP '2026-01-05' AS watermark_ts, TIMESTAMP '2026-01-05' AS updated_at"))
    assert ingest_batch(store, canonical(spark, [event(1, "2026-01-06T00:00:00Z")]), API_SPEC)["late_marked"] == 1
    assert ingest_batch(store, canonical(spark, [event(2, "2026-01-06T00:00:00Z")]), API_SPEC)["late_marked"] == 0
    assert store.read_events(received_before=F.lit("2026-01-01").cast("timestamp")).count() == 0
    ingest_batch(store, canonical(spark, [event(2, "2026-01-06T00:00:00Z")]), API_SPEC)
    assert store.vacuum("events") >= 1 and store.read_events(types=["disposition"], lender="L1", limit=1).count() == 1


def test_streaming_intake(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    raw = canonical(spark, [event(1), event(2), event(1)])
    (folder / "a.json").write_text("\n".join(raw.toJSON().collect()))
    store = EventStore(spark, f"file://{tmp_path}/store", 4)
    for _ in range(2):
        start_intake(spark, str(folder), raw.schema, store, API_SPEC, str(tmp_path / "ck")).awaitTermination(120)
    assert store.counts()["events"] == 2


def test_fast_path_and_suppression(spark):
    ev = spark.sql("SELECT * FROM VALUES ('e1','L1','r',TIMESTAMP '2026-01-01','wrong_number'),('e2','L1','r',TIMESTAMP '2026-01-02','dispute'),('e3','L1','q',TIMESTAMP '2026-01-03',NULL) t(event_id, lender_id, contact_point_ref, occurred_at, disposition)")
    hits = fast_path(ev, [("recycled", F.col("disposition") == "wrong_number"), ("dispute", F.col("disposition") == "dispute")])
    log = suppression_log(hits).collect()
    assert [(x.contact_point_ref, x.reason, x.evidence, x.version) for x in log] == [("r", "recycled", ["e1", "e2"], 1)]
    assert [(x.reason, x.n_evidence) for x in suppression_log(hits, whole=False).collect()] == [("recycled", 2)]
    assert sorted(x.event_id for x in suppression_evidence(hits).collect()) == ["e1", "e2"]


def test_one_bad_line_loses_no_other(spark, tmp_path):
    lines = [f'{{"x": {i}}}' for i in range(100)]
    (tmp_path / "a.json").write_text("\n".join([*lines[:50], "{oops", *lines[50:]]))
    good, bad = split_corrupt(load_input(spark, str(tmp_path / "a.json")))
    assert good.count() == 100 and [tuple(r) for r in bad.collect()] == [("{oops", "unreadable")]
    (tmp_path / "b.json").write_text('{"x": 1,\n"y": 2}')
    assert tuple(load_input(spark, str(tmp_path / "b.json")).select("x", "y").first()) == (1, 2)
    (tmp_path / "c.json").write_text("")
    assert load_input(spark, str(tmp_path / "c.json")).count() == 0


def test_reports_keep_all_rows(spark, tmp_path):
    write_report(f"file://{tmp_path}", "r", {"few": spark.range(3), "many": spark.range(25)}, most=10)
    out = json.loads((tmp_path / "r.json").read_text())
    assert len(out["few"]) == 3 and out["many"]["rows"] == 25 and spark.read.parquet(out["many"]["parquet"]).count() == 25
    write_output(spark.range(50).selectExpr("id % 7 AS b", "id AS a"), f"file://{tmp_path}/o", ["b", "a"])
    rows = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/o").collect()]
    assert sorted(rows) == sorted((i % 7, i) for i in range(50)) and spark.read.parquet(f"file://{tmp_path}/o").columns == ["b", "a"]


def test_bucket_table_rewrites_only_what_it_touches(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], 8)
    rows = spark.range(200).selectExpr("concat('k', id) AS k", "id AS v")
    assert t.read() is None
    t.append(rows)
    before = t._manifest()["folders"]
    one = rows.where("k = 'k7'")
    where = t.touched(one)
    assert len(where) == 1 and t.read(where).count() < 60
    t.rewrite(where, t.read(where).where("k != 'k7'"), "batch-1")
    after = t._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and t.read().count() == 199 and t.tags() == ["batch-1"]
    assert t.vacuum() == 1 and t.read().count() == 199
    t.append(one.withColumn("w", F.lit(1)))
    assert t.read().count() == 200 and t.read().where("w = 1").count() == 1
    assert BucketTable(spark, f"file://{tmp_path}/t", ["k"], 99).buckets == 8


def test_nameless_events_are_not_folded(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/n", 4)
    rows = spark.sql("SELECT * FROM VALUES (NULL, TIMESTAMP '2026-01-01', 'a'), (NULL, TIMESTAMP '2026-01-01', 'a'), ('x', TIMESTAMP '2026-01-02', 'b'), ('x', TIMESTAMP '2026-01-01', 'c') t(event_id, received_at, payload)")
    assert store.merge_events(rows) == {"inserted": 3, "duplicates": 0}
    assert store.merge_events(rows.where("event_id = 'x'")) == {"inserted": 0, "duplicates": 1}
    assert sorted((r.event_id or "", r.payload) for r in store.read("events").collect()) == [("", "a"), ("", "a"), ("x", "c")]


def test_totals_of_the_store_follow_its_batches(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/s", 4)
    a, b = canonical(spark, [event(1), event(2)]), canonical(spark, [event(1), event(3)])
    for _ in range(2):
        ingest_batch(store, a, API_SPEC, totals=True)
        ingest_batch(store, b, API_SPEC, totals=True)
    assert store.late_state().daily().agg(F.sum("n_events")).first()[0] == 3 == store.counts()["events"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n,b\n")
    assert [tuple(r) for r in load_input(spark, str(tmp_path / "a.csv")).collect()] == [("1", None), (None, "b")]
    (tmp_path / "b.ndjson").write_text('{"x": {"y": 1}}\n{"x": {"y": 2}}\n')
    assert load_input(spark, str(tmp_path / "b.ndjson")).select("x.y").count() == 2
    (tmp_path / "c.json").write_text('[\n{"x": 1},\n{"x": 2}\n]')
    assert load_input(spark, str(tmp_path / "c.json")).count() == 2
    assert load_input(spark, [{"x": 1}]).count() == 1
    with pytest.raises(UnsupportedInput):
        load_input(spark, "data.xlsx")


def test_sources_agree_and_hide_the_future(spark, tmp_path):
    raw = canonical(spark, [event(1), event(2, "2026-02-01T00:00:00Z")])
    contacts = spark.createDataFrame([("ref1", "b1", "L1", "2025-01-01T00:00:00Z", "x")], "contact_point_ref string, borrower_id string, lender_id string, created_at string, true_state string")
    borrowers = spark.createDataFrame([("b1", "L1")], "borrower_id string, lender_id string")
    frame = FrameSource(raw, contacts, borrowers)
    assert frame.dropped_contact_columns == ["true_state"]
    at = F.lit("2026-01-15").cast("timestamp")
    assert frame.visible(at).count() == 1 and StoreSource(raw).visible(at).count() == 1
    assert StoreSource(raw).contact_points(at).count() == 1
    with pytest.raises(FileNotFoundError):
        ParquetSource(spark, f"file://{tmp_path}")


def test_loaders(spark, tmp_path):
    from tidemark.sources.dimensions import fill_lender, load_dimension, load_history, run_ingest_plan, write_report

    dim = load_dimension(spark.createDataFrame([("a", "x1", "7.5"), ("b", "", "n/a")], "acc string, lender string, amt string"), {"acc": "account_id", "lender": "lender_id", "amt": "outstanding"}, {"outstanding": "double"}, {"product": "gold"})
    assert [(r.account_id, r.outstanding, r["product"]) for r in dim.collect()] == [("a", 7.5, "gold"), ("b", None, "gold")] and "loaded_at" in dim.columns
    kept, bad = load_history(spark.createDataFrame([("t1", "2026-01-02", "5"), ("t1", "2026-01-01", "x"), (" ", "2026-01-01", "1"), ("t2", "soon", "1")], "trace_id string, trace_date string, cost string"), ["trace_id", "trace_date"], "trace_id", "trace_date", ["cost"])
    assert [(r.trace_id, str(r.trace_date), r.cost) for r in kept.collect()] == [("t1", "2026-01-01", None)] and bad.count() == 2
    with pytest.raises(ValueError):
        load_history(kept, ["gone"], "trace_id", "trace_date")
    ev = spark.createDataFrame([("a", None), ("a", "L9"), ("z", None)], "account_id string, lender_id string")
    out, unmatched = fill_lender(ev, spark.createDataFrame([("a", "L1")], "account_id string, lender_id string"))
    assert sorted((r.account_id, r.lender_id or "") for r in out.collect()) == [("a", "L1"), ("a", "L9"), ("z", "")] and unmatched.first().n_unmatched == 1
    store = EventStore(spark, f"file://{tmp_path}/plan", 4)
    totals = run_ingest_plan(store, [("one", canonical(spark, [event(1)]), API_SPEC), ("two", None, API_SPEC), ("three", canonical(spark, [event(2)]), None), ("four", None, None)], only=("one", "two", "three"))
    assert totals["one"]["inserted"] == 1 and totals["two"] == {"missing": 1} and totals["three"] == {"dead_lettered": 1} and "four" not in totals
    assert "ref1" not in store.read("dead_letter").first().raw_json
    write_report(str(tmp_path), "r", {"t": spark.createDataFrame([(1, 2)], "a int, b int")})
    assert "| 1 | 2 |" in (tmp_path / "r.md").read_text() and json.loads((tmp_path / "r.json").read_text()) == {"t": [{"a": 1, "b": 2}]}


def test_streaming_windows(spark, tmp_path):
    from tidemark.streaming.intake import windowed_counts

    folder = tmp_path / "w"
    folder.mkdir()
    rows = [(f"2026-01-{d:02d}T05:00:00Z", "call") for d in (1, 1, 2, 20)]
    (folder / "a.json").write_text("\n".join(json.dumps({"occurred_at": a, "event_type": b}) for a, b in rows))
    stream = spark.readStream.schema("occurred_at timestamp, event_type string").json(str(folder))
    q = windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cw")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r.n for r in spark.sql("SELECT n FROM windows").collect())
    assert got == [1, 2]
