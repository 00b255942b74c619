"""Runs, splits, pointers, truncation and leakage against brute force and fixtures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import leakage
from tidemark.llm.pointers import resolve_pointers
from tidemark.llm.runs import collapse_runs
from tidemark.llm.splits import assign_splits, component_groups, contract, grouped_splits, relation_edges
from tidemark.llm.truncation import flag_truncated, length_hazards, truncation_rates
from tidemark.session import Scratch

UTC = dt.timezone.utc
DAY0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
EV = "a string, c string, id string, occurred_at timestamp, value string"


def test_pointers(spark):
    n = 300
    rows = [(f"n{i:03d}", f"n{max(i - 1, 0):03d}") for i in range(n)] + [("x", "gone"), ("r", "r")]
    got = {r.id: r.root for r in resolve_pointers(spark.createDataFrame(rows, "id string, ptr string"), Scratch(spark, "t")).collect()}
    assert len(got) == n + 2 and {got[f"n{i:03d}"] for i in range(n)} == {"n000"} and got["x"] == "gone" and got["r"] == "r"


def test_pointer_cycles_are_refused(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.pointers.MAX_ROUNDS", 4)
    with pytest.raises(ValueError):
        resolve_pointers(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, ptr string"), Scratch(spark, "t"))


def brute_runs(rows):
    out, by = [], defaultdict(list)
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            by[r[:2]].append(r)
    for k, ev in by.items():
        ev.sort(key=lambda e: (e[3], e[2] or ""))
        run = []
        for e in [*ev, None]:
            if run and (e is None or e[4] is None or e[2] is None or e[4] != run[-1][4] or (e[3] - run[-1][3]).total_seconds() > 1800):
                if len(run) > 1:
                    out.append((*k, run[0][4], run[0][2], len(run), (run[-1][3] - run[0][3]).total_seconds()))
                run = []
            if e is not None and e[4] is not None and e[2] is not None:
                run.append(e)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_brute_force(spark, seed):
    r = random.Random(seed)
    t, rows = DAY0, []
    for i in range(900):
        t += dt.timedelta(seconds=r.choice([0, 60, 600, 1799, 1800, 1801, 7200]))
        rows.append((r.choice("AAAB"), r.choice("ppq"), f"e{r.randint(0, 10**6):07d}-{i}" if i % 50 else None, t, r.choice(["busy", "busy", "busy", "none", None])))
    rows += [(None, "p", "x", t, "busy"), ("A", "p", "y", None, "busy"), ("A", None, "z", t, "busy")]
    got = collapse_runs(spark.createDataFrame(rows, EV), ["a", "c"], Scratch(spark, "t")).select("a", "c", "value", "first_id", "n", "seconds").collect()
    assert sorted(map(tuple, got)) == brute_runs(rows)


def test_one_long_hot_run_and_empty(spark):
    rows = [("A", "p", f"e{i:05d}", DAY0 + dt.timedelta(minutes=i), "busy") for i in range(1500)]
    got = collapse_runs(spark.createDataFrame(rows, EV), ["a", "c"], Scratch(spark, "t")).collect()
    assert [(x.first_id, x.n) for x in got] == [("e00000", 1500)]
    assert collapse_runs(spark.createDataFrame([], EV), ["a", "c"], Scratch(spark, "t")).count() == 0


ROW = "event_id string, account_id string, contact_point_ref string, borrower_id string"
COLS = ("account_id", "contact_point_ref", "borrower_id")


def test_contraction_brute_force(spark):
    r = random.Random(6)
    bad = [None, "", "UNKNOWN", "0000"]
    rows = [(f"e{i}", r.choice([f"A{r.randint(0, 60)}"] * 6 + bad), r.choice([f"C{r.randint(0, 90)}"] * 4 + bad), r.choice([f"B{r.randint(0, 80)}"] * 3 + bad)) for i in range(120)]
    rows += [(f"h{i}", f"H{i}", "hot", None) for i in range(60)] + [("lone", None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    keys = {}
    for e, *vals in rows:
        own = [(i, v) for i, v in enumerate(vals) if v not in bad]
        keys[e] = own
        for v in own:
            find(v)
        for v in own[1:]:
            parent[find(own[0])] = find(v)
    groups = defaultdict(list)
    for v in parent:
        if v[0] == 0:
            groups[find(v)].append(v[1])
    want = {(a, min(g)) for g in groups.values() if len(g) > 1 for a in g}
    labels = contract(relation_edges(df, COLS), Scratch(spark, "t"))
    assert {(x.member, x.group_id) for x in component_groups(labels).collect()} == want
    split = {x.event_id: x.split for x in grouped_splits(df, COLS, "event_id", Scratch(spark, "t")).collect()}
    assert len(split) == len(rows)
    seen = defaultdict(set)
    for e, own in keys.items():
        for v in own:
            seen[find(v)].add(split[e])
    assert all(len(s) == 1 for s in seen.values())


def test_split_proportions(spark):
    r = random.Random(2)
    rows = [(f"c{i}", r.randint(1, 9)) for i in range(4000)] + [("giant", 3000)]
    out = assign_splits(spark.createDataFrame(rows, "component string, weight long")).groupBy("split").agg(F.sum("weight").alias("w")).collect()
    total = sum(x.w for x in out)
    share = {x.split: x.w / total for x in out}
    assert share["train"] == pytest.approx(0.8, abs=0.002) and share["validation"] == pytest.approx(0.1, abs=0.002)
    over = assign_splits(spark.createDataFrame([("g", 9000), *[(f"c{i}", 1) for i in range(1000)]], "component string, weight long")).groupBy("split").agg(F.sum("weight").alias("w")).collect()
    assert {x.split: x.w for x in over} == {"train": 9000, "validation": 500, "test": 500}


def test_splits_of_empty_tables(spark):
    df = spark.createDataFrame([], ROW)
    assert grouped_splits(df, COLS, "event_id", Scratch(spark, "t")).count() == 0
    assert component_groups(contract(relation_edges(df, COLS), Scratch(spark, "t"))).count() == 0


WORDS = "the agent called again today and spoke about payment with polite customer before lunch near market road while rain kept falling outside office window".split()


def sentences(r, n):
    return " ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(5, 9))).capitalize() + " done today." for _ in range(n))


def test_truncation_fixture(spark):
    r = random.Random(9)
    rows, cut = [], set()
    for i in range(1500):
        text = sentences(r, r.randint(1, 9))
        if i % 2 == 0 and len(text) > 160:
            text = text[:160]
            if text[-1] != ".":
                cut.add(i)
        rows.append((i, "a" if i % 2 == 0 else "b", text))
    rows += [(2001, "b", "The agent called again tod�"), (2002, "a", None), (2003, "a", ""), (2004, None, " \n\t"), (2005, "b", "The agent spoke about payment [contd"), (2006, "b", "The agent called again. Regards done today")]
    cut |= {2001, 2005}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    flags = flag_truncated(docs, Scratch(spark, "t"))
    got = {x.doc_id for x in flags.where("truncated").collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.02 * len(cut) + 1
    assert not got & {2002, 2003, 2004, 2006} and flags.count() == len(rows)
    assert {x.source: x.n_docs for x in truncation_rates(flags).collect()}["a"] == 752
    limits = length_hazards(docs.where("text is not null").select("source", F.length("text").alias("n_chars"))).where("significant").collect()
    assert ("a", 160) in {(x.source, x.n_chars) for x in limits}
    assert flag_truncated(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_endings_of_any_length(spark):
    whole = ["the borrower will pay on monday.", "the branch was closed today.", "he said he will come to the branch office tomorrow."] * 20
    long_word = "internationalisationwithoutend"
    rows = [(i, "a", t) for i, t in enumerate(whole)]
    rows += [(100, "a", "visit noted (customer said he will come to the branch office tomorrow")]
    rows += [(101, "a", "the borrower will p\ufffd" + " " * 40), (102, "a", "the branch was closed today (as said). he will pay."), (103, "b", "x" * 3000)]
    rows += [(200 + i, "a", f"we speak of {long_word} again.") for i in range(20)] + [(300, "a", f"we speak of {long_word[:27]}")]
    got = {x.doc_id: x.reason for x in flag_truncated(spark.createDataFrame(rows, "doc_id long, source string, text string"), Scratch(spark, "t")).collect()}
    assert got[100] == "unclosed bracket" and got[101] == "broken character" and got[102] is None
    assert got[300] in ("cut inside a sentence", "cut inside a word") and not any(got[i] for i in range(60))


def test_lengths_without_texts_count_as_neighbours(spark):
    """A limit of a sparse source: nothing but the cut texts lies near it."""
    rows = [("s", 400)] * 8 + [("s", n) for n in range(30, 330, 3)] + [("s", 900)]
    got = [tuple(r) for r in length_hazards(spark.createDataFrame(rows, "source string, n_chars int")).where("significant").select("source", "n_chars", "n").collect()]
    assert got == [("s", 400, 8)]
    one = length_hazards(spark.createDataFrame([("s", 5), ("s", 7), ("s", 7), ("s", 200)], "source string, n_chars int"), band=3).where("n_chars = 7").first()
    # At risk beside length 7, within 3: 4, 5, 6, 8, 9, 10 with 4, 4, 3, 1, 1, 1 texts; one of them has its length there.
    assert one.neighbour_hazard == pytest.approx((1 + 0.5) / (14 + 1.0))


def test_words_of_forms():
    assert leakage.words_of("“Naïve” bro-\nthers paid 42,801­ now…") == ["naïve", "brothers", "paid", "42801", "now"]
    assert leakage.words_of(None) == [] and leakage.words_of(" … ") == []


def test_bit_parallel_lcs():
    r = random.Random(1)
    for _ in range(50):
        a, b = [[r.randint(0, 5) for _ in range(r.randint(1, 30))] for _ in range(2)]
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = m[i, j] + 1 if a[i] == b[j] else max(m[i, j + 1], m[i + 1, j])
        assert leakage.common_words(np.array(a), leakage.places(np.array(b)), len(b)) == m[-1, -1]


def test_leaks_against_brute_force(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(900)]
    pick = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, pick(r.randint(60, 120))) for i in range(30)] + [(100, pick(8)), (101, [])]
    docs, want = [], set()
    for d in range(400):
        body = pick(r.randint(0, 150))
        if d % 5 == 0:
            i = r.randint(0, 29)
            n = r.choice([10, 12, 26, 34, 50])
            at = r.randint(0, len(items[i][1]) - n)
            piece = list(items[i][1][at : at + n])
            if d % 2:
                for k in range(5, n - 4, 11):
                    piece[k] = "changed"
            if n > 12:
                want.add((d, i))
            body[len(body) // 2 : len(body) // 2] = piece
        docs.append((d, " ".join(body).upper() if d % 3 == 0 else ",\n".join(body)))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1]) + " " + "x " * 20000)]
    want.add((902, 3))
    found = leakage.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), Scratch(spark, "t")
    )
    got = {(x.doc_id, x.item_id): x.n_words for x in found.collect()}
    assert set(got) == want and min(got.values()) >= 20
    assert leakage.find_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), Scratch(spark, "t")).count() == 0


def test_short_leak_across_windows_is_a_candidate():
    item = np.arange(1, 61)
    leak = item[5:25].copy()
    leak[[7, 13]] = [200, 201]
    doc = np.concatenate([np.arange(70, 80), leak, np.arange(80, 110)])
    index = leakage.Index(np.eye(256, dtype=np.float32), [(4, item)], leakage.Settings(buckets=256))
    assert [x[:2] for x in index.search([doc])] == [(0, 4)]


def test_changed_words_at_the_ends_of_a_leak():
    item, s = np.arange(1, 61), leakage.Settings()
    host = lambda piece: np.concatenate([np.arange(100, 140), piece, np.arange(140, 180)])
    for n in (20, 21):
        for changed in ([0], [1], [n - 1], [n - 2], [0, n - 1], [1, n - 2], [1, 3], [n - 4, n - 2]):
            piece = item[10 : 10 + n].copy()
            piece[changed] = 900 + np.arange(len(changed))
            same, a, b = leakage.leaks(host(piece), item, s)
            assert b - a >= 20 and same >= 18
        assert leakage.leaks(host(np.delete(item[10 : 10 + n], 1)), item, s) and leakage.leaks(host(np.insert(item[10 : 10 + n], n - 1, 900)), item, s)
    for n in (8, 12, 17):
        assert leakage.leaks(host(item[10 : 10 + n]), item, s) is None


def test_a_leak_beside_a_better_alignment():
    """24 words of which four are changed, after 17 words of the same item to the letter."""
    item, s = np.arange(1, 121), leakage.Settings()
    piece = item[60:84].copy()
    piece[[5, 10, 15, 20]] = [900, 901, 902, 903]
    doc = np.concatenate([np.arange(500, 520), item[20:37], np.arange(520, 530), piece, np.arange(530, 550)])
    same, a, b = leakage.leaks(doc, item, s)
    assert (a, b) == (60, 84) and same == 20
    assert leakage.leaks(np.concatenate([item[20:37], np.arange(520, 530), item[60:75]]), item, s) is None


def test_the_answer_decides_a_paraphrase():
    item, answer, s = np.arange(1, 61), np.arange(200, 206), leakage.Settings()
    piece = item[10:50].copy()
    piece[3::5] = 900 + np.arange(8)
    told, untold = np.concatenate([piece, answer]), np.concatenate([piece, np.arange(300, 306)])
    assert leakage.leaks(told, item, s, answer) and leakage.leaks(untold, item, s, answer) is None


def test_batched_alignment_equals_a_plain_table():
    r = random.Random(8)
    docs, items = [], []
    for _ in range(60):
        docs.append(np.array([r.randint(0, 6) for _ in range(r.randint(1, 40))]))
        items.append(np.array([r.randint(0, 6) for _ in range(r.randint(1, 30))]))
    for d, i, got in zip(docs, items, leakage.best_ends(docs, items), strict=True):
        m = np.zeros((len(d) + 1, len(i) + 1), int)
        for x in range(len(d)):
            for y in range(len(i)):
                m[x + 1, y + 1] = max(0, m[x, y] + (1 if d[x] == i[y] else -1), m[x, y + 1] - 1, m[x + 1, y] - 1)
        assert got[0] == m.max() and m[got[1], got[2]] == m.max()


def test_lists_of_the_index_lose_no_candidate():
    """Against the comparison with all windows: the words of a made corpus with 300 spliced leaks."""
    r = np.random.default_rng(4)
    s = leakage.Settings(buckets=512)
    table = r.standard_normal((512, 64)).astype(np.float32)
    items = [(i, r.integers(1, 10**9, r.integers(60, 140))) for i in range(120)]
    docs, want = [], set()
    for d in range(300):
        i = int(r.integers(0, 120))
        at = int(r.integers(0, len(items[i][1]) - 26))
        piece = items[i][1][at : at + 26].copy()
        piece[[7, 17]] = r.integers(1, 10**9, 2)
        docs.append(np.concatenate([r.integers(1, 10**9, 60), piece, r.integers(1, 10**9, 60)]))
        want.add((d, i))
    index = leakage.Index(table, items, s)
    whole = leakage.Index(table, items, leakage.Settings(buckets=512, probes=10**6, floor=-9.0))
    ask = lambda x: {(t, i) for t, i, *_ in x.search(docs)} & want
    assert len(ask(whole)) >= 0.97 * len(want) and len(ask(index)) >= 0.99 * len(ask(whole))


def test_word_counter_is_stable():
    assert Counter(leakage.hashes_of("a b a").tolist()) == Counter(leakage.hashes_of("B A\na").tolist())


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("e", "A", "c", "b", 1), ("f", "A", None, None, 2)], ROW + ", root int")
    out = grouped_splits(df, COLS, "event_id", Scratch(spark, "t"))
    assert out.columns == [*df.columns, "component", "split"] and sorted(r.root for r in out.collect()) == [1, 2]
    with pytest.raises(ValueError):
        grouped_splits(df.withColumn("Split", F.lit(1)), COLS, "event_id", Scratch(spark, "t"))
    rows = [("A", "p", f"e{i}", DAY0 + dt.timedelta(minutes=i), "busy", "x") for i in range(3)] * 1
    ev = spark.createDataFrame(rows, EV + ", ptr string").withColumn("slot", F.lit(1)).withColumn("root", F.lit("z")).withColumn("n", F.lit(9))
    assert [(x.first_id, x.n) for x in collapse_runs(ev, ["a", "c"], Scratch(spark, "t")).collect()] == [("e0", 3)]
    docs = spark.createDataFrame([(None, "a", "text cut he"), (1, "a", "whole text.")], "doc_id long, source string, text string").withColumn("reason", F.lit("x")).withColumn("words", F.lit("y"))
    assert {(x.doc_id, x.truncated) for x in flag_truncated(docs, Scratch(spark, "t")).collect()} == {(None, False), (1, False)}


def test_equal_items_and_repeated_documents(spark):
    words = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (1, words), (None, words), (2, "other " * 30)], "doc_id long, text string").withColumn("id", F.lit("x"))
    items = spark.createDataFrame([(7, words), (8, words), (None, words), (9, None)], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in leakage.find_leaks(docs, items, Scratch(spark, "t")).collect())
    assert got == [(1, 7), (1, 7), (1, 8), (1, 8)]
