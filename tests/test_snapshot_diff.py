import random

from lintlake.operators.snapshot_diff import SnapshotStore, diff_runs, scan_diff

RUN = "scan_run_id string, target string, started_at timestamp, delivered_at timestamp, auth_only_js_urls array<string>"
EP = "scan_run_id string, value string, pattern_name string, source_url string, tag string, environment string"
SEC = "scan_run_id string, secret_type string, severity string, redacted_value string, partial_hash string, source_url string"


def _brute(runs, eps, secs):
    by, info = {}, {}
    for i, t, s, _, a in runs:
        info[i] = (t, s, set(a or []))
    for i, (t, s, _) in info.items():
        by.setdefault(t, []).append((s, i))
    out = set()
    for line in by.values():
        line.sort()
        for (_, a), (_, b) in zip(line, line[1:]):
            ea, eb = {e[1:] for e in eps if e[0] == a}, {e[1:] for e in eps if e[0] == b}
            va, vb = {e[0] for e in ea}, {e[0] for e in eb}
            sa, sb = {f"{x[1] or ''}:{x[4] or ''}" for x in secs if x[0] == a}, {f"{x[1] or ''}:{x[4] or ''}" for x in secs if x[0] == b}
            out |= {(b, "new_endpoints", v) for v in vb - va} | {(b, "removed_endpoints", v) for v in va - vb}
            out |= {(b, "new_secrets", v) for v in sb - sa} | {(b, "removed_secrets", v) for v in sa - sb}
            state = lambda e, k: {x[3:] for x in e if x[:3] == k}
            out |= {(b, "changed_endpoints", k[0]) for k in {x[:3] for x in ea} & {x[:3] for x in eb} if state(ea, k) != state(eb, k)}
            gated, open_ = {e[0] for e in ea if e[2] in info[a][2]}, {e[0] for e in eb if e[2] not in info[b][2]}
            out |= {(b, "access_control_regressions", v) for v in gated & open_}
    return out


def test_random_snapshots_against_brute_force(spark):
    from datetime import datetime, timedelta

    r = random.Random(3)
    runs, eps, secs = [], [], []
    for k in range(9):
        t = f"t{k % 2}"
        start = datetime(2025, 1, 1) + timedelta(hours=r.randint(0, 5000))
        runs.append((f"r{k}", t, start, start, r.choice([None, [], ["u0", "u1"], ["u2"]])))
        for _ in range(r.randint(0, 40)):
            eps.append((f"r{k}", r.choice(["/a", "/b", "/c", None, ""]), r.choice(["p", None]), f"u{r.randint(0, 3)}", r.choice(["live", None]), r.choice(["dev", None])))
        for _ in range(r.randint(0, 6)):
            secs.append((f"r{k}", r.choice(["x", None]), "high", "**", r.choice(["h1", "h2", None]), "u"))
    # one state per record and run, as snapshots have; everything is delivered twice
    eps = list({e[:4]: e for e in eps}.values())
    got = scan_diff(spark.createDataFrame(eps * 2, EP), spark.createDataFrame(secs * 2, SEC), spark.createDataFrame(runs + runs[:3], RUN)).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == _brute(runs, eps, secs)


def test_empty_and_single_runs(spark):
    runs, none_e, none_s = spark.createDataFrame([], RUN), spark.createDataFrame([], EP), spark.createDataFrame([], SEC)
    assert scan_diff(none_e, none_s, runs).count() == 0
    from datetime import datetime

    one = spark.createDataFrame([("r", "t", datetime(2025, 1, 1), None, None)], RUN)
    rows = spark.createDataFrame([("r", "/a", "p", "u", None, None), ("unknown", "/b", "p", "u", None, None)], EP)
    assert scan_diff(rows, none_s, one).count() == 0


def test_extra_columns_with_clashing_names(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    runs = spark.createDataFrame([("a", "t", datetime(2025, 1, 1), None, []), ("b", "t", datetime(2025, 1, 2), None, [])], RUN).withColumn("seq", F.lit(9)).withColumn("v1", F.lit("x"))
    rows = spark.createDataFrame([("a", "/x", "p", "u", "t", "e")], EP).withColumn("seq", F.lit("z")).withColumn("target", F.lit("other")).withColumn("item", F.lit(1))
    got = diff_runs(rows, runs, F.col("value"), ["pattern_name", "source_url"], ["tag"], {"removed": "gone"}).collect()
    assert [tuple(x) for x in got] == [("b", "gone", "/x")]


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), ["k"], ["v", "w"], buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v string, w int")
    first = store.apply(make([("a", "1", 1), ("b", None, 2), (None, "n", 3)]))
    assert {(r.change, r.k) for r in first.collect()} == {("added", "a"), ("added", "b"), ("added", None)}
    second = {(r.change, r.k): r for r in store.apply(make([("a", "1", 1), ("a", "1", 1), ("b", "x", 2), ("c", "c", 0)])).collect()}
    assert set(second) == {("changed", "b"), ("added", "c"), ("removed", None)}
    assert second["changed", "b"].old_v is None and second["changed", "b"].new_v == "x"
    assert second["removed", None].old_w == 3
    assert store.apply(make([("a", "1", 1), ("b", "x", 2), ("c", "c", 0)])).count() == 0


def _make(spark):
    return lambda rows: spark.createDataFrame(rows, "k string, v string")


def test_store_holds_what_changed_before_it_swaps(spark, tmp_path, monkeypatch):
    make, at = _make(spark), str(tmp_path / "s")
    SnapshotStore(spark, at, ["k"], ["v"], buckets=4).apply(make([("a", "1"), ("b", "1")]))
    store = SnapshotStore(spark, at, ["k"], ["v"], buckets=4)
    monkeypatch.setattr(store, "_swap", lambda step: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.apply(make([("a", "2")]))
    except RuntimeError:
        pass
    monkeypatch.undo()
    again = {(r.change, r.k) for r in store.apply(make([("a", "2")])).collect()}
    assert again == {("changed", "a"), ("removed", "b")} and store.current() == 2
    assert store.apply(make([("a", "2")])).count() == 0
    assert sorted(p.name for p in (tmp_path / "s" / "index").glob("step=*")) == ["step=2", "step=3"]


def test_store_counts_a_key_with_several_states_once(spark, tmp_path):
    make = _make(spark)
    store = SnapshotStore(spark, str(tmp_path / "s"), ["k"], ["v"], buckets=4)
    store.apply(make([("a", "1"), ("a", "2")]))
    assert [tuple(x) for x in store.apply(make([("a", "3"), ("a", "4")])).collect()] == [("changed", "a", "1", "3")]


def test_many_runs_and_changes_take_the_other_way(spark, monkeypatch):
    from datetime import datetime

    from lintlake.operators import snapshot_diff

    runs = spark.createDataFrame([(f"r{i}", "t", datetime(2025, 1, 1 + i), None, ["u1"] if i < 2 else []) for i in range(4)], RUN)
    rows = [(f"r{i}", f"/{j}", "p", f"u{j % 2}", "t", str(i) if j == 3 else None) for i in range(4) for j in range(i, 9)] * 2
    args = spark.createDataFrame(rows, EP), spark.createDataFrame([], SEC), runs
    want = sorted(map(tuple, scan_diff(*args).collect()))
    monkeypatch.setattr(snapshot_diff, "MOST_RUNS", 0)
    monkeypatch.setattr(snapshot_diff, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, scan_diff(*args).collect())) == want and len(want) > 6


def test_the_probe_shuffles_no_index(spark, tmp_path):
    make = _make(spark)
    store = SnapshotStore(spark, str(tmp_path / "s"), ["k"], ["v"], buckets=4)
    store.apply(make([("a", "1")]))
    store.apply(make([("a", "2")]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store._probe(2, ["lo", "hi"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
