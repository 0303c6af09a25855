import datetime as dt

import pytest

from scanloom.operators import incremental

SOURCE = "file_path string, content_hash string, modified_at timestamp_ntz, delivered_at timestamp_ntz, is_deleted boolean"
CACHE = "file_path string, content_hash string, vulns_json string, cached_at timestamp_ntz"
T = [dt.datetime(2024, 1, n + 1) for n in range(9)]


def cases(spark, source, cache):
    out = incremental.unprocessed_files(spark.createDataFrame(source, SOURCE), spark.createDataFrame(cache, CACHE))
    return sorted(tuple(r) for r in out.collect())


def test_cases(spark):
    source = [
        ("t/new.py", "SHA256:AA", T[0], T[0], False), ("./t/done.py", "sha256:BB", T[0], T[0], False), ("t\\old.py", "c1", T[0], T[0], False), ("t/old.py", "c2", T[1], T[1], False), ("t/old.py", "c2", T[1], T[2], False),
        ("t/gone.py", "dd", T[0], T[0], False), ("t/gone.py", None, T[1], T[1], True), ("t/failed.py", "ee", T[0], T[0], None), ("t/back.py", "f1", T[0], T[0], False), (None, "x", T[0], T[0], False),
    ]
    cache = [
        ("t/done.py", "bb", "[]", T[1]), ("t/old.py", "c1", "[]", T[1]), ("t/failed.py", "ee", '[{"a": 1', T[1]), ("t/failed.py", "ee", None, T[2]), ("t/failed.py", "ee", '{"a": 1}', T[3]), ("t/failed.py", "ee", "[] x", T[3]),
        ("t/back.py", "f1", "[]", T[1]), ("t/back.py", "f2", "[1]", T[2]), ("t/nowhere.py", "zz", "[]", T[1]),
    ]
    assert cases(spark, source, cache) == [("t/back.py", "f1"), ("t/failed.py", "ee"), ("t/new.py", "aa"), ("t/old.py", "c2")]


def test_empty(spark):
    assert cases(spark, [], []) == []
    assert cases(spark, [("t/a", "h", T[0], T[0], False)], []) == [("t/a", "h")]
    assert cases(spark, [], [("t/a", "h", "[]", T[0])]) == []


def test_store_survives_failures_and_repeats_nothing(spark, tmp_path):
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}/s")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    echo = lambda df: df
    rows = [(f"k{n}", "1") for n in range(200)]
    assert store.run(frame(rows), "k", "v", echo) == 1
    assert store.output().count() == 200

    def broken(df):
        raise RuntimeError("lost")

    changed = [("k3", "2"), *rows[4:], ("new", "1")]
    with pytest.raises(RuntimeError):
        store.run(frame(changed), "k", "v", broken)
    assert store.version() == 1
    assert store.run(frame(changed), "k", "v", echo) == 2
    assert sorted(tuple(r) for r in spark.read.parquet(store.manifest(2)["folder"] + "/output").collect()) == [("k3", "2"), ("new", "1")]
    assert store.run(frame(changed), "k", "v", echo) == 3
    assert spark.read.parquet(store.manifest(3)["folder"] + "/output").count() == 0


def test_deltas_give_the_whole_state(spark, tmp_path, monkeypatch):
    """Runs publish the ranges that changed; a chain of them reads like a full state, removed keys included."""
    monkeypatch.setattr(incremental, "MAX_CHAIN", 3)
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}/s")
    state = {f"k{n}": "1" for n in range(300)}
    steps = [{}, {"k1": "2", "k7": "2"}, {"k1": None, "k8": "3", "x": "1"}, {"k1": "2"}, {}]
    for n, step in enumerate(steps, 1):
        state = {k: v for k, v in (state | step).items() if v is not None}
        store.run(spark.createDataFrame(sorted(state.items()), "k string, v string"), "k", "v", lambda df: df)
        assert {(r["key"], r["value"]) for r in store.entries().collect()} == set(state.items())
        out = {tuple(r) for r in spark.read.parquet(store.manifest(n)["folder"] + "/output").collect()}
        assert out == (set(state.items()) if n == 1 else {(k, v) for k, v in step.items() if v is not None})
        assert len(store.manifest(n)["chain"]) == (1, 2, 3, 1, 2)[n - 1]


def test_a_source_that_changes_during_a_run_loses_nothing(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.createDataFrame([("a", "1")], "k string, v string").write.parquet(source)
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}/s")
    now = lambda: spark.read.schema("k string, v string").parquet(source)

    def process(todo):
        spark.createDataFrame([("b", "1")], "k string, v string").write.mode("append").parquet(source)
        return todo

    store.run(now(), "k", "v", process)
    store.run(now(), "k", "v", lambda df: df)
    assert sorted(tuple(r) for r in store.output().collect()) == [("a", "1"), ("b", "1")]


def test_two_runs_cannot_publish_one_version(spark, tmp_path):
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}/s")
    store._publish(1, {"folder": "a", "depth": 0})
    with pytest.raises(Exception, match="(?i)exist"):
        store._publish(1, {"folder": "b", "depth": 0})
    assert store.manifest(1)["folder"] == "a"
