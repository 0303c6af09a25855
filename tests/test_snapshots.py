import datetime as dt
import random

import pytest

from scanloom.operators import merkle, snapshots

FINDING = "scan_id long, rule_id string, file_path string, line_number int, severity string, confidence string, line_content string, delivered_at timestamp_ntz"
SCAN = "id long, target string, scan_timestamp double"
T = dt.datetime(2024, 1, 1)


def changes(spark, scans, findings, **kw):
    out = snapshots.snapshot_changes(spark.createDataFrame(scans, SCAN), spark.createDataFrame(findings, FINDING), **kw)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def f(scan, rule="R", path="t/a.py", line=1, sev="HIGH", conf="HIGH", text="x", at=T):
    return (scan, rule, path, line, sev, conf, text, at)


def test_every_kind(spark):
    scans = [(1, "t", 10.0), (2, "t", 20.0), (2, "t", 20.0), (3, "u", 5.0)]
    findings = [
        f(1, "same"), f(2, "same", sev="high"), f(1, "gone"), f(2, "added"), f(1, "worse", sev="LOW"), f(2, "worse", sev="HIGH"),
        f(1, "text", text="a"), f(2, "text", text="b"), f(1, "null", text=None, conf=None), f(2, "null", text=None, conf=None), f(1, "better"), f(2, "better", sev="LOW"), f(3, "alone"), f(9, "unknown scan"),
    ]
    assert changes(spark, scans, findings) == sorted(
        [(2, "resolved", "gone", "t/a.py", 1), (2, "new", "added", "t/a.py", 1), (2, "regression", "worse", "t/a.py", 1), (2, "changed", "text", "t/a.py", 1), (2, "changed", "better", "t/a.py", 1)], key=repr
    )


def test_path_form_null_lines_and_late_rows(spark):
    scans = [(1, "t", 1.0), (2, "t", 2.0)]
    findings = [
        f(1, path=".\\t\\a.py", line=None), f(2, path="./t/a.py", line=0),
        f(1, "late", sev="LOW"), f(1, "late", sev="HIGH", at=T + dt.timedelta(days=9)), f(2, "late", sev="HIGH"),
        f(2, None, None, None, None, None, None, None),
    ]
    assert changes(spark, scans, findings) == [(2, "new", None, None, 0)]


def test_snapshot_without_findings_and_ids_out_of_order(spark):
    scans = [(7, "t", 1.0), (3, "t", 2.0), (5, "t", 3.0), (8, None, 4.0)]
    got = changes(spark, scans, [f(7), f(5)])
    assert got == [(3, "resolved", "R", "t/a.py", 1), (5, "new", "R", "t/a.py", 1)]


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [(1, "t", 1.0), (2, "t", 2.0)], []) == []
    assert changes(spark, [], [f(1)]) == []


def test_other_columns_with_clashing_names(spark):
    scans = spark.createDataFrame([(1, "t", 1.0), (2, "t", 2.0)], SCAN)
    findings = spark.createDataFrame([f(2)], FINDING)
    for c in ("pair", "cur", "coll", "node", "rank", "depth", "target"):
        findings = findings.selectExpr("*", f"1 as {c}")
    assert [tuple(r) for r in snapshots.snapshot_changes(scans.selectExpr("*", "1 as prev", "2 as coll"), findings).collect()] == [(2, "new", "R", "t/a.py", 1)]


@pytest.mark.parametrize("leaf_rows", [1, 4, 1000])
def test_against_brute_force(spark, leaf_rows):
    """Whatever the size of the leaves, the tree finds what comparing all rows finds."""
    rng = random.Random(leaf_rows)
    state, scans, findings, expected = {}, [], [], set()
    for n in range(6):
        scans.append((n, "t", float(n)))
        old = dict(state)
        for k in [k for k in state if rng.random() < 0.05]:
            del state[k]
        for k in list(state):
            if rng.random() < 0.05:
                state[k] = (rng.choice(snapshots.SEVERITIES), state[k][1])
        for _ in range(40):
            state[(f"r{rng.randint(0, 9)}", f"t/{rng.randint(0, 60)}.py", rng.randint(1, 5))] = (rng.choice(snapshots.SEVERITIES), "x")
        findings += [f(n, k[0], k[1], k[2], v[0], text=v[1]) for k, v in state.items()]
        if n:
            rank = snapshots.SEVERITIES.index
            for k in old.keys() | state.keys():
                kind = "new" if k not in old else "resolved" if k not in state else "regression" if rank(state[k][0]) > rank(old[k][0]) else "changed" if state[k] != old[k] else None
                if kind:
                    expected.add((n, kind, *k))
    assert set(changes(spark, scans, findings, leaf_rows=leaf_rows)) == expected


def test_equal_snapshots_open_no_leaf(spark):
    rows = spark.range(1000).selectExpr("explode(array('a', 'b')) coll", "2 as depth", "id & 255 as node", "xxhash64(id) h1", "xxhash64(id, 1) h2")
    tree = merkle.tree(merkle.leaves(rows), 2)
    pairs = spark.createDataFrame([(0, "a", "b")], "pair int, cur string, prev string")
    assert merkle.differing_leaves(tree, pairs, 2).count() == 0


def test_previous_of_crosses_slices(spark):
    rows = [("t", float(x), n) for n, x in enumerate([1, 2, 500_000, 500_001, 9_000_000])] + [("t", None, 77)]
    df = spark.createDataFrame(rows, "target string, at double, id long")
    got = {r["id"]: r["prev"] for r in snapshots.previous_of(df, "target", "at", "id").collect()}
    assert got == {77: None, 0: 77, 1: 0, 2: 1, 3: 2, 4: 3}
