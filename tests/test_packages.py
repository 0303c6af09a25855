"""Registered package queries against plain searches over the same rows."""

from scanloom.plans import general, packages

PACKAGES = "lockfile string, name string, version string, ecosystem string, dependencies array<string>, integrity string"


def store(spark, folder, edges):
    """Both tables with the given edges, all of one lockfile."""
    spark.createDataFrame([("l", edges[0][0], "1", "npm", None, None)], PACKAGES).write.parquet(f"{folder}/locked_packages.parquet")
    spark.createDataFrame([("l", *e) for e in edges], "lockfile string, src string, dst string").write.parquet(f"{folder}/dependency_edges.parquet")
    return str(folder)


def chain(n):
    return [(f"n{i:02}", f"n{i + 1:02}") for i in range(n)]


def test_closure_and_impact_have_no_bound(spark, tmp_path):
    d = store(spark, tmp_path, [*chain(30), ("n30", "n28")])
    got = {(r["src"], r["dst"]): r["depth"] for r in packages.dep_closure(spark, d).collect()}
    want = {(f"n{i:02}", f"n{j:02}"): j - i for i in range(31) for j in range(i + 1, 31)}
    want |= {("n28", "n28"): 3, ("n29", "n29"): 3, ("n30", "n30"): 3, ("n29", "n28"): 2, ("n30", "n28"): 1, ("n30", "n29"): 2}
    assert got == want
    reach = {r["node"]: (r["affected"], r["max_depth"]) for r in packages.blast_radius(spark, d).collect()}
    assert reach["n27"] == (27, 27) and reach["n30"] == (30, 30) and reach["n28"] == (30, 28)


def test_descendants_on_and_below_cycles(spark, tmp_path):
    d = store(spark, tmp_path, [("r", "a"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("y", "z")])
    got = {(r["name"], r["n_descendants"], r["height"]) for r in general.p3_descendants(spark, d).collect()}
    assert got == {("r", 2, 2), ("a", 1, 1), ("b", 1, 1), ("x", 2, 2), ("y", 2, 1)}


def test_paths_of_any_length(spark, tmp_path):
    d = store(spark, tmp_path, [*chain(30), ("n03", "n02"), ("n05", "leaf"), ("self", "self"), ("self", "leaf"), ("n00", "n30")])
    got = {tuple(r)[1:] for r in packages.dep_paths(spark, d).collect()}
    names = [f"n{i:02}" for i in range(31)]
    assert got == {("n00", "n30", ">".join(names)), ("n00", "leaf", ">".join([*names[:6], "leaf"])), ("n00", "n30", "n00>n30")}
