import random

from scanloom.operators import hierarchy

COLS = "grp string, src string, dst string"


def brute(nodes, edges):
    """All simple paths from roots, and which nodes reach themselves."""
    kids = {}
    for n in nodes:
        kids.setdefault(n, set())
    for a, b in edges:
        kids.setdefault(a, set()).add(b)
        kids.setdefault(b, set())
    required = {b for a, b in edges if a != b}
    out, reached = set(), set()

    def reach(n):
        seen, todo = set(), list(kids[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        return seen

    cyc = {n for n in kids if n in reach(n)}

    def walk(path):
        reached.add(path[-1])
        out.add((path[-1], path[0], len(path) - 1, " > ".join(path), int(path[-1] in cyc)))
        for c in kids[path[-1]]:
            if c not in path:
                walk([*path, c])

    for r in kids.keys() - required:
        walk([r])
    return out | {(n, "", -1, "", int(n in cyc)) for n in kids.keys() - reached}


def run(spark, nodes, edges, **kw):
    n = spark.createDataFrame([("g", x) for x in nodes], "grp string, node string")
    e = spark.createDataFrame([("g", *x) for x in edges], COLS)
    return hierarchy.hierarchies(n, e, **kw).collect()


def check_ranges(rows):
    """Ranges nest exactly as paths do."""
    occ = [(r["path"].split(" > "), int(r["lo"]), int(r["size"])) for r in rows if r["lo"] is not None]
    assert len({lo for _, lo, _ in occ}) == len(occ)
    for p, lo, size in occ:
        inside = {tuple(q) for q, x, _ in occ if lo <= x < lo + size}
        assert inside == {tuple(q) for q, _, _ in occ if q[: len(p)] == p}
        assert len(inside) == size


GRAPHS = [
    (["a", "b", "c"], [("a", "b"), ("a", "c"), ("b", "c")]),
    ([], [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]),
    ([], [("a", "b"), ("b", "a")]),
    (["lonely", None], [("a", "a"), ("a", "b"), ("a", "b"), (None, "x")]),
    ([], [("r", "a"), ("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c")]),
]


def random_graph(seed):
    rng = random.Random(seed)
    names = [chr(97 + n) for n in range(9)]
    return names, [(rng.choice(names[: 3 + n // 2]), rng.choice(names)) for n in range(11)]


def run_all(spark, graphs, **kw):
    """Rows of several graphs, each a group of one call."""
    n = spark.createDataFrame([(f"g{k}", x) for k, (nodes, _) in enumerate(graphs) for x in nodes], "grp string, node string")
    e = spark.createDataFrame([(f"g{k}", *x) for k, (_, edges) in enumerate(graphs) for x in edges], COLS)
    rows = hierarchy.hierarchies(n, e, **kw).collect()
    return [[r for r in rows if r["grp"] == f"g{k}"] for k in range(len(graphs))]


def check(graphs, found):
    for (nodes, edges), rows in zip(graphs, found, strict=True):
        got = {(r["node"], r["root"], r["depth"], r["path"], r["in_cycle"]) for r in rows}
        assert got == brute([n for n in nodes if n], [e for e in edges if None not in e])
        assert len(got) == len(rows)
        check_ranges(rows)


def test_inside_and_across_tasks(spark):
    graphs = [*GRAPHS, *(random_graph(s) for s in range(6))]
    inside = run_all(spark, graphs)
    check(graphs, inside)
    across = run_all(spark, graphs, group_rows=0)
    check(graphs, across)
    number = lambda found: {(r["grp"], r["node"], r["path"], r["lo"], r["size"]) for rows in found for r in rows}
    assert number(inside) == number(across)


def test_a_group_of_many_occurrences_goes_across_tasks(spark):
    wide = ([], [(f"l{k}{a}", f"l{k + 1}{b}") for k in range(3) for a in "xy" for b in "xy"])
    assert {tuple(r) for r in run(spark, *wide, occurrences=10)} == {tuple(r) for r in run(spark, *wide)}


def test_empty_and_spellings(spark):
    assert run(spark, [], []) == []
    packages = spark.createDataFrame([("l", "A_b", None, "x"), ("l", "c.d", ["a-B", "a_b"], "y")], "lockfile string, name string, dependencies array<string>, grp string")
    edges = spark.createDataFrame([("l", "C-D", "e")], "lockfile string, src string, dst string")
    rows = hierarchy.lockfile_hierarchies(packages, edges).collect()
    assert {r["full_path"] for r in rows} == {"c-d", "c-d > a-b", "c-d > e"}


def test_descendants_by_ranges(spark):
    n = spark.createDataFrame([("g", "a")], "grp string, node string")
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "a", "c")], COLS)
    h = hierarchy.hierarchies(n, e).selectExpr("grp as lockfile", "node as name", "depth", "lo", "size")
    got = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(h).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "c", 2), ("b", "c", 1)}


def test_counts_of_occurrences():
    for nodes, edges in [*GRAPHS[:3], *(random_graph(s) for s in range(20))]:
        links = [(a, b) for a, b in {e for e in edges if None not in e}] + [(n, None) for n in nodes]
        n = sum(r[5] is not None for r in hierarchy.unfold(links))
        assert hierarchy.occurrence_count(links, 10**9) == n and hierarchy.occurrence_count(links, 2) == min(n, 3)


def test_long_chain(spark):
    names = [f"n{i:03}" for i in range(300)]
    rows = run(spark, [], list(zip(names, names[1:], strict=False)))
    assert max(r["depth"] for r in rows) == 299 and len(rows) == 300


def brute_below(nodes, edges):
    """Descendants and longest simple path of every node, by walking all its paths."""
    kids = {n: set() for n in nodes}
    for a, b in edges:
        kids.setdefault(a, set()).add(b)
        kids.setdefault(b, set())
    out = {}
    for n in kids:
        ways, below, height = [[n]], set(), 0
        while ways:
            path = ways.pop()
            height = max(height, len(path) - 1)
            below.update(path[1:])
            ways += [[*path, c] for c in kids[path[-1]] if c not in path]
        if below:
            out[n] = (len(below), height)
    return out


def test_descendants_of_every_node(spark):
    """On cycles and where no root reaches, too; inside tasks and across them."""
    graphs = [(nodes, edges) for nodes, edges in [*GRAPHS, *(random_graph(s) for s in range(6))]]
    clean = [([n for n in nodes if n], [e for e in edges if None not in e]) for nodes, edges in graphs]
    n = spark.createDataFrame([(f"g{k}", x) for k, (nodes, _) in enumerate(graphs) for x in nodes], "grp string, node string")
    e = spark.createDataFrame([(f"g{k}", *x) for k, (_, edges) in enumerate(graphs) for x in edges], COLS)
    want = {(f"g{k}", node, *r) for k, g in enumerate(clean) for node, r in brute_below(*g).items()}
    for group_rows in (hierarchy.GROUP_ROWS, 0):
        rows = hierarchy.descendant_counts(n, e, group_rows).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
