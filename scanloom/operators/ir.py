"""Flow graphs of functions: dominators, phi places, data flow, intervals, lifetimes, paths.

A flow graph is a mapping from a node to its successors; instructions are tuples.  All functions are pure and meant
for one function's graph inside a task.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Graph = dict[int, list[int]]


def reachable(graph: Graph, entry: int) -> set[int]:
    seen, todo = {entry}, [entry]
    while todo:
        for m in graph.get(todo.pop(), ()):
            if m not in seen:
                seen.add(m)
                todo.append(m)
    return seen


def predecessors(graph: Graph) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {n: [] for n in graph}
    for n, ms in graph.items():
        for m in ms:
            out.setdefault(m, []).append(n)
    return out


def dominators(graph: Graph, entry: int) -> dict[int, int]:
    """Immediate dominator of every reachable node but the entry, from the dominator sets' fixpoint."""
    nodes = reachable(graph, entry)
    pred = predecessors(graph)
    dom = {n: set(nodes) for n in nodes} | {entry: {entry}}
    changed = True
    while changed:
        changed = False
        for n in nodes - {entry}:
            new = set.intersection(*(dom[p] for p in pred[n] if p in nodes)) | {n}
            changed |= new != dom[n]
            dom[n] = new
    return {n: max(dom[n] - {n}, key=lambda d: len(dom[d])) for n in nodes - {entry}}


def frontier(graph: Graph, entry: int) -> dict[int, set[int]]:
    """Nodes where a node's dominance ends."""
    idom, nodes = dominators(graph, entry), reachable(graph, entry)
    out: dict[int, set[int]] = {n: set() for n in nodes}
    for n, ps in predecessors(graph).items():
        ps = [p for p in ps if p in nodes]
        if n in nodes and len(ps) > 1:
            for p in ps:
                while p != idom.get(n):
                    out[p].add(n)
                    if p not in idom:
                        break
                    p = idom[p]
    return out


def phi_places(graph: Graph, entry: int, stores: dict[int, set[str]]) -> dict[int, set[str]]:
    """Variables that need a phi at each node: iterated frontiers of their stores."""
    ends = frontier(graph, entry)
    out: dict[int, set[str]] = {n: set() for n in ends}
    for v in set().union(*stores.values()) if stores else ():
        todo = [n for n, vs in stores.items() if v in vs and n in ends]
        while todo:
            for m in ends[todo.pop()]:
                if v not in out[m]:
                    out[m].add(v)
                    todo.append(m)
    return out


def data_flow(graph: Graph, gen: dict[int, set], kill: dict[int, set], backward: bool = False, meet: Callable = set.union) -> dict[int, tuple[set, set]]:
    """(in, out) of each node at the fixpoint of out = gen ∪ (in − kill)."""
    back = predecessors(graph)
    before, after = (graph, back) if backward else (back, graph)
    state = {n: (set(), set(gen.get(n, ()))) for n in {*graph, *back}}
    todo = list(state)
    while todo:
        n = todo.pop()
        sides = [state[p][1] for p in before.get(n, ())]
        into = meet(*sides) if len(sides) > 1 else set(sides[0]) if sides else set()
        out = set(gen.get(n, ())) | (into - set(kill.get(n, ())))
        if (into, out) != state[n]:
            state[n] = (into, out)
            todo += after.get(n, ())
    return state


def reaching(graph: Graph, stores: dict[int, set[str]]) -> dict[int, tuple[set, set]]:
    """Definitions (variable, node) that reach each node."""
    every = {(v, n) for n, vs in stores.items() for v in vs}
    gen = {n: {(v, n) for v in vs} for n, vs in stores.items()}
    kill = {n: {d for d in every if d[0] in vs and d[1] != n} for n, vs in stores.items()}
    return data_flow(graph, gen, kill)


def live(graph: Graph, reads: dict[int, set[str]], stores: dict[int, set[str]]) -> dict[int, tuple[set, set]]:
    return data_flow(graph, reads, stores, backward=True)


Interval = tuple[float, float]
ANY: Interval = (float("-inf"), float("inf"))


def hull(a: Interval, b: Interval) -> Interval:
    return min(a[0], b[0]), max(a[1], b[1])


def _eval(node: ast.AST, env: dict[str, Interval]) -> Interval:
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return node.value, node.value
    if isinstance(node, ast.Name):
        return env.get(node.id, ANY)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        a = _eval(node.operand, env)
        return -a[1], -a[0]
    if isinstance(node, ast.BinOp):
        a, b = _eval(node.left, env), _eval(node.right, env)
        if isinstance(node.op, ast.Add):
            return a[0] + b[0], a[1] + b[1]
        if isinstance(node.op, ast.Sub):
            return a[0] - b[1], a[1] - b[0]
        if isinstance(node.op, ast.Mult):
            products = [0.0 if 0 in (x, y) else x * y for x in a for y in b]
            return min(products), max(products)
    return ANY


def intervals(source: str, given: dict[str, Interval] | None = None) -> dict[str, Interval]:
    """Ranges of the names that straight-line assignments leave."""
    env = dict(given or {})
    for s in ast.parse(source).body:
        if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name):
            env[s.targets[0].id] = _eval(s.value, env)
    return env


def lifetimes(instructions: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(position, problem, name) of alloc, free, use, lock and unlock instructions: double frees, uses after free, self-deadlocks, leaks."""
    state: dict[str, str] = {}
    out = []
    for n, (op, name) in enumerate(instructions):
        was = state.get(name)
        problem = {("free", "freed"): "double_free", ("use", "freed"): "use_after_free", ("lock", "locked"): "self_deadlock"}.get((op, was or ""))
        if problem:
            out.append((n, problem, name))
        state[name] = {"alloc": "live", "free": "freed", "lock": "locked", "unlock": "open"}.get(op, was or "")
    return out + [(len(instructions), "leak", name) for name, s in state.items() if s == "live"]


def renamed(instructions: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """(target, arguments) of straight-line code in single-assignment form: each store gets a new number, reads the last one."""
    last: dict[str, int] = {}
    out = []
    for target, args in instructions:
        args = [re.sub(r"[A-Za-z_]\w*", lambda m: f"{m[0]}_{last[m[0]]}" if m[0] in last else m[0], a) for a in args]
        if target:
            last[target] = last.get(target, 0) + 1
            target = f"{target}_{last[target]}"
        out.append((target, args))
    return out


def flow_facts(files: DataFrame) -> DataFrame:
    """file_path, node, fact, value of the first function of Python files: immediate dominators, frontiers, phi places, definitions
    that reach a node and variables live before it.  Nodes are statements from 1, 0 the entry, -1 the exit; files that don't parse give none."""

    def of(path: str, text: str) -> list[tuple]:
        try:
            graph, stores, reads = flow_of(text)
        except (SyntaxError, ValueError, TypeError, RecursionError):
            return []
        rows = [(path, n, "dominator", str(d)) for n, d in dominators(graph, 0).items()]
        rows += [(path, n, "frontier", str(m)) for n, ms in frontier(graph, 0).items() for m in ms]
        rows += [(path, n, "phi", v) for n, vs in phi_places(graph, 0, stores).items() for v in vs]
        rows += [(path, n, "reaches", f"{v}@{m}") for n, (into, _) in reaching(graph, stores).items() for v, m in into]
        return rows + [(path, n, "live", v) for n, (_, out) in live(graph, reads, stores).items() for v in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["file_path"], b["content"], strict=True) for r in of(p, t)], columns=["file_path", "node", "fact", "value"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, node int, fact string, value string")


def paths(graph: Graph, entry: int, most: int = 128) -> list[list[int]]:
    """Paths from the entry to ends without repeated nodes; at most ``most``, depth first."""
    out, todo = [], [[entry]]
    while todo and len(out) < most:
        p = todo.pop()
        nxt = [m for m in graph.get(p[-1], ()) if m not in p]
        if nxt:
            todo += [[*p, m] for m in reversed(nxt)]
        else:
            out.append(p)
    return out


def flow_of(source: str) -> tuple[Graph, dict[int, set[str]], dict[int, set[str]]]:
    """Flow graph over statements of the first function (or the module), with stores and reads of each; node 0 is the entry, -1 the exit."""
    tree = ast.parse(source)
    body = next((n.body for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)), tree.body)
    graph: Graph = {0: [], -1: []}
    stores: dict[int, set[str]] = {}
    reads: dict[int, set[str]] = {}

    def names(node: ast.AST, kind: type) -> set[str]:
        return {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)}

    def block(stmts: list[ast.stmt], ins: list[int], loop: tuple[list[int], int] | None) -> list[int]:
        for s in stmts:
            n = max(graph) + 1
            graph[n] = []
            for p in ins:
                graph[p].append(n)
            head = s.test if isinstance(s, ast.If | ast.While) else s.iter if isinstance(s, ast.For) else s
            reads[n] = names(head, ast.Load)
            stores[n] = names(s.target if isinstance(s, ast.For) else head, ast.Store)
            ins = [n]
            if isinstance(s, ast.If):
                ins = block(s.body, [n], loop) + (block(s.orelse, [n], loop) if s.orelse else [n])
            elif isinstance(s, ast.While | ast.For):
                breaks: list[int] = []
                for p in block(s.body, [n], (breaks, n)):
                    graph[p].append(n)
                ins = [n, *breaks]
            elif isinstance(s, ast.Return | ast.Raise):
                graph[n].append(-1)
                ins = []
            elif isinstance(s, ast.Break) and loop:
                loop[0].append(n)
                ins = []
            elif isinstance(s, ast.Continue) and loop:
                graph[n].append(loop[1])
                ins = []
        return ins

    for p in block(body, [0], None):
        graph[p].append(-1)
    return graph, stores, reads
