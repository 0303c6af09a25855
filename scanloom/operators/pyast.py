"""Analyses of Python source that need its syntax tree: one pass per file in Arrow batches.

Each file's rows come out of one task; files that don't parse give none.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scanloom.operators.code import SOURCES
from scanloom.workdir import materialise

SCHEMA = "file_path string, rule_id string, function string, line_number int, value int"
_BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)


def _functions(tree: ast.AST) -> Iterator[ast.FunctionDef]:
    return (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))


def cyclomatic(fn: ast.AST) -> int:
    return 1 + sum(isinstance(n, _BRANCHES) or (isinstance(n, ast.BoolOp) and len(n.values) - 1) or (isinstance(n, ast.Match) and len(n.cases)) for n in ast.walk(fn))


def cognitive(fn: ast.AST) -> int:
    """Each branch costs one plus its nesting; boolean chains one."""

    def cost(node: ast.AST, depth: int) -> int:
        total = 0
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.If | ast.For | ast.While | ast.AsyncFor | ast.ExceptHandler | ast.IfExp):
                total += 1 + depth + cost(child, depth + 1)
            else:
                total += isinstance(child, ast.BoolOp) + cost(child, depth)
        return total

    return cost(fn, 0)


def unreachable(tree: ast.AST) -> Iterator[ast.stmt]:
    """First statement after one that always leaves its block."""
    for node in ast.walk(tree):
        for field in ("body", "orelse", "finalbody"):
            block = getattr(node, field, None)
            if isinstance(block, list):
                for before, after in zip(block, block[1:], strict=False):
                    if isinstance(before, ast.Return | ast.Raise | ast.Break | ast.Continue):
                        yield after
                        break


def endless_recursion(fn: ast.AST) -> bool:
    calls = any(isinstance(n, ast.Call) and getattr(n.func, "id", None) == fn.name for n in ast.walk(fn))
    return calls and not any(isinstance(n, ast.If | ast.IfExp | ast.While | ast.For | ast.Try | ast.Match) for n in ast.walk(fn))


def _call_name(node: ast.AST) -> str:
    return ast.unparse(node.func) if isinstance(node, ast.Call) else ""


def check_then_open(fn: ast.AST) -> Iterator[int]:
    """Lines that open a path whose existence was tested before in the function."""
    tested: set[str] = set()
    for n in sorted((x for x in ast.walk(fn) if isinstance(x, ast.Call) and x.args), key=lambda x: (x.lineno, x.col_offset)):
        name, arg = _call_name(n), ast.unparse(n.args[0])
        if name.endswith(("exists", "isfile", "access", "isdir")):
            tested.add(arg)
        elif name in ("open", "os.open", "os.remove", "os.unlink", "io.open") and arg in tested:
            yield n.lineno


def use_after_close(fn: ast.AST) -> Iterator[int]:
    closed: dict[str, int] = {}
    for n in sorted((x for x in ast.walk(fn) if isinstance(x, ast.Call | ast.Assign)), key=lambda x: (x.lineno, x.col_offset)):
        if isinstance(n, ast.Assign):
            for t in n.targets:
                closed.pop(getattr(t, "id", ""), None)
        elif isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
            name = n.func.value.id
            if n.func.attr == "close":
                closed[name] = n.lineno
            elif name in closed and n.lineno > closed[name]:
                yield n.lineno


def none_dereferenced(fn: ast.AST) -> Iterator[int]:
    """Attribute use of a name set to None with no test or new value in between."""
    none: set[str] = set()
    for n in sorted((x for x in ast.walk(fn) if hasattr(x, "lineno")), key=lambda x: (x.lineno, x.col_offset)):
        if isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    (none.add if isinstance(n.value, ast.Constant) and n.value.value is None else none.discard)(t.id)
        elif isinstance(n, ast.If | ast.While | ast.IfExp):
            none -= {x.id for x in ast.walk(n.test) if isinstance(x, ast.Name)}
        elif isinstance(n, ast.For | ast.With):
            none -= {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in none:
            yield n.lineno


def dead_stores(fn: ast.AST) -> Iterator[int]:
    """Straight-line assignments to a name that is never read in the function."""
    read = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Store)}
    for n in ast.walk(fn):
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and n.targets[0].id not in read and not n.targets[0].id.startswith("_"):
            yield n.lineno


def unassigned_uses(fn: ast.FunctionDef) -> Iterator[int]:
    """Reads of a local that only one branch has assigned: forward intersection over statements."""
    local = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    out: list[int] = []

    def stores(node: ast.AST) -> set[str]:
        return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}

    def reads(node: ast.AST, have: set[str]) -> None:
        out.extend(n.lineno for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in local and n.id not in have)

    def leaves(block: list[ast.stmt]) -> bool:
        return bool(block) and isinstance(block[-1], ast.Return | ast.Raise | ast.Continue | ast.Break)

    def run(block: list[ast.stmt], have: set[str]) -> set[str]:
        for s in block:
            if isinstance(s, ast.If):
                reads(s.test, have)
                a, b = run(s.body, set(have)), run(s.orelse, set(have))
                have = b if leaves(s.body) else a if leaves(s.orelse) else a & b
            elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
                reads(s.iter if hasattr(s, "iter") else s.test, have)
                run(s.body, have | (stores(s.target) if hasattr(s, "target") else set()))
                have = run(s.orelse, set(have))
            elif isinstance(s, ast.Try):
                done = run(s.body, set(have))
                ends = [run(h.body, have | ({h.name} if h.name else set())) for h in s.handlers if not leaves(h.body)]
                for e in ends:
                    done &= e
                have = run(s.finalbody, run(s.orelse, done))
            elif isinstance(s, ast.With | ast.AsyncWith):
                have = run(s.body, have | {x for i in s.items if i.optional_vars for x in stores(i.optional_vars)})
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                have = have | {s.name}
            else:
                value = getattr(s, "value", None)
                reads(value if isinstance(s, ast.Assign | ast.AnnAssign) and value is not None else s, have)
                have = have | stores(s)
        return have

    args = fn.args
    run(fn.body, {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a})
    return iter(sorted(set(out)))


def analyse(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = [(path, "AST-DEAD-001", None, s.lineno, None) for s in unreachable(tree)]
    for fn in _functions(tree):
        add = lambda rule, line, value=None, fn=fn: out.append((path, rule, fn.name, line, value))
        c, g = cyclomatic(fn), cognitive(fn)
        if c > 10:
            add("AST-CMPLX-001", fn.lineno, c)
        if g > 15:
            add("AST-CMPLX-002", fn.lineno, g)
        if endless_recursion(fn):
            add("AST-REC-001", fn.lineno)
        for rule, lines in (
            ("AST-TOCTOU-001", check_then_open(fn)), ("AST-UAC-001", use_after_close(fn)), ("AST-NULL-001", none_dereferenced(fn)), ("AST-DATAFLOW-001", dead_stores(fn)), ("AST-SSA-001", unassigned_uses(fn)),
        ):
            for line in lines:
                add(rule, line)
    return out


def python_findings(files: DataFrame) -> DataFrame:
    """Findings of the syntax-tree rules in Python files (file_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["file_path"], b["content"], strict=True) if isinstance(c, str) for r in analyse(p, c)]
            yield pd.DataFrame(rows, columns=["file_path", "rule_id", "function", "line_number", "value"]).astype({"value": "Int32", "line_number": "Int32"})

    return files.where(F.lower("file_path").endswith(".py")).select("file_path", "content").mapInPandas(run, SCHEMA)


_PLAIN = (ast.If, ast.For, ast.While, ast.Return, ast.Import, ast.ImportFrom, ast.With, ast.Lambda)


def halstead(fn: ast.AST) -> dict[str, float]:
    """Vocabulary, length, volume, difficulty and effort from the operators and operands of a function's tree."""
    operators: list[str] = []
    operands: list[str] = []
    for n in ast.walk(fn):
        if isinstance(n, ast.BinOp | ast.UnaryOp | ast.BoolOp):
            operators.append(type(n.op).__name__)
        elif isinstance(n, ast.Compare):
            operators += [type(op).__name__ for op in n.ops]
        elif isinstance(n, ast.Call | ast.Attribute | ast.Subscript):
            operators.append({"Call": "()", "Attribute": ".", "Subscript": "[]"}[type(n).__name__])
        elif isinstance(n, ast.Assign | ast.AugAssign | ast.AnnAssign):
            operators.append("=")
        elif isinstance(n, _PLAIN):
            operators.append(type(n).__name__)
        elif isinstance(n, ast.Name):
            operands.append(n.id)
        elif isinstance(n, ast.Constant):
            operands.append(repr(n.value))
    kinds, names = len(set(operators)), len(set(operands))
    length = len(operators) + len(operands)
    volume = length * math.log2(kinds + names) if kinds + names else 0.0
    difficulty = kinds / 2 * len(operands) / names if names else 0.0
    return {"vocabulary": kinds + names, "length": length, "volume": round(volume, 2), "difficulty": round(difficulty, 2), "effort": round(difficulty * volume, 2)}


def function_metrics(files: DataFrame) -> DataFrame:
    """file_path, function, line_number, cyclomatic, cognitive and Halstead's numbers of every Python function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["content"], strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, TypeError, RecursionError):
                    continue
                rows += [(path, fn.name, fn.lineno, cyclomatic(fn), cognitive(fn), *halstead(fn).values()) for fn in _functions(tree)]
            yield pd.DataFrame(rows, columns=["file_path", "function", "line_number", "cyclomatic", "cognitive", "vocabulary", "length", "volume", "difficulty", "effort"])

    schema = "file_path string, function string, line_number int, cyclomatic int, cognitive int, vocabulary int, length int, volume double, difficulty double, effort double"
    return files.where(F.lower("file_path").endswith(".py")).select("file_path", "content").mapInPandas(run, schema)


CALLS = "file_path string, caller string, line_number int, callee string, position int, argument_names array<string>, is_source boolean"


def _calls(path: str, source: str) -> list[tuple]:
    import re

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    source_re, out = re.compile(SOURCES), []
    for fn in _functions(tree):
        params = [a.arg for a in fn.args.args]
        out.append((path, fn.name, fn.lineno, "", -1, params, False))
        tainted: set[str] = set()
        for n in sorted((x for x in ast.walk(fn) if isinstance(x, ast.Assign | ast.Call)), key=lambda x: (x.lineno, -x.col_offset)):
            if isinstance(n, ast.Assign):
                text = ast.unparse(n.value)
                if source_re.search(text) or {x.id for x in ast.walk(n.value) if isinstance(x, ast.Name)} & tainted:
                    tainted |= {t.id for t in n.targets if isinstance(t, ast.Name)}
                continue
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if not name:
                continue
            out.append((path, fn.name, n.lineno, name, -2, [], False))
            for k, a in enumerate(n.args):
                names = [x.id for x in ast.walk(a) if isinstance(x, ast.Name)]
                out.append((path, fn.name, n.lineno, name, k, names, bool(source_re.search(ast.unparse(a)) or set(names) & tainted)))
    return out


def calls(files: DataFrame) -> DataFrame:
    """Functions (position -1: their parameters), calls (-2) and call arguments (0…) of Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_path", "caller", "line_number", "callee", "position", "argument_names", "is_source"]
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["file_path"], b["content"], strict=True) if isinstance(c, str) for r in _calls(p, c)], columns=cols)

    return files.where(F.lower("file_path").endswith(".py")).select("file_path", "content").mapInPandas(run, CALLS)


SINK_NAMES = ("system", "popen", "execute", "eval", "exec", "run", "call", "check_output")


def call_edges(call_table: DataFrame) -> DataFrame:
    """src (caller), dst (callee) of every call, once; for ``graph.closure`` and ``graph.impact``."""
    return call_table.where("position = -2").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def call_impact(call_table: DataFrame) -> DataFrame:
    """function, direct (callers), transitive (callers at any distance) of every function defined."""
    from scanloom.operators import graph

    defined = call_table.where("position = -1").select(F.col("caller").alias("function")).distinct()
    closed = graph.closure(call_edges(call_table).withColumn("g", F.lit(0)), ["g"])
    per = closed.groupBy(F.col("dst").alias("function")).agg(F.countDistinct(F.when(F.col("depth") == 1, F.col("src"))).alias("direct"), F.countDistinct("src").alias("transitive"))
    return defined.join(per, "function", "left").fillna(0, ["direct", "transitive"])


def interprocedural_taint(call_table: DataFrame) -> DataFrame:
    """file_path, function, line_number, sink, param: sinks that a tainted parameter reaches, across files.

    A round passes taint from arguments to the parameters of the called function's name, until a round adds nothing.
    """
    table = materialise(call_table, "calls")
    params = table.where("position = -1").select(F.col("caller").alias("callee"), F.posexplode("argument_names").alias("position", "param"))
    args = table.where("position >= 0")
    tainted = materialise(args.where("is_source").join(params, ["callee", "position"]).select(F.col("callee").alias("function"), "param").distinct(), "tainted")
    while True:
        step = args.select(F.col("caller").alias("function"), F.explode("argument_names").alias("param"), "callee", "position").join(tainted, ["function", "param"]).select("callee", "position").distinct()
        nxt = materialise(tainted.unionByName(step.join(params, ["callee", "position"]).select(F.col("callee").alias("function"), "param")).distinct(), "tainted")
        if nxt.count() == tainted.count():
            break
        tainted = nxt
    sinks = args.where(F.col("callee").isin(*SINK_NAMES)).select("file_path", F.col("caller").alias("function"), "line_number", F.col("callee").alias("sink"), F.explode("argument_names").alias("param"))
    return sinks.join(tainted, ["function", "param"]).select("file_path", "function", "line_number", "sink", "param").distinct()
