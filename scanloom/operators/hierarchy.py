"""Parent–child links to full hierarchies.

Links of one group (a lockfile, say) form a directed graph.  Unfolding it from its roots gives a tree of
occurrences, one for each path that visits no node twice.  Subtree sizes are summed upward, each
occurrence then gets the preorder range ``[lo, lo + size)`` by prefix sums over its siblings, and an
occurrence's ancestors and descendants are the ranges that hold it and that it holds.  Nodes that the
upward pass never completes reach a cycle; among them the strongly connected ones are on it.

An occurrence's root, depth and path are read from the ranges: its ancestors are the ranges that hold it, in the
order of their starts.  Groups of up to ``group_rows`` links and ``occurrences`` occurrences are unfolded inside one
task each, streaming their rows out; larger ones are unfolded by joins, level by level, so that no task ever holds
a large group.  Both ways number alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from scanloom.functions.paths import package_form
from scanloom.workdir import materialise

SCHEMA = "grp string, node string, root string, depth int, path string, in_cycle int, lo long, size long"
SEPARATOR = " > "
GROUP_ROWS = 100_000
OCCURRENCES = 5_000_000
CHUNK = 20_000


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """grp, src, dst: each link once, and each node once with a null dst.  Null names are no nodes."""
    edges = edges.where("grp is not null and src is not null and dst is not null").select("grp", "src", "dst")
    ends = edges.select("grp", F.explode(F.array("src", "dst")).alias("node"))
    nodes = nodes.where("grp is not null and node is not null").select("grp", "node").unionByName(ends)
    return edges.unionByName(nodes.select("grp", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"))).distinct()


# ---------------------------------------------------------------- inside one task


def upward_sizes(children: dict[str, list[str]]) -> dict[str, int]:
    """Size of the unfolded subtree below each node that reaches no cycle; the others are missing."""
    parents: dict[str, list[str]] = {}
    open_ = {n: len(cs) for n, cs in children.items()}
    for n, cs in children.items():
        for c in cs:
            parents.setdefault(c, []).append(n)
    size = dict.fromkeys(children, 1)
    ready, done = [n for n, k in open_.items() if not k], {}
    while ready:
        n = ready.pop()
        done[n] = size[n]
        for p in parents.get(n, ()):
            size[p] += size[n]
            open_[p] -= 1
            if not open_[p]:
                ready.append(p)
    return done


def components(children: dict[str, list[str]], among: set[str]) -> Iterator[list[str]]:
    """Strongly connected components of ``among``, each before those it reaches."""
    order: list[str] = []
    seen: set[str] = set()
    back: dict[str, list[str]] = {n: [] for n in among}
    for start in among:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(children[start]))]
        while stack:
            node, rest = stack[-1]
            nxt = next((c for c in rest if c in among and c not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(children[nxt])))
    for n in among:
        for c in children[n]:
            if c in among:
                back[c].append(n)
    taken: set[str] = set()
    for start in reversed(order):
        if start in taken:
            continue
        part, todo = [], [start]
        taken.add(start)
        while todo:
            n = todo.pop()
            part.append(n)
            for p in back[n]:
                if p not in taken:
                    taken.add(p)
                    todo.append(p)
        yield part


def on_cycles(children: dict[str, list[str]], among: set[str]) -> set[str]:
    """Nodes of ``among`` that reach themselves: strongly connected components of several, or self links."""
    found = {n for n in among if n in children[n]}
    for part in components(children, among):
        if len(part) > 1:
            found.update(part)
    return found


def graph_of(links: list[tuple[str, str | None]]) -> tuple[dict[str, list[str]], list[str]]:
    """(children in the order of their names, roots in the order of theirs)."""
    children: dict[str, list[str]] = {}
    required: set[str] = set()
    for src, dst in links:
        children.setdefault(src, [])
        if dst is not None:
            children[src].append(dst)
            children.setdefault(dst, [])
            if dst != src:
                required.add(dst)
    for cs in children.values():
        cs.sort()
    return children, sorted(children.keys() - required)


class CyclicTree:
    """Occurrences below a root that reaches a cycle: a node's subtree depends on the nodes above it there, so they are
    enumerated.  Subtrees of nodes that reach none are counted in whole.  ``count`` stops at ``limit``."""

    def __init__(self, root: str, children: dict[str, list[str]], size: dict[str, int], limit: float = math.inf) -> None:
        self.names, self.sizes, self.below = [root], [1], [[]]
        stack, on_path, self.count = [(0, iter(children[root]))], {root}, 1
        while stack and self.count <= limit:
            at, rest = stack[-1]
            child = next((c for c in rest if c not in on_path), None)
            if child is None:
                stack.pop()
                on_path.discard(self.names[at])
                if stack:
                    self.sizes[stack[-1][0]] += self.sizes[at]
            elif child in size:
                self.below[at].append((child, None))
                self.sizes[at] += size[child]
                self.count += size[child]
            else:
                self.below[at].append((child, len(self.names)))
                on_path.add(child)
                stack.append((len(self.names), iter(children[child])))
                self.names.append(child)
                self.sizes.append(1)
                self.below.append([])
                self.count += 1


def occurrence_count(links: list[tuple[str, str | None]], limit: int) -> int:
    """How many occurrences a group unfolds to; any number above ``limit`` if there are more."""
    children, roots = graph_of(links)
    size = upward_sizes(children)
    total = 0
    for root in roots:
        total += size[root] if root in size else CyclicTree(root, children, size, limit - total).count
        if total > limit:
            break
    return min(total, limit + 1)


def placed(children: dict[str, list[str]], roots: list[str], size: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(node, lo, size) of every occurrence by lo: from the roots down, siblings get adjoining ranges by prefix sums."""
    at = 0
    for root in roots:
        tree = None if root in size else CyclicTree(root, children, size)
        todo = [(root, 0 if tree else None, at)]
        at += tree.sizes[0] if tree else size[root]
        while todo:
            node, k, lo = todo.pop()
            yield node, lo, size[node] if k is None else tree.sizes[k]
            below, start = [], lo + 1
            for child, j in ((c, None) for c in children[node]) if k is None else tree.below[k]:
                below.append((child, j, start))
                start += size[child] if j is None else tree.sizes[j]
            todo += reversed(below)


def unfold(links: list[tuple[str, str | None]], separator: str = SEPARATOR) -> Iterator[tuple]:
    """Rows (node, root, depth, path, in_cycle, lo, size) of one group, unreached nodes included."""
    children, roots = graph_of(links)
    size = upward_sizes(children)
    cyclic = on_cycles(children, children.keys() - size.keys())
    reached: set[str] = set()
    ends: list[int] = []  # of the ranges that hold the place reached, and their nodes
    names: list[str] = []
    for node, lo, n in placed(children, roots, size):
        while ends and ends[-1] <= lo:
            ends.pop()
            names.pop()
        ends.append(lo + n)
        names.append(node)
        reached.add(node)
        yield node, names[0], len(names) - 1, separator.join(names), int(node in cyclic), lo, n
    for node in sorted(children.keys() - reached):
        yield node, "", -1, "", int(node in cyclic), None, None


def _links(packed: list[dict]) -> list[tuple[str, str | None]]:
    return [(x["src"], x["dst"]) for x in packed]


def _unfold_batches(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["grp", "node", "root", "depth", "path", "in_cycle", "lo", "size"]
    out: list[tuple] = []
    frame = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    for b in batches:
        for grp, links in zip(b.column("grp").to_pylist(), b.column("links").to_pylist(), strict=True):
            for row in unfold(_links(links), separator):
                out.append((grp, *row))
                if len(out) >= CHUNK:
                    yield frame()
                    out = []
    if out:
        yield frame()


def _count_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [occurrence_count(_links(links), limit) for links in b.column("links").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(n, pa.int64())], names=["grp", "n"])


# ---------------------------------------------------------------- across tasks


def _upward(edges: DataFrame, nodes: DataFrame, of: str, to: str) -> DataFrame:
    """Nodes that the pass from the ends of ``edges`` never completes (grp, node).

    A node is complete once all its ``to`` neighbours are.  One round per level.
    """
    degree = edges.groupBy("grp", F.col(of).alias("node")).agg(F.count("*").alias("k"))
    left = materialise(nodes.join(degree, ["grp", "node"], "left").fillna(0, ["k"]), "degree")
    while True:
        done = left.where("k = 0")
        if done.isEmpty():
            return left.select("grp", "node")
        less = edges.join(done.select("grp", F.col("node").alias(to)), ["grp", to]).groupBy("grp", F.col(of).alias("node")).agg(F.count("*").alias("less"))
        left = materialise(left.where("k > 0").join(less, ["grp", "node"], "left").select("grp", "node", (F.col("k") - F.coalesce("less", F.lit(0))).alias("k")), "degree")


def _spread(labels: DataFrame, edges: DataFrame, same: bool) -> DataFrame:
    """Largest label that reaches each node along ``edges``; with ``same``, marks spread within one label."""
    while True:
        if same:
            there = labels.select("grp", F.col("node").alias("dst"), F.col("label").alias("l2"), "mark")
            step = (
                edges.join(labels.where("mark").select("grp", F.col("node").alias("src"), "label"), ["grp", "src"])
                .join(there.where("not mark"), ["grp", "dst"])
                .where("label = l2")
                .select("grp", F.col("dst").alias("node"), F.lit(True).alias("m"))
                .distinct()
            )
            nxt = labels.join(step, ["grp", "node"], "left").select("grp", "node", "label", (F.col("mark") | F.coalesce("m", F.lit(False))).alias("mark"))
            key = "mark"
        else:
            step = edges.join(labels.select("grp", F.col("node").alias("src"), "label"), ["grp", "src"]).groupBy("grp", F.col("dst").alias("node")).agg(F.max("label").alias("l2"))
            nxt = labels.join(step, ["grp", "node"], "left").select("grp", "node", F.greatest("label", "l2").alias("label"))
            key = "label"
        nxt = materialise(nxt, "labels")
        moved = nxt.join(labels.select("grp", "node", F.col(key).alias("was")), ["grp", "node"]).where(F.col(key) != F.col("was"))
        if moved.isEmpty():
            return nxt
        labels = nxt


def _cyclic_nodes(edges: DataFrame, core: DataFrame) -> DataFrame:
    """grp, node of the core's nodes that lie on a cycle: components found by colouring, then set aside."""
    loops = edges.where("src = dst").select("grp", F.col("src").alias("node")).distinct()
    edges, found = edges.where("src <> dst"), [loops]
    while True:
        inside = materialise(
            edges.join(core.withColumnRenamed("node", "src"), ["grp", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["grp", "dst"], "left_semi"), "core_edges"
        )
        core = _upward(inside, core, "src", "dst")
        core = _upward(inside.join(core.withColumnRenamed("node", "src"), ["grp", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["grp", "dst"], "left_semi"), core, "dst", "src")
        if core.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        colours = _spread(core.withColumn("label", F.col("node")), inside, False)
        turned = inside.select("grp", F.col("dst").alias("src"), F.col("src").alias("dst"))
        marked = _spread(colours.withColumn("mark", F.col("label") == F.col("node")), turned, True).where("mark")
        sizes = marked.groupBy("grp", "label").agg(F.count("*").alias("n"))
        found.append(marked.join(sizes.where("n > 1"), ["grp", "label"], "left_semi").select("grp", "node"))
        core = materialise(core.join(marked, ["grp", "node"], "left_anti"), "core")


def _unfold_by_joins(rows: DataFrame, separator: str) -> DataFrame:
    """The rows of ``unfold`` for groups too large for a task, by one join per level."""
    edges = materialise(rows.where("dst is not null"), "edges")
    nodes = materialise(rows.where("dst is null").select("grp", F.col("src").alias("node")), "nodes")
    unsized = _upward(edges, nodes, "src", "dst")
    cyclic = materialise(_cyclic_nodes(edges, unsized), "cyclic")
    required = edges.where("src <> dst").select("grp", F.col("dst").alias("node"))
    ids = lambda parts: F.sha2(F.array_join(parts, "\u0001"), 256)
    level = nodes.join(required, ["grp", "node"], "left_anti").select("grp", "node", F.array("node").alias("names"), F.lit("").alias("up"))
    levels = []
    while True:
        level = materialise(level.withColumn("id", ids(F.concat(F.array("grp"), F.col("names")))), "level")
        if level.isEmpty():
            break
        levels.append(level.drop("names"))
        level = (
            level.select("grp", F.col("node").alias("src"), "names", F.col("id").alias("up"))
            .join(edges, ["grp", "src"])
            .where("not array_contains(names, dst)")
            .select("grp", F.col("dst").alias("node"), F.array_append("names", F.col("dst")).alias("names"), "up")
        )
    sized: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        here, one = levels[depth], F.lit(1).cast("long")
        if sized:
            below = sized[-1].groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("below"))
            here = here.join(below, "id", "left").withColumn("size", F.coalesce(F.col("below") + 1, one)).drop("below")
        else:
            here = here.withColumn("size", one)
        sized.append(materialise(here, "sized"))
    out, above = None, None
    for here in reversed(sized):
        # prefix sums over siblings by name: within slices of the sorted rows, and over the slices' sums
        cut = materialise(here.repartitionByRange("grp", "up", "node").withColumn("slice", F.spark_partition_id()), "sliced")
        sums = cut.groupBy("grp", "up", "slice").agg(F.sum("size").alias("s"))
        start = sums.withColumn("start", F.coalesce(F.sum("s").over(W.partitionBy("grp", "up").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
        own = F.coalesce(F.sum("size").over(W.partitionBy("grp", "up", "slice").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = cut.withColumn("own", own).join(start, ["grp", "up", "slice"])
        base = F.lit(0)
        if above is not None:
            at = at.join(above.select(F.col("id").alias("up"), F.col("lo").alias("base")), "up")
            base = F.col("base") + 1
        above = materialise(at.select("grp", "node", "id", (base + F.col("start") + F.col("own")).cast("long").alias("lo"), "size"), "placed")
        out = above if out is None else out.unionByName(above)
    mark = cyclic.withColumn("in_cycle", F.lit(1))
    if out is None:
        out = nodes.limit(0).select("grp", "node", F.lit("").alias("id"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("size"))
    # ancestors are the ranges that hold a place; in the order of their starts they are its path
    pairs = _range_pairs(out.select(F.col("grp").alias("g"), F.col("node").alias("name"), "lo", "size"), own=True)
    chain = pairs.groupBy("g", "p").agg(F.array_sort(F.collect_list(F.struct("a", "ancestor"))).alias("chain"))
    names = F.transform("chain", lambda x: x["ancestor"])
    chain = chain.select(F.col("g").alias("grp"), F.col("p").alias("lo"), names[0].alias("root"), (F.size("chain") - 1).alias("depth"), F.array_join(names, separator).alias("path"))
    reached = materialise(out.select("grp", "node", "lo", "size").join(chain, ["grp", "lo"]), "reached")
    lost = nodes.join(reached.select("grp", "node").distinct(), ["grp", "node"], "left_anti")
    null = F.lit(None).cast("long")
    all_ = reached.unionByName(lost.select("grp", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path"), null.alias("lo"), null.alias("size")))
    return all_.join(mark, ["grp", "node"], "left").select("grp", "node", "root", "depth", "path", F.coalesce("in_cycle", F.lit(0)).alias("in_cycle"), "lo", "size")


# ---------------------------------------------------------------- the operator


def hierarchies(nodes: DataFrame, edges: DataFrame, group_rows: int = GROUP_ROWS, separator: str = SEPARATOR, occurrences: int = OCCURRENCES) -> DataFrame:
    """One row for each path from a root to a node that visits no node twice, with its nested-set range.

    ``nodes``: grp, node; ``edges``: grp, src (parent), dst (child).  Returns grp, node, root, depth, path,
    in_cycle, lo, size; ``path`` joins the names by ``separator``.  A root is a node that is no other node's child.  A node that no root reaches gives
    one row with root and path empty, depth -1 and null range.  Repeated links and nodes count once; null
    names and groups are left out; a node linked to itself is on a cycle; empty tables give no rows.
    Ranges number the rows of a group from 0, roots and siblings by name; groups of more than ``group_rows`` links or
    ``occurrences`` rows are spread over all tasks and give the same rows.
    """
    rows = materialise(graph_rows(nodes, edges), "links")
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > group_rows).select("grp")
    small = rows if large.isEmpty() else rows.join(large, "grp", "left_anti")
    packed = materialise(small.groupBy("grp").agg(F.collect_list(F.struct("src", "dst")).alias("links")), "packed")
    many = materialise(packed.mapInArrow(partial(_count_batches, limit=occurrences), "grp string, n long").where(F.col("n") > occurrences).select("grp").unionByName(large), "many")
    has_many = not many.isEmpty()
    out = (packed.join(many, "grp", "left_anti") if has_many else packed).mapInArrow(partial(_unfold_batches, separator=separator), SCHEMA)
    if has_many:
        out = out.unionByName(_unfold_by_joins(rows.join(many, "grp", "left_semi"), separator).select(*out.columns))
    return out


def lockfile_graph(packages: DataFrame, edges: DataFrame, name_form=package_form) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of lockfiles: the union of dependency lists and edge rows, names in one spelling."""
    listed = packages.select(F.col("lockfile").alias("grp"), name_form(F.col("name")).alias("src"), F.explode("dependencies").alias("d")).select("grp", "src", name_form(F.col("d")).alias("dst"))
    rows = edges.select(F.col("lockfile").alias("grp"), name_form(F.col("src")).alias("src"), name_form(F.col("dst")).alias("dst"))
    nodes = packages.select(F.col("lockfile").alias("grp"), name_form(F.col("name")).alias("node"))
    return nodes, listed.unionByName(rows)


def lockfile_hierarchies(packages: DataFrame, edges: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """lockfile, name, root_name, depth, full_path, in_cycle, lo, size of every package."""
    h = hierarchies(*lockfile_graph(packages, edges), group_rows)
    return h.select(F.col("grp").alias("lockfile"), F.col("node").alias("name"), F.col("root").alias("root_name"), "depth", F.col("path").alias("full_path"), "in_cycle", "lo", "size")


def descendants(occurrences: DataFrame, group: str = "lockfile", cells: int = 16) -> DataFrame:
    """Pairs (ancestor, descendant) of occurrences by their ranges.

    A range join without a cross join: every range is cut into the blocks of a 16-ary tree that cover it,
    every point has one block per level, and equal blocks meet.
    """
    occ = occurrences.where("lo is not null").select(F.col(group).alias("g"), "name", "depth", "lo", "size")
    pairs = _range_pairs(occ, cells, ("depth",)).withColumn("distance", F.col("p_depth") - F.col("a_depth"))
    return pairs.select(F.col("g").alias(group), "ancestor", "descendant", "distance").distinct()


def _range_pairs(occ: DataFrame, cells: int = 16, more: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """g, ancestor, a, descendant, p and the columns ``more`` of both (a_, p_): ranges and the places in them, with ``own`` a range's own place too."""
    steps = 15
    top = occ.select(
        "g", F.col("name").alias("ancestor"), F.col("lo").alias("a"), (F.col("lo") + F.col("size")).alias("b"), *[F.col(c).alias(f"a_{c}") for c in more],
        # the smallest level whose block width is at least the range's size
        F.least(F.ceil(F.log2(F.greatest(F.col("size"), F.lit(1))) / math.log2(cells)), F.lit(steps)).cast("int").alias("level"),
    )
    width = F.pow(F.lit(float(cells)), F.col("level")).cast("long")
    blocks = top.select("*", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))).alias("block"))
    levels = top.select("g", "level").distinct()
    points = occ.select("g", F.col("name").alias("descendant"), F.col("lo").alias("p"), *[F.col(c).alias(f"p_{c}") for c in more]).join(levels, "g")
    points = points.withColumn("block", F.floor(F.col("p") / F.pow(F.lit(float(cells)), F.col("level")).cast("long")))
    return blocks.join(points, ["g", "level", "block"]).where((F.col("p") >= F.col("a") if own else F.col("p") > F.col("a")) & (F.col("p") < F.col("b")))


# ---------------------------------------------------------------- descendants of every node


def _reached(children: dict[str, list[str]], starts: list[str]) -> set[str]:
    seen, todo = set(starts), list(starts)
    while todo:
        for c in children[todo.pop()]:
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


def _longest(start: str, inside: dict[str, list[str]], beyond: dict[str, int]) -> int:
    """Longest way from ``start`` that repeats no node of its component, and on from where it leaves it."""
    best, path, on_path = beyond[start], [start], {start}
    stack = [iter(inside[start])]
    while stack:
        child = next((c for c in stack[-1] if c not in on_path), None)
        if child is None:
            stack.pop()
            on_path.discard(path.pop())
            continue
        path.append(child)
        on_path.add(child)
        stack.append(iter(inside[child]))
        best = max(best, len(path) - 1 + beyond[child])
    return best


def search_down(links: list[tuple[str, str | None]], wanted: list[str]) -> Iterator[tuple[str, int, int]]:
    """(node, n_descendants, height) of the ``wanted`` nodes that have descendants.

    A way down leaves a component at most once, so heights are put together from the components reached; only
    inside a component are its ways enumerated.
    """
    children: dict[str, list[str]] = {}
    for src, dst in links:
        children.setdefault(src, [])
        if dst is not None and dst != src:
            children[src].append(dst)
            children.setdefault(dst, [])
    asked, height = set(wanted), {}
    for part in reversed(list(components(children, _reached(children, wanted)))):
        within = set(part)
        inside = {n: [c for c in children[n] if c in within] for n in part}
        beyond = {n: max((1 + height[c] for c in children[n] if c not in within), default=0) for n in part}
        for n in part:
            height[n] = _longest(n, inside, beyond)
        if asked & within:
            n_below = len(_reached(children, part)) - 1
            for n in asked & within if n_below else ():
                yield n, n_below, height[n]


def _search_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(grp, *row) for grp, links, wanted in zip(pdf["grp"], pdf["links"], pdf["wanted"], strict=True) for row in search_down([(x["src"], x["dst"]) for x in links], list(wanted))]
        yield pd.DataFrame(rows, columns=["grp", "node", "n_descendants", "height"])


def _search_by_joins(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``search_down`` for groups too large for a task, by one join per level."""
    edges = materialise(rows.where("dst is not null and src <> dst"), "edges")
    level, levels = wanted.select("grp", F.col("node").alias("start"), "node", F.array("node").alias("names")), []
    while True:
        level = level.join(edges, (level["grp"] == edges["grp"]) & (level["node"] == edges["src"])).drop(edges["grp"]).where("not array_contains(names, dst)")
        level = materialise(level.select("grp", "start", F.col("dst").alias("node"), F.array_append("names", F.col("dst")).alias("names")), "level")
        if level.isEmpty():
            break
        levels.append(level.select("grp", "start", "node", (F.size("names") - 1).alias("distance")))
    pairs = reduce(DataFrame.unionByName, levels, wanted.limit(0).select("grp", F.col("node").alias("start"), "node", F.lit(0).alias("distance")))
    return pairs.groupBy("grp", F.col("start").alias("node")).agg(F.countDistinct("node").alias("n_descendants"), F.max("distance").alias("height"))


def descendant_counts(nodes: DataFrame, edges: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """grp, node, n_descendants, height of every node that has descendants, itself not counted.

    ``height`` is the longest way down that repeats no node.  Ranges hold all descendants of nodes that a root
    reaches and that are on no cycle.  Nodes on a cycle miss those already on the path and nodes that no root
    reaches have no range; both are searched for in the links.
    """
    rows = materialise(graph_rows(nodes, edges), "links")
    h = materialise(hierarchies(nodes, edges, group_rows), "occurrences")
    rest = materialise(h.where("in_cycle = 1 or depth < 0").select("grp", "node").distinct(), "rest")
    pairs = descendants(h.withColumnRenamed("node", "name"), "grp").withColumnRenamed("ancestor", "node").join(rest, ["grp", "node"], "left_anti")
    out = pairs.groupBy("grp", "node").agg(F.countDistinct("descendant").alias("n_descendants"), F.max("distance").alias("height"))
    counts = rows.join(rest.select("grp").distinct(), "grp", "left_semi").groupBy("grp").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > group_rows).select("grp")
    has_large = not large.isEmpty()
    small = rest.join(large, "grp", "left_anti") if has_large else rest
    asked = small.groupBy("grp").agg(F.collect_list("node").alias("wanted"))
    packed = rows.join(asked.select("grp"), "grp", "left_semi").groupBy("grp").agg(F.collect_list(F.struct("src", "dst")).alias("links")).join(asked, "grp")
    out = out.unionByName(packed.mapInPandas(_search_batches, "grp string, node string, n_descendants long, height int"))
    if has_large:
        out = out.unionByName(_search_by_joins(rows.join(large, "grp", "left_semi"), rest.join(large, "grp", "left_semi")))
    return out
