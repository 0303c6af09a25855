"""Reachability, paths and permissions over edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from scanloom.workdir import materialise

# Relations that hand over control.
HIGH_RISK = ("dcsync", "genericall", "writeowner", "writedacl", "addmember", "assumerole", "impersonate", "owner")

#: Links of a group that one task searches; larger groups are joined.
GROUP_EDGES = 5_000
CHUNK = 50_000


def _search(links: list[dict], max_depth: int | None) -> Iterator[tuple]:
    """(src, dst, depth) of every pair, breadth first from each source."""
    after: dict[object, list] = {}
    for x in links:
        after.setdefault(x["src"], []).append(x["dst"])
    for start in after:
        seen, front, depth = set(), [start], 0
        while front and (max_depth is None or depth < max_depth):
            depth += 1
            nxt = []
            for n in front:
                for m in after.get(n, ()):
                    if m not in seen:
                        seen.add(m)
                        nxt.append(m)
                        yield start, m, depth
            front = nxt


def _closure_batches(batches: Iterator[pa.RecordBatch], keys: list[str], max_depth: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    frame = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        for *key, links in zip(*[b.column(k).to_pylist() for k in (*keys, "links")], strict=True):
            for pair in _search(links, max_depth):
                rows.append((*key, *pair))
                if len(rows) >= CHUNK:
                    yield frame()
                    rows = []
    if rows:
        yield frame()


def _closure_by_joins(edges: DataFrame, keys: list[str], max_depth: int | None) -> DataFrame:
    """Doubling.  After round n all pairs of up to 2^n links are known.

    A pair of between 2^n and 2^(n+1) links has a middle node at exactly 2^n from its source, so only the pairs of that
    very length are joined with the known ones; the middle is spread over the sources' hash where it is hot by the
    adaptive skew join.  Ends when no pair is that long, which cycles don't prevent.
    """
    known = materialise(edges.withColumn("depth", F.lit(1)), "closure")
    reach = 1
    while max_depth is None or reach < max_depth:
        ends = known.where(F.col("depth") == reach).select(*keys, "src", F.col("dst").alias("mid"))
        if ends.isEmpty():
            break
        on = known.select(*keys, F.col("src").alias("mid"), "dst", (F.col("depth") + reach).alias("depth"))
        longer = ends.join(on, [*keys, "mid"])
        if max_depth is not None:
            longer = longer.where(F.col("depth") <= max_depth)
        new = longer.groupBy(*keys, "src", "dst").agg(F.min("depth").alias("depth")).join(known, [*keys, "src", "dst"], "left_anti")
        known, reach = known.unionByName(materialise(new, "closure")), reach * 2
    return known


def closure(edges: DataFrame, keys: list[str], max_depth: int | None = None, group_edges: int = GROUP_EDGES) -> DataFrame:
    """keys, src, dst, depth: every pair that a path joins, with its least number of links.

    ``max_depth`` bounds the links where given.  Groups (by ``keys``) of up to ``group_edges`` links are searched
    breadth first, each in one task; larger ones by joins over all tasks.  Null ends are left out, repeated links count
    once, a node on a cycle reaches itself; empty tables give no rows.
    """
    edges = materialise(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct(), "links")
    large = edges.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > group_edges).select(*keys)
    has_large = not large.isEmpty()
    same = reduce(lambda a, b: a & b, [edges[k].eqNullSafe(large[k]) for k in keys])
    small = edges.join(large, same, "left_anti") if has_large else edges
    packed = small.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("links"))
    schema = StructType([*[edges.schema[k] for k in (*keys, "src", "dst")]]).add("depth", IntegerType())
    out = packed.mapInArrow(partial(_closure_batches, keys=keys, max_depth=max_depth, schema=to_arrow_schema(schema)), schema)
    if has_large:
        out = out.unionByName(_closure_by_joins(edges.join(large, same, "left_semi"), keys, max_depth))
    return out


def impact(closed: DataFrame, keys: list[str]) -> DataFrame:
    """Per node: how many nodes reach it (blast radius) and the longest of the least distances."""
    return closed.where("src <> dst").groupBy(*keys, F.col("dst").alias("node")).agg(F.countDistinct("src").alias("affected"), F.max("depth").alias("max_depth"))


def simple_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """keys, start, goal, path (array), relations: all paths (of at most ``max_depth`` edges where given) that repeat no node and stop at the first goal."""
    e = edges.select(*keys, "src", "dst", F.col("relation") if "relation" in edges.columns else F.lit("").alias("relation"))
    front = starts.select(*keys, F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"))
    goal = goals.select(*keys, F.col("node").alias("at"), F.lit(True).alias("is_goal"))
    found, depth = [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = front.join(e, [*[front[k] == e[k] for k in keys], front["at"] == e["src"]]).drop(*[e[k] for k in keys]).where("not array_contains(path, dst)")
        nxt = nxt.select(*keys, "start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"))
        nxt = materialise(nxt.join(goal, [*keys, "at"], "left"), "paths")
        if nxt.isEmpty():
            break
        found.append(nxt.where("is_goal").select(*keys, "start", F.col("at").alias("goal"), "path", "relations"))
        front = nxt.where("is_goal is null").drop("is_goal")
    empty = front.select(*keys, "start", F.col("at").alias("goal"), "path", "relations").limit(0)
    return reduce(DataFrame.unionByName, found, empty)


def escalation_paths(edges: DataFrame, starts: DataFrame, tier0: DataFrame, keys: list[str]) -> DataFrame:
    """Paths to the most privileged nodes with a score: 20 for each relation that hands over control, 5 for others, at most 100."""
    paths = simple_paths(edges, starts, tier0, keys)
    risk = F.aggregate("relations", F.lit(0), lambda acc, r: acc + F.when(F.lower(r).isin(*HIGH_RISK), 20).otherwise(5))
    return paths.withColumn("score", F.least(risk, F.lit(100)))


def simulate_removal(edges: DataFrame, starts: DataFrame, tier0: DataFrame, keys: list[str], removed: DataFrame) -> DataFrame:
    """keys, before, after, paths_removed: escalation paths with all edges and without those of ``removed`` (keys, src, dst, relation)."""
    count = lambda e, name: escalation_paths(e, starts, tier0, keys).groupBy(*keys).agg(F.count("*").alias(name))
    kept = edges.join(removed, [*keys, "src", "dst", "relation"], "left_anti")
    both = count(edges, "before").join(count(kept, "after"), keys, "left").fillna(0, ["after"])
    return both.withColumn("paths_removed", F.col("before") - F.col("after"))


def identity_graph(principals: DataFrame, edges: DataFrame) -> DataFrame:
    """item (node, edge), body: a graph's nodes and edges as JSON lines of the common attack-path format.

    ``principals``: id, kind, provider; ``edges``: src, dst, relation, permissions.  Edges without a known end are left out.
    """
    known = principals.select(F.col("id").alias("src")).distinct()
    good = edges.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi")
    nodes = principals.select(F.lit("node").alias("item"), F.to_json(F.struct("id", F.col("kind").alias("type"), "provider")).alias("body"))
    links = good.select(F.lit("edge").alias("item"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label"), F.array_sort(F.array_distinct("permissions")).alias("permissions"))).alias("body"))
    return nodes.unionByName(links)


def least_privilege(edges: DataFrame, usage: DataFrame) -> DataFrame:
    """Edges whose permissions were never used: source, target, remove."""
    used = usage.groupBy("source").agg(F.collect_set("permission").alias("used"))
    unused = F.array_sort(F.array_except("permissions", F.coalesce("used", F.array().cast("array<string>"))))
    return edges.join(used, "source", "left").withColumn("remove", unused).where(F.size("remove") > 0).select("source", "target", "remove")


def tree_depth(closed: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest of the least distances from a root, per group."""
    r = roots.select(*keys, F.col("node").alias("src"))
    return closed.join(r, [*keys, "src"], "left_semi").groupBy(*keys).agg(F.max("depth").alias("depth"))
