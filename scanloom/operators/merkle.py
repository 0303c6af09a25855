"""Merkle trees over hash ranges of keys, as DataFrames.

A *collection* is a set of rows with one key each, named by a column ``coll``.  A key's 64-bit hash
is cut into 4-bit steps: the node of a key at level ``l`` is the hash's leading ``4*l`` bits, so a
tree has fan-out 16 and level 0 is the root.  ``depth`` is the level of a collection's leaves; it may
differ between collections, but collections that are compared must share it.

A leaf's digest is the xor of two independent 64-bit hashes of its rows (keys are unique in a
collection, so no two rows cancel), a parent's the xor of hashes of its children with their places.
Both are sums that partial aggregation forms before anything is shuffled, so a collection that holds
most rows is no hot group.  128 bits of digest are compared.

Null-safe: rows must have a non-null ``coll``; an empty collection has no nodes and differs from
every non-empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.workdir import materialise

FANOUT_BITS = 4
MAX_DEPTH = 12
#: Rows that a leaf should hold on average.
LEAF_ROWS = 32


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Leaf level for a collection of ``rows`` rows."""
    if rows <= leaf_rows:
        return 0
    return min(MAX_DEPTH, math.ceil(math.log2(rows / leaf_rows) / FANOUT_BITS))


def depth_column(rows: Column, leaf_rows: int = LEAF_ROWS) -> Column:
    steps = F.ceil(F.log2(F.greatest(rows, F.lit(1)) / F.lit(float(leaf_rows))) / FANOUT_BITS)
    return F.least(F.greatest(steps, F.lit(0)), F.lit(MAX_DEPTH)).cast("int")


def node_at(key_hash: Column, level: Column) -> Column:
    """Node of a key hash at ``level`` (a column; Java shifts by 64 are no-ops, hence the case)."""
    return F.when(level <= 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key_hash, (F.lit(64) - level * FANOUT_BITS).cast("int"))
    )


def digest(*parts: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the parts, nulls told apart from every value."""
    shown = [x for p in parts for x in (p.isNull(), p)]
    return F.xxhash64(*shown), F.xxhash64(F.lit("second"), *shown)


def leaves(rows: DataFrame) -> DataFrame:
    """``rows``: coll, depth, node (at depth), h1, h2 → one row per leaf."""
    return rows.groupBy("coll", "depth", "node").agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"))


def tree(leaf: DataFrame, max_depth: int) -> DataFrame:
    """All nodes: coll, depth, level, node, d1, d2.  ``max_depth`` is the largest depth there is."""
    levels = [leaf.where(F.col("depth") == max_depth).withColumn("level", F.lit(max_depth))]
    for level in range(max_depth - 1, -1, -1):
        a, b = digest(F.col("node"), F.col("d1"), F.col("d2"))
        parents = (
            levels[-1]
            .select("coll", "depth", F.call_function("shiftright", "node", F.lit(FANOUT_BITS)).alias("node"), a.alias("d1"), b.alias("d2"))
            .groupBy("coll", "depth", "node")
            .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
        )
        own = leaf.where(F.col("depth") == level)
        levels.append(parents.unionByName(own).withColumn("level", F.lit(level)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def differing_leaves(nodes: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """Leaves in which paired collections differ, found from the root down.

    ``nodes``: a tree (best a written table, as each level reads it); ``pairs``: pair, cur, prev.
    At each level only children of nodes that differ are compared; the differing nodes of a level are written, so no
    level is worked out twice, and the descent ends where none are left.  Returns pair, cur, prev, node.
    """
    sides = pairs.select("pair", F.col("cur").alias("coll"), F.lit(True).alias("is_cur")).unionByName(
        pairs.select("pair", F.col("prev").alias("coll"), F.lit(False).alias("is_cur"))
    )
    found, parents = None, None
    for level in range(max_depth + 1):
        at = nodes.where(F.col("level") == level).select("coll", "depth", "node", "d1", "d2").join(sides, "coll")
        if parents is not None:
            at = at.withColumn("parent", F.call_function("shiftright", "node", F.lit(FANOUT_BITS))).join(parents, ["pair", "parent"], "left_semi")
        side = lambda c, cur: F.max(F.when(F.col("is_cur") == cur, F.col(c))).alias(f"{c}_{int(cur)}")
        dirty = (
            at.groupBy("pair", "node")
            .agg(F.max("depth").alias("depth"), *[side(c, cur) for c in ("d1", "d2") for cur in (True, False)])
            .where(~(F.col("d1_1").eqNullSafe(F.col("d1_0")) & F.col("d2_1").eqNullSafe(F.col("d2_0"))))
            .select("pair", "node", "depth")
        )
        if level < max_depth:
            dirty = materialise(dirty, "dirty")
        leaf = dirty.where(F.col("depth") == level).select("pair", "node")
        found = leaf if found is None else found.unionByName(leaf)
        parents = dirty.where(F.col("depth") > level).select("pair", F.col("node").alias("parent"))
        if level < max_depth and parents.isEmpty():
            break
    return found.join(pairs, "pair").select("pair", "cur", "prev", "node")
