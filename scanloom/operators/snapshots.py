"""What changed between consecutive full snapshots.

The keys of a snapshot are bucketed into ranges of their hash, the ranges form a Merkle tree, trees of
consecutive snapshots are compared from the root down, and rows are compared only in leaves whose
digests differ.  Snapshots that are equal cost one comparison of two roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.functions.paths import path_form
from scanloom.operators import merkle
from scanloom.session import broadcast_if_small
from scanloom.workdir import materialise

#: Fixed order of severities.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

DAY = 86_400.0


def severity_rank(severity: Column) -> Column:
    """1 to 5, letter case ignored; null for null or unknown names."""
    name = F.upper(F.trim(severity))
    rank = F.when(name == SEVERITIES[0], 1)
    for n, s in enumerate(SEVERITIES[1:], 2):
        rank = rank.when(name == s, n)
    return rank


def previous_of(df: DataFrame, group: str, order: str, id_: str, width: float = DAY) -> DataFrame:
    """Adds ``prev``: the id before, by (order, id) within its group.

    No window holds a whole group: rows are ordered within (group, slice of ``width`` of the order
    column), and only the last id of each slice is passed on to the next slice that has any.
    """
    cut = df.withColumn("_slice", F.floor(F.col(order) / width))
    inner = cut.withColumn("prev", F.lag(id_).over(W.partitionBy(group, "_slice").orderBy(order, id_)))
    ends = cut.groupBy(group, "_slice").agg(F.max_by(id_, F.struct(order, id_)).alias("_last"))
    ends = ends.withColumn("_carry", F.lag("_last").over(W.partitionBy(group).orderBy("_slice"))).select(
        F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_carry"
    )
    return (
        inner.join(ends, (F.col(group) == F.col("_g")) & F.col("_slice").eqNullSafe(F.col("_s")), "left")
        .withColumn("prev", F.coalesce("prev", "_carry"))
        .drop("_slice", "_g", "_s", "_carry")
    )


def snapshot_changes(scans: DataFrame, findings: DataFrame, leaf_rows: int = merkle.LEAF_ROWS) -> DataFrame:
    """Changes of each snapshot against its target's snapshot before it.

    ``scans``: id, target, scan_timestamp; ``findings``: scan_id, rule_id, file_path, line_number,
    severity, confidence, line_content, delivered_at; other columns are ignored, whatever their names.
    Returns scan_id, change_kind (new, resolved, regression, changed), rule_id, file_path, line_number.

    Defined results: repeated scans count once; scans without target or id are dropped; a null timestamp
    comes first; ties of timestamps go by id; findings of no known scan are dropped; a null line is 0; of
    rows of one key the one delivered last counts, a null delivery being the earliest; null values equal
    each other; letter case of severities is ignored, and an unknown severity is no regression.  Empty
    tables give no rows.
    """
    scans = scans.select("id", "target", "scan_timestamp").where("id is not null and target is not null").dropDuplicates(["id", "target"])
    pairs = materialise(
        previous_of(scans, "target", "scan_timestamp", "id")
        .where("prev is not null")
        .select(F.col("id").alias("pair"), F.col("id").alias("cur"), "prev", "target"),
        "pairs",
    )
    n_pairs = pairs.count()
    sizes = findings.where("scan_id is not null").groupBy(F.col("scan_id").alias("coll")).agg(F.count("*").alias("n"))
    members = pairs.select("target", F.explode(F.array("cur", "prev")).alias("coll")).distinct()
    sized = members.join(sizes, "coll", "left").select("coll", "target", F.coalesce("n", F.lit(0)).alias("n"))
    depths = materialise(
        sized.join(sized.groupBy("target").agg(merkle.depth_column(F.max("n"), leaf_rows).alias("depth")), "target").select("coll", "depth"),
        "depths",
    )
    max_depth = depths.agg(F.max("depth")).first()[0] or 0

    line = F.coalesce(F.col("line_number"), F.lit(0)).cast("int")
    c1, c2 = merkle.digest(F.col("confidence"), F.col("line_content"))
    when = F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(-(1 << 62)))
    versions = (
        findings.select(
            F.col("scan_id").alias("coll"), "rule_id", path_form(F.col("file_path")).alias("file_path"), line.alias("line_number"),
            F.coalesce(severity_rank(F.col("severity")), F.lit(0)).alias("rank"), c1.alias("c1"), c2.alias("c2"), when.alias("at"),
        )
        .join(broadcast_if_small(depths, 2 * n_pairs, 24), "coll")
        .groupBy("coll", "depth", "rule_id", "file_path", "line_number")
        .agg(*[F.max_by(c, "at").alias(c) for c in ("rank", "c1", "c2")])
    )
    key = F.xxhash64("rule_id", "file_path", "line_number")
    rows = materialise(versions.withColumn("node", merkle.node_at(key, F.col("depth"))), "rows")

    h1, h2 = merkle.digest(*[F.col(c) for c in ("rule_id", "file_path", "line_number", "rank", "c1", "c2")])
    nodes = materialise(merkle.tree(merkle.leaves(rows.withColumns({"h1": h1, "h2": h2})), max_depth), "tree")
    dirty = merkle.differing_leaves(nodes, pairs.select("pair", "cur", "prev"), max_depth)
    wanted = dirty.select(
        "pair", "node", F.explode(F.array(F.struct(F.col("cur").alias("coll"), F.lit(True).alias("is_cur")), F.struct(F.col("prev").alias("coll"), F.lit(False).alias("is_cur")))).alias("side")
    ).select("pair", "node", "side.*")

    cur = F.col("is_cur")
    both = (
        rows.join(wanted, ["coll", "node"])
        .groupBy("pair", "rule_id", "file_path", "line_number")
        .agg(*[F.max(F.when(cur if side else ~cur, F.col(c))).alias(f"{c}_{side}") for c in ("rank", "c1", "c2") for side in (1, 0)])
    )
    same = F.lit(True)
    for c in ("rank", "c1", "c2"):
        same = same & (F.col(f"{c}_1") == F.col(f"{c}_0"))
    kind = (
        F.when(F.col("rank_0").isNull(), "new")
        .when(F.col("rank_1").isNull(), "resolved")
        .when((F.col("rank_0") > 0) & (F.col("rank_1") > F.col("rank_0")), "regression")
        .when(~same, "changed")
    )
    return (
        both.select(F.col("pair").alias("scan_id"), kind.alias("change_kind"), "rule_id", "file_path", "line_number")
        .where("change_kind is not null")
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """Per scan: how many new, resolved, regression and changed findings."""
    return changes.groupBy("scan_id").agg(
        *[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("new", "resolved", "regression", "changed")]
    )
