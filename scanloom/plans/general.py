"""Queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.operators import hierarchy, incremental, snapshots
from scanloom.session import table
from scanloom.workdir import work_path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "scans"), table(spark, d, "findings"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p1_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.lockfile_hierarchies(table(spark, d, "locked_packages"), table(spark, d, "dependency_edges"))
    return h.drop("lo", "size")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Per package and lockfile: its distinct descendants and the longest way down, by nested-set ranges where they hold all."""
    h = hierarchy.descendant_counts(*hierarchy.lockfile_graph(table(spark, d, "locked_packages"), table(spark, d, "dependency_edges")))
    return h.select(F.col("grp").alias("lockfile"), F.col("node").alias("name"), "n_descendants", "height")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unprocessed_files(table(spark, d, "source_files"), table(spark, d, "file_cache"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """What three runs of a store processed: the deliveries up to the middle day, a run that fails midway, all deliveries."""
    source = table(spark, d, "source_files")
    middle = source.agg(F.floor((F.min("batch_no") + F.max("batch_no")) / 2)).first()[0]
    store = incremental.IncrementalStore(spark, work_path(spark, "store"))
    first = incremental.current_versions(source.where(F.col("batch_no") <= F.lit(middle)))
    everything = incremental.current_versions(source)

    def failing(todo: DataFrame) -> DataFrame:
        raise RuntimeError("lost midway")

    store.run(first, "file_path", "content_hash", lambda todo: todo.withColumn("run", F.lit(1)))
    try:
        store.run(everything, "file_path", "content_hash", failing)
    except RuntimeError:
        store.run(everything, "file_path", "content_hash", lambda todo: todo.withColumn("run", F.lit(2)))
    return store.output().select("run", "file_path", "content_hash")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_descendants, p4_found, p4_runs)}

_PATH = "regexp_replace(replace({0}, '\\', '/'), '^(\\./+)+', '')"
_NAME = "translate(lower({0}), '_.', '--')"

_P1 = f"""
WITH s AS (SELECT DISTINCT id, target, scan_timestamp FROM scans WHERE id IS NOT NULL AND target IS NOT NULL),
pairs AS (SELECT id AS cur, lag(id) OVER (PARTITION BY target ORDER BY scan_timestamp, id) AS prev FROM s),
f AS (SELECT scan_id, rule_id, {_PATH.format('file_path')} AS file_path, coalesce(line_number, 0) AS line_number,
  CASE upper(severity) WHEN 'INFO' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'CRITICAL' THEN 5 ELSE 0 END AS r,
  confidence, line_content,
  row_number() OVER (PARTITION BY scan_id, rule_id, {_PATH.format('file_path')}, coalesce(line_number, 0) ORDER BY delivered_at DESC) AS k FROM findings),
v AS (SELECT * FROM f WHERE k = 1),
c AS (SELECT p.cur AS scan_id, v.* EXCLUDE (scan_id) FROM pairs p JOIN v ON v.scan_id = p.cur WHERE p.prev IS NOT NULL),
o AS (SELECT p.cur AS scan_id, v.* EXCLUDE (scan_id) FROM pairs p JOIN v ON v.scan_id = p.prev),
j AS (SELECT coalesce(c.scan_id, o.scan_id) AS scan_id, coalesce(c.rule_id, o.rule_id) AS rule_id, coalesce(c.file_path, o.file_path) AS file_path,
  coalesce(c.line_number, o.line_number)::INT AS line_number,
  CASE WHEN o.scan_id IS NULL THEN 'new' WHEN c.scan_id IS NULL THEN 'resolved' WHEN c.r > o.r AND o.r > 0 THEN 'regression'
    WHEN c.r <> o.r OR c.confidence IS DISTINCT FROM o.confidence OR c.line_content IS DISTINCT FROM o.line_content THEN 'changed' END AS change_kind
  FROM c FULL OUTER JOIN o ON c.scan_id = o.scan_id AND c.rule_id IS NOT DISTINCT FROM o.rule_id AND c.file_path IS NOT DISTINCT FROM o.file_path AND c.line_number = o.line_number)
"""

_P3 = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT lockfile, src, dst FROM (
    SELECT lockfile, {_NAME.format('name')} AS src, {_NAME.format('d')} AS dst FROM (SELECT lockfile, name, unnest(dependencies) AS d FROM locked_packages)
    UNION ALL SELECT lockfile, {_NAME.format('src')}, {_NAME.format('dst')} FROM dependency_edges) x
  WHERE lockfile IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL),
n AS (SELECT lockfile, src AS name FROM e UNION SELECT lockfile, dst FROM e UNION SELECT lockfile, {_NAME.format('name')} FROM locked_packages WHERE lockfile IS NOT NULL AND name IS NOT NULL),
r AS (SELECT n.lockfile, n.name FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lockfile = n.lockfile AND e.dst = n.name AND e.src <> n.name)),
p AS (SELECT lockfile, name, name AS root_name, 0 AS depth, [name] AS names FROM r
  UNION ALL SELECT p.lockfile, e.dst, p.root_name, p.depth + 1, list_append(p.names, e.dst) FROM p JOIN e ON e.lockfile = p.lockfile AND e.src = p.name AND NOT list_contains(p.names, e.dst)),
reach AS (SELECT lockfile, src, dst FROM e UNION SELECT reach.lockfile, reach.src, e.dst FROM reach JOIN e ON e.lockfile = reach.lockfile AND e.src = reach.dst),
c AS (SELECT DISTINCT lockfile, src AS name FROM reach WHERE src = dst)
"""

_VERSIONS = f"""SELECT file_path, content_hash FROM (SELECT {_PATH.format('file_path')} AS file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS content_hash, coalesce(is_deleted, false) AS gone,
    row_number() OVER (PARTITION BY {_PATH.format('file_path')} ORDER BY modified_at DESC, delivered_at DESC) AS k FROM source_files WHERE file_path IS NOT NULL{{0}}) WHERE k = 1 AND NOT gone"""

SQL = {
    "p4_runs": f"""WITH m AS (SELECT floor((min(batch_no) + max(batch_no)) / 2) AS n FROM source_files), a AS ({_VERSIONS.format(' AND batch_no <= (SELECT n FROM m)')}), b AS ({_VERSIONS.format('')})
SELECT 1::INT AS run, file_path, content_hash FROM a UNION ALL SELECT 2::INT, b.file_path, b.content_hash FROM b LEFT JOIN a USING (file_path) WHERE a.file_path IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash""",
    "p1_found": _P1 + "SELECT scan_id, change_kind, rule_id, file_path, line_number FROM j WHERE change_kind IS NOT NULL",
    "p1_counts": _P1
    + "SELECT scan_id, "
    + ", ".join(f"count(*) FILTER (change_kind = '{k}') AS n_{k}" for k in ("new", "resolved", "regression", "changed"))
    + " FROM j WHERE change_kind IS NOT NULL GROUP BY scan_id",
    "p3_found": _P3
    + """SELECT q.lockfile, q.name, q.root_name, q.depth::INT AS depth, q.full_path, (CASE WHEN c.name IS NULL THEN 0 ELSE 1 END)::INT AS in_cycle FROM (
  SELECT lockfile, name, root_name, depth, array_to_string(names, ' > ') AS full_path FROM p
  UNION ALL SELECT lockfile, name, '', -1, '' FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.lockfile = n.lockfile AND p.name = n.name)) q
  LEFT JOIN c ON c.lockfile = q.lockfile AND c.name = q.name""",
    "p3_descendants": _P3
    + """, w AS (SELECT lockfile, name AS ancestor, name AS here, [name] AS names FROM n
  UNION ALL SELECT w.lockfile, w.ancestor, e.dst, list_append(w.names, e.dst) FROM w JOIN e ON e.lockfile = w.lockfile AND e.src = w.here AND NOT list_contains(w.names, e.dst)),
  d AS (SELECT lockfile, src AS ancestor, count(*) AS n_descendants FROM reach WHERE src <> dst GROUP BY 1, 2)
  SELECT lockfile, ancestor AS name, any_value(d.n_descendants) AS n_descendants, max(len(names) - 1)::INT AS height FROM w JOIN d USING (lockfile, ancestor) GROUP BY 1, 2""",
    "p4_found": f"""
WITH s AS (SELECT {_PATH.format('file_path')} AS file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS content_hash, coalesce(is_deleted, false) AS gone,
    row_number() OVER (PARTITION BY {_PATH.format('file_path')} ORDER BY modified_at DESC, delivered_at DESC) AS k FROM source_files WHERE file_path IS NOT NULL),
c AS (SELECT {_PATH.format('file_path')} AS file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS content_hash,
    row_number() OVER (PARTITION BY {_PATH.format('file_path')} ORDER BY cached_at DESC, content_hash DESC) AS k FROM file_cache
    WHERE file_path IS NOT NULL AND CASE WHEN json_valid(vulns_json) THEN json_type(vulns_json) = 'ARRAY' ELSE false END)
SELECT s.file_path, s.content_hash FROM s LEFT JOIN c ON c.file_path = s.file_path AND c.k = 1
WHERE s.k = 1 AND NOT s.gone AND (c.file_path IS NULL OR c.content_hash IS DISTINCT FROM s.content_hash)""",
}
