"""Queries over locked packages and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.functions.paths import package_form
from scanloom.functions.text import version_array
from scanloom.operators import baseline, deps, graph, hierarchy
from scanloom.session import table
from scanloom.sources import manifests


ECOSYSTEMS = ("cargo", "go", "npm", "pypi")


def _packages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "locked_packages").where("name is not null")
    return p.select("lockfile", package_form(F.col("name")).alias("name"), "version", "ecosystem", "integrity").distinct()


def _advisories(spark: SparkSession, d: str) -> DataFrame:
    """A package's highest locked version stands for the version that fixes older ones."""
    best = _packages(spark, d).where("version is not null").groupBy("name").agg(F.max_by("version", F.struct(version_array(F.col("version")), "version")).alias("fixed"))
    return best.select(F.col("name").alias("package"), F.concat(F.lit("OUTDATED-"), F.col("name")).alias("cve_id"), F.lit("MEDIUM").alias("severity"), "fixed")


def _outdated(spark: SparkSession, d: str) -> DataFrame:
    return deps.vulnerable(_packages(spark, d).select("lockfile", "name", "version", "ecosystem").distinct(), _advisories(spark, d))


def cve_match(spark: SparkSession, d: str) -> DataFrame:
    return _outdated(spark, d).select("lockfile", "name", "version", "cve_id", "fixed")


def version_compare(spark: SparkSession, d: str) -> DataFrame:
    v = _packages(spark, d).select("version").distinct()
    return v.select("version", *[version_array(F.col("version"))[n].alias(f"v{n}") for n in range(4)])


def dep_bump_plan(spark: SparkSession, d: str) -> DataFrame:
    return deps.bump_plan(_outdated(spark, d), ["lockfile"])


def vex_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Outdated packages that stay after statements that npm packages aren't affected."""
    found = _outdated(spark, d).withColumnRenamed("name", "package")
    vex = _packages(spark, d).select(F.concat(F.lit("OUTDATED-"), F.col("name")).alias("vulnerability"), F.col("name").alias("product"), F.col("ecosystem").alias("ord"), F.when(F.col("ecosystem") == "npm", "not_affected").otherwise("affected").alias("status"))
    kept, _ = baseline.suppress_by_vex(found, vex)
    return kept.select("lockfile", "package", "version", "cve_id")


def typosquat(spark: SparkSession, d: str) -> DataFrame:
    """Names one or two edits from a well-known name, or from one that several packages anywhere require."""
    p = _packages(spark, d).select("lockfile", "name", "ecosystem").distinct()
    common = _edges(spark, d).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    common = common.select(F.explode(F.array(*[F.lit(e) for e in ECOSYSTEMS])).alias("ecosystem"), "name", F.lit(1000).alias("ord"))
    return deps.typosquats(p, deps.popular_table(spark).unionByName(common))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Packages and lockfiles' targets named like private ones."""
    p = _packages(spark, d)
    names = p.select("name").union(p.select(F.substring_index("lockfile", "/", 1))).distinct()
    return names.select("name", deps.confusion_marker(F.col("name")).alias("marker")).where("marker is not null")


def pinning(spark: SparkSession, d: str) -> DataFrame:
    return manifests.missing_integrity(_packages(spark, d)).distinct()


def component_list(spark: SparkSession, d: str) -> DataFrame:
    p = _packages(spark, d).where("ecosystem is not null").withColumn("purl", deps.purl(F.col("ecosystem"), F.col("name"), F.col("version")))
    return p.groupBy("purl").agg(F.countDistinct("lockfile").alias("lockfiles"), F.max("integrity").alias("integrity"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    _, e = hierarchy.lockfile_graph(table(spark, d, "locked_packages"), table(spark, d, "dependency_edges"))
    return e.where("src is not null and dst is not null").select(F.col("grp").alias("lockfile"), "src", "dst").distinct()


def dep_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d), ["lockfile"])


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(graph.closure(_edges(spark, d), ["lockfile"]), ["lockfile"])


def tree_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    nodes = e.select("lockfile", F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = nodes.join(e.where("src <> dst").select("lockfile", F.col("dst").alias("node")), ["lockfile", "node"], "left_anti").groupBy("lockfile").agg(F.count("*").alias("roots"))
    return nodes.groupBy("lockfile").agg(F.count("*").alias("packages")).join(e.groupBy("lockfile").agg(F.count("*").alias("edges")), "lockfile").join(roots, "lockfile", "left").fillna(0, ["roots"])


def dep_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths from a lockfile's roots to packages that require nothing; a package that requires itself is no root."""
    e = _edges(spark, d)
    h = hierarchy.hierarchies(e.select(F.col("lockfile").alias("grp"), F.col("src").alias("node")), e.withColumnRenamed("lockfile", "grp"), separator=">")
    p = h.where("depth > 0").select(F.col("grp").alias("lockfile"), F.col("root").alias("start"), F.col("node").alias("goal"), "path")
    p = p.join(e.select("lockfile", F.col("src").alias("goal")).distinct(), ["lockfile", "goal"], "left_anti")
    return p.join(e.where("src = dst").select("lockfile", F.col("src").alias("start")), ["lockfile", "start"], "left_anti").select("lockfile", "start", "goal", "path")


QUERIES = {f.__name__: f for f in (cve_match, version_compare, dep_bump_plan, vex_suppress, typosquat, confusion, pinning, component_list, dep_closure, blast_radius, tree_summary, dep_paths)}

_N = "translate(lower({0}), '_.', '--')"
_V = lambda c: f"list_transform((list_transform(string_split(coalesce({c}, ''), '.')[:4], lambda p: coalesce(try_cast(regexp_replace(p, '[^0-9]', '', 'g') AS INT), 0)) || [0, 0, 0, 0])[:4], lambda x: x::INT)"
_PK = f"""WITH RECURSIVE pk AS (SELECT DISTINCT lockfile, {_N.format('name')} AS name, version, ecosystem, integrity FROM locked_packages WHERE name IS NOT NULL),
adv AS (SELECT name, version AS fixed FROM (SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY {_V('version')} DESC, version DESC) AS k FROM pk WHERE version IS NOT NULL) WHERE k = 1),
od AS (SELECT DISTINCT pk.lockfile, pk.name, pk.version, pk.ecosystem, 'OUTDATED-' || pk.name AS cve_id, adv.fixed FROM pk JOIN adv ON adv.name = pk.name WHERE {_V('pk.version')} < {_V('adv.fixed')})
"""
_E = f"""WITH RECURSIVE e AS (SELECT DISTINCT lockfile, src, dst FROM (
  SELECT lockfile, {_N.format('name')} AS src, {_N.format('d')} AS dst FROM (SELECT lockfile, name, unnest(dependencies) AS d FROM locked_packages)
  UNION ALL SELECT lockfile, {_N.format('src')}, {_N.format('dst')} FROM dependency_edges) x WHERE src IS NOT NULL AND dst IS NOT NULL),
longest AS (SELECT max(n) AS n FROM (SELECT count(DISTINCT src) AS n FROM e GROUP BY lockfile)),
c AS (SELECT lockfile, src, dst, 1 AS depth FROM e UNION SELECT c.lockfile, c.src, e.dst, c.depth + 1 FROM c JOIN e ON e.lockfile = c.lockfile AND e.src = c.dst WHERE c.depth < (SELECT n FROM longest)),
cl AS (SELECT lockfile, src, dst, min(depth)::INT AS depth FROM c GROUP BY 1, 2, 3)
"""
_NAMES = "(SELECT DISTINCT name FROM pk)"

SQL = {
    "cve_match": _PK + "SELECT lockfile, name, version, cve_id, fixed FROM od",
    "version_compare": _PK + f"SELECT version, v[1] AS v0, v[2] AS v1, v[3] AS v2, v[4] AS v3 FROM (SELECT DISTINCT version, {_V('version')} AS v FROM pk)",
    "dep_bump_plan": _PK + "SELECT lockfile, name, max(fixed) AS target, string_agg(DISTINCT cve_id, ',') AS cves FROM od GROUP BY 1, 2",
    "vex_suppress": _PK + ", st AS (SELECT name, CASE WHEN min(ecosystem) = 'npm' THEN 'not_affected' ELSE 'affected' END AS s FROM pk GROUP BY 1) SELECT lockfile, od.name AS package, version, cve_id FROM od JOIN st USING (name) WHERE s = 'affected'",
    "typosquat": _E + f""", pk AS (SELECT DISTINCT lockfile, {_N.format('name')} AS name, version, ecosystem FROM locked_packages WHERE name IS NOT NULL),
pe AS (SELECT DISTINCT lockfile, name, ecosystem FROM pk WHERE ecosystem IS NOT NULL),
pop AS (SELECT unnest([{', '.join(f"'{e}'" for e in ECOSYSTEMS)}]) AS ecosystem, dst AS popular, 1000 AS ord FROM (SELECT dst FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT * FROM (VALUES {', '.join(f"('{e}', '{n}', {i})" for e, ns in deps.POPULAR.items() for i, n in enumerate(ns))})),
x AS (SELECT n.ecosystem, n.name, popular, ord, levenshtein(n.name, popular) AS distance FROM (SELECT DISTINCT ecosystem, name FROM pe) n JOIN pop USING (ecosystem)),
y AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY distance, ord, popular) AS k FROM x WHERE distance <= 2) SELECT ecosystem, name, popular, distance::INT AS distance FROM y WHERE k = 1 AND distance > 0""",
    "confusion": _PK + f""", nm AS (SELECT name FROM pk UNION SELECT string_split(lockfile, '/')[1] FROM pk)
SELECT name, CASE {' '.join(f"WHEN contains(lower(name), '{m}') THEN '{m}'" for m in deps.PRIVATE_MARKERS)} END AS marker FROM nm WHERE NOT (starts_with(name, '@') AND NOT contains(name, '/')) AND regexp_matches(lower(name), '{'|'.join(deps.PRIVATE_MARKERS)}')""",
    "pinning": _PK + "SELECT DISTINCT lockfile, name, version FROM pk WHERE integrity IS NULL OR trim(integrity) = ''",
    "component_list": _PK + "SELECT 'pkg:' || ecosystem || '/' || name || CASE WHEN coalesce(version, '') <> '' THEN '@' || version ELSE '' END AS purl, count(DISTINCT lockfile) AS lockfiles, max(integrity) AS integrity FROM pk WHERE ecosystem IS NOT NULL GROUP BY 1",
    "dep_closure": _E + "SELECT lockfile, src, dst, depth FROM cl",
    "blast_radius": _E + "SELECT lockfile, dst AS node, count(DISTINCT src) AS affected, max(depth) AS max_depth FROM cl WHERE src <> dst GROUP BY 1, 2",
    "tree_summary": _E + """, n AS (SELECT lockfile, src AS node FROM e UNION SELECT lockfile, dst FROM e), r AS (SELECT lockfile, count(*) AS roots FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lockfile = n.lockfile AND e.dst = n.node AND e.src <> e.dst) GROUP BY 1)
SELECT a.lockfile, a.packages, b.edges, coalesce(r.roots, 0) AS roots FROM (SELECT lockfile, count(*) AS packages FROM n GROUP BY 1) a JOIN (SELECT lockfile, count(*) AS edges FROM e GROUP BY 1) b USING (lockfile) LEFT JOIN r USING (lockfile)""",
    "dep_paths": _E + """, s AS (SELECT DISTINCT lockfile, src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.lockfile = e.lockfile AND f.dst = e.src)), g AS (SELECT DISTINCT lockfile, dst AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.lockfile = e.lockfile AND f.src = e.dst)),
p AS (SELECT lockfile, node AS start, node AS here, [node] AS path, 0 AS n FROM s UNION ALL SELECT p.lockfile, p.start, e.dst, list_append(p.path, e.dst), n + 1 FROM p JOIN e ON e.lockfile = p.lockfile AND e.src = p.here WHERE NOT list_contains(p.path, e.dst))
SELECT p.lockfile, start, here AS goal, array_to_string(path, '>') AS path FROM p JOIN g ON g.lockfile = p.lockfile AND g.node = p.here WHERE n > 0""",
}
