"""Queries over findings, scans and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.functions.paths import path_form
from scanloom.operators import baseline, callees, reports, rules
from scanloom.operators.snapshots import SEVERITIES
from scanloom.session import spread, table

PATH = "regexp_replace(replace({0}, '\\', '/'), '^(\\./+)+', '')"
_P = PATH.format("file_path")
RANK = "CASE upper(trim(severity)) " + " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(SEVERITIES, 1)) + " END"

#: Current findings in SQL, as ``reports.current_findings`` has them.
CURRENT = f"""WITH cf AS (SELECT * EXCLUDE (k) FROM (
  SELECT * REPLACE (upper(trim(severity)) AS severity, upper(trim(confidence)) AS confidence, {_P} AS file_path, coalesce(line_number, 0) AS line_number, {RANK} AS severity_rank),
    row_number() OVER (PARTITION BY scan_id, rule_id, {_P}, coalesce(line_number, 0) ORDER BY delivered_at DESC NULLS LAST, row_id DESC) AS k FROM findings) WHERE k = 1)
"""
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in reversed(SEVERITIES))


def _current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current findings with their key and the given columns alone."""
    return reports.current_findings(table(spark, d, "findings"), list(columns))


def _source_lines(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings")
    return spread(f.select("row_id", path_form(F.col("file_path")).alias("file_path"), "language", F.col("line_content").alias("line")).where("line is not null"))


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """The rule engine over all source lines kept in findings."""
    hits = rules.match_lines(_source_lines(spark, d))
    return hits.join(F.broadcast(rules.rule_table(spark)), "ord").select("row_id", "rule_id", "severity", "category")


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    hits = rules.match_lines(_source_lines(spark, d)).groupBy("ord").agg(F.count("*").alias("hits"), F.countDistinct("file_path").alias("files"))
    return hits.join(F.broadcast(rules.rule_table(spark)), "ord").select("rule_id", "severity", "category", "hits", "files")


def call_findings(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of dangerous calls over all source lines kept in findings."""
    return callees.match_calls(_source_lines(spark, d)).select("row_id", "rule_id", "category", "severity")


def call_report(spark: SparkSession, d: str) -> DataFrame:
    return callees.match_calls(_source_lines(spark, d)).groupBy("category", "severity").agg(F.count("*").alias("hits"), F.countDistinct("file_path").alias("files"))


def _call_sql() -> str:
    rows = []
    for language, families in callees.CALLS.items():
        for family, names in families.items():
            for lang in (language, *{"JavaScript": ["TypeScript"], "C": ["C++"]}.get(language, [])):
                rows += [f"({_quote(lang)}, {_quote(n)}, {_quote(f'CALL-{language}-{family}-{n}')}, {_quote(callees.FAMILIES[family][0])}, {_quote(callees.FAMILIES[family][1])})" for n in names.split()]
    return f"""WITH cat AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(language, callee, rule_id, category, severity)),
nm AS (SELECT row_id, {_P} AS file_path, language, string_split(unnest(regexp_extract_all(line_content, {_quote(callees.CALLED)}, 1)), '.') AS p FROM findings WHERE line_content IS NOT NULL AND language IS NOT NULL),
ends AS (SELECT DISTINCT row_id, file_path, language, array_to_string(p[k:], '.') AS callee FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM nm)),
hit AS (SELECT row_id, file_path, rule_id, category, severity FROM ends JOIN cat USING (language, callee)) """


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql() -> str:
    parts = []
    for r in rules.RULES:
        cond = f"regexp_matches(line_content, {_quote(r.pattern)})"
        if r.negative:
            cond += f" AND NOT regexp_matches(line_content, {_quote(r.negative)})"
        if r.language != "*":
            langs = [r.language, "TypeScript"] if r.language == "JavaScript" else [r.language]
            cond += " AND language IN (" + ", ".join(map(_quote, langs)) + ")"
        parts.append(f"SELECT row_id, {_P} AS file_path, {_quote(r.id)} AS rule_id, {_quote(r.severity)} AS severity, {_quote(r.category)} AS category FROM findings WHERE length(line_content) BETWEEN 1 AND {rules.MAX_LINE} AND {cond}")
    return " UNION ALL ".join(parts)


def report_by_scan(spark: SparkSession, d: str) -> DataFrame:
    return reports.scan_report(_current(spark, d, "severity"), ["scan_id"])


def dedup_findings(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d, "row_id", "severity").select("row_id", "scan_id", "rule_id", "file_path", "line_number", "severity")


def min_severity(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d, "row_id", "severity", "severity_rank").where("severity_rank >= 4").select("row_id", "severity", "rule_id")


_OVERRIDES = {"KEY-100": "CRITICAL", "ERR-144": "INFO", "XSS-137": "LOW"}


def severity_override(spark: SparkSession, d: str) -> DataFrame:
    over = reports.weigh(F.col("rule_id"), _OVERRIDES, "")
    f = _current(spark, d, "severity").withColumn("severity", F.when(over == "", F.col("severity")).otherwise(over))
    return f.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def global_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Findings left after suppressing two rules everywhere and one in the files of a name."""
    off = spark.createDataFrame([("ERR-144", None), ("XSS-137", None), ("KEY-100", "main.py"), ("KEY-100", "index.js")], "rule_id string, file_name string")
    left = rules.suppress_globally(_current(spark, d), off)
    return left.groupBy("rule_id").agg(F.count("*").alias("n"))


def flat_sort(spark: SparkSession, d: str) -> DataFrame:
    """The 100 worst findings (a top-k report)."""
    return _current(spark, d, "severity", "severity_rank").orderBy(F.desc("severity_rank"), "file_path", "line_number", "rule_id", "scan_id").select("scan_id", "rule_id", "file_path", "line_number", "severity").limit(100)


def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_k(_current(spark, d, "category"), "category", 8)


def top_rules_per_language(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_k_per(_current(spark, d, "language").where("language is not null"), "language", "rule_id", 3)


def severity_pivot_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return reports.heatmap(_current(spark, d, "severity"))


def risk_grade(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "scans").groupBy(F.col("id").alias("scan_id")).agg(F.max("files_scanned").alias("files_scanned"))
    return reports.risk_grade(_current(spark, d, "severity", "confidence"), scans, "scan_id")


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return reports.quality_gate(_current(spark, d, "severity"), "scan_id", max_critical=2, max_high=10, max_total=200)


def longitudinal_delta(spark: SparkSession, d: str) -> DataFrame:
    return reports.longitudinal(table(spark, d, "scans"))


def trend_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 scans (a top-k report)."""
    s = table(spark, d, "scans").dropDuplicates(["id"])
    return s.orderBy(F.desc("scan_timestamp"), F.desc("id")).select("id", "target", "scan_timestamp", "total_vulns").limit(20)


def compliance_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.compliance_report(_current(spark, d, "cwe"), reports.controls(spark))


def compliance_score(spark: SparkSession, d: str) -> DataFrame:
    return reports.compliance_score(compliance_report(spark, d))


def compliance_map(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d, "row_id", "cwe").join(F.broadcast(reports.controls(spark)), "cwe").select("row_id", "framework", "control")


def risk_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.risk_rank(_current(spark, d, "severity", "confidence"), digits=6).groupBy("priority", "score").agg(F.count("*").alias("n"))


def finding_features(spark: SparkSession, d: str) -> DataFrame:
    f = _current(spark, d, "row_id", "severity", "confidence", "in_comment").select("row_id", reports.feature_vector().alias("f"))
    return f.select("row_id", *[F.col("f")[n].alias(f"f{n}") for n in range(len(reports.FEATURES))])


def _edges_of_history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings of each target's last and first scan; scans without target are left out."""
    s = table(spark, d, "scans").where("target is not null").dropDuplicates(["id"])
    at = F.struct("scan_timestamp", "id")
    ends = s.groupBy("target").agg(F.max_by("id", at).alias("last"), F.min_by("id", at).alias("first"))
    f = _current(spark, d, "severity_rank")
    return f.join(ends.select(F.col("last").alias("scan_id")), "scan_id", "left_semi"), f.join(ends.where("first <> last").select(F.col("first").alias("scan_id")), "scan_id", "left_semi")


def baseline_status(spark: SparkSession, d: str) -> DataFrame:
    return baseline.baseline_diff(*_edges_of_history(spark, d))


def _baseline(status: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return baseline_status(spark, d).where(F.col("status") == status).drop("status")

    return query


def drift(spark: SparkSession, d: str) -> DataFrame:
    """Files' first and last delivered versions as desired and actual resources."""
    f = table(spark, d, "source_files").where("file_path is not null").withColumn("id", path_form(F.col("file_path")))
    attributes = F.create_map(F.lit("hash"), F.regexp_replace(F.lower("content_hash"), "^sha256:", ""), F.lit("size"), F.col("size_bytes").cast("string"))
    at = F.struct("modified_at", "delivered_at", "batch_no")
    ends = f.withColumn("a", F.struct(attributes.alias("attributes"), F.coalesce("is_deleted", F.lit(False)).alias("gone"))).groupBy("id").agg(F.min_by("a", at).alias("first"), F.max_by("a", at).alias("last"))
    return baseline.drift(ends.where("not first.gone").select("id", "first.attributes"), ends.where("not last.gone").select("id", "last.attributes"))


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "scan_results").where("file_path is not null").select(path_form(F.col("file_path")).alias("file_path")).distinct()
    return p.select("file_path", rules.detect_language(F.col("file_path")).alias("detected"))


def scannable_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "scan_results").where("file_path is not null").select(path_form(F.col("file_path")).alias("file_path")).distinct()
    return p.where(rules.is_scannable(F.col("file_path")))


def _language_sql() -> str:
    ext = "lower(regexp_extract(base, '^.+\\.([^.]+)$', 1))"
    cases = [f"WHEN {ext} IN ({', '.join(map(_quote, rules.BINARY_EXTENSIONS))}) THEN 'Unknown'"]
    cases += [f"WHEN lower(base) = {_quote(n)} THEN {_quote(v)}" for n, v in rules.SPECIAL_NAMES.items()]
    cases += [f"WHEN {ext} IN ({', '.join(map(_quote, e.split()))}) THEN {_quote(v)}" for v, e in rules.LANGUAGES.items()]
    return "CASE " + " ".join(cases) + " ELSE 'Unknown' END"


_PATHS = f"(SELECT DISTINCT {_P} AS file_path, string_split({_P}, '/')[-1] AS base FROM scan_results WHERE file_path IS NOT NULL)"
_WEIGHT = lambda col, t, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {d} END"
_CONTROLS = "(VALUES " + ", ".join(f"({_quote(f)}, {_quote(c)}, {_quote(w)})" for f, cs in reports.FRAMEWORKS.items() for c, ws in cs.items() for w in ws) + ") AS t(framework, control, cwe)"
_COMPLIANCE = CURRENT + f", ct AS (SELECT * FROM {_CONTROLS}), h AS (SELECT framework, control, count(*) AS n FROM cf JOIN ct USING (cwe) GROUP BY 1, 2), rep AS (SELECT DISTINCT ct.framework, ct.control, coalesce(h.n, 0) AS findings, CASE WHEN h.n IS NULL THEN 'pass' ELSE 'fail' END AS status FROM ct LEFT JOIN h USING (framework, control)) "
_GRADE = "CASE " + " ".join(f"WHEN s <= {x} THEN '{g}'" for x, g in reports.GRADE_LIMITS) + " ELSE 'F' END"
_PENALTY = f"({_WEIGHT('severity', reports.GRADE_SEVERITY, 0.1)})::DOUBLE * ({_WEIGHT('confidence', reports.GRADE_CONFIDENCE, 0.6)})::DOUBLE"
_ENDS = CURRENT + f""", s AS (SELECT DISTINCT ON (id) id, target, scan_timestamp FROM scans WHERE target IS NOT NULL),
e AS (SELECT target, arg_max(id, (scan_timestamp, id)) AS l, arg_min(id, (scan_timestamp, id)) AS f FROM s GROUP BY target),
k AS (SELECT coalesce(rule_id, '') AS rule_id, coalesce(file_path, '') AS file_path, line_number, severity_rank, scan_id FROM cf),
a AS (SELECT rule_id, file_path, line_number, max(severity_rank) AS r FROM k WHERE scan_id IN (SELECT l FROM e) GROUP BY 1, 2, 3),
b AS (SELECT rule_id, file_path, line_number, max(severity_rank) AS r FROM k WHERE scan_id IN (SELECT f FROM e WHERE f <> l) GROUP BY 1, 2, 3),
st AS (SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.line_number, b.line_number) AS line_number,
  CASE WHEN b.rule_id IS NULL THEN 'new' WHEN a.rule_id IS NULL THEN 'resolved' WHEN coalesce(a.r, 0) > coalesce(b.r, 0) THEN 'regression' ELSE 'unchanged' END AS status
  FROM a FULL OUTER JOIN b USING (rule_id, file_path, line_number)) """

QUERIES = {
    f.__name__: f
    for f in (
        scan_findings, scan_report, call_findings, call_report, report_by_scan, dedup_findings, min_severity, severity_override, global_suppress, flat_sort, top_categories, top_rules_per_language, severity_pivot_heatmap, risk_grade,
        quality_gate, longitudinal_delta, trend_history, compliance_report, compliance_score, compliance_map, risk_rank, finding_features, baseline_status, drift, detect_language, scannable_paths,
    )
} | {f"baseline_{s}": _baseline(s) for s in ("new", "resolved", "regression", "unchanged")}

SQL = {
    "scan_findings": f"SELECT row_id, rule_id, severity, category FROM ({_rule_sql()})",
    "scan_report": f"SELECT rule_id, severity, category, count(*) AS hits, count(DISTINCT file_path) AS files FROM ({_rule_sql()}) GROUP BY 1, 2, 3",
    "call_findings": _call_sql() + "SELECT row_id, rule_id, category, severity FROM hit",
    "call_report": _call_sql() + "SELECT category, severity, count(*) AS hits, count(DISTINCT file_path) AS files FROM hit GROUP BY 1, 2",
    "report_by_scan": CURRENT + f"SELECT scan_id, count(*) AS total, {_COUNTS}, count(DISTINCT file_path) AS files_with_issues, count(DISTINCT rule_id) AS rules FROM cf GROUP BY scan_id",
    "dedup_findings": CURRENT + "SELECT row_id, scan_id, rule_id, file_path, line_number, severity FROM cf",
    "min_severity": CURRENT + "SELECT row_id, severity, rule_id FROM cf WHERE severity_rank >= 4",
    "severity_override": CURRENT + f"SELECT rule_id, {_WEIGHT('rule_id', {k: _quote(v) for k, v in _OVERRIDES.items()}, 'severity')} AS severity, count(*) AS n FROM cf GROUP BY 1, 2",
    "global_suppress": CURRENT + "SELECT rule_id, count(*) AS n FROM cf WHERE rule_id NOT IN ('ERR-144', 'XSS-137') AND NOT (rule_id = 'KEY-100' AND string_split(file_path, '/')[-1] IN ('main.py', 'index.js')) GROUP BY 1",
    "flat_sort": CURRENT + "SELECT scan_id, rule_id, file_path, line_number, severity FROM cf ORDER BY severity_rank DESC NULLS LAST, file_path, line_number, rule_id, scan_id LIMIT 100",
    "top_categories": CURRENT + "SELECT category, count(*) AS n FROM cf WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 8",
    "top_rules_per_language": CURRENT + "SELECT * FROM (SELECT language, rule_id, count(*) AS n, (row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, rule_id))::INT AS rank FROM cf WHERE language IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3",
    "severity_pivot_heatmap": CURRENT + f"SELECT *, critical * 10 + high * 5 + medium * 2 + low AS risk FROM (SELECT file_path, {_COUNTS} FROM cf GROUP BY 1)",
    "risk_grade": CURRENT + f""", f AS (SELECT id AS scan_id, max(files_scanned) AS n FROM scans GROUP BY 1), p AS (SELECT scan_id, sum(round({_PENALTY} * 1000)::BIGINT) AS m FROM cf GROUP BY 1),
q AS (SELECT scan_id, coalesce(m, 0) / 1000.0 AS pen, (coalesce(m, 0) / 1000.0)::DOUBLE / greatest(coalesce(n, 1), 1) AS s FROM f LEFT JOIN p USING (scan_id))
SELECT scan_id, pen::DOUBLE AS penalty_total, round(s, 6) AS score, {_GRADE} AS grade FROM q""",
    "quality_gate": CURRENT + """, q AS (SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM cf GROUP BY 1)
SELECT scan_id, total, critical, high, (critical <= 2 AND high <= 10 AND total <= 200) AS passed, concat_ws(',', CASE WHEN critical > 2 THEN 'critical' END, CASE WHEN high > 10 THEN 'high' END, CASE WHEN total > 200 THEN 'total' END) AS failures FROM q""",
    "longitudinal_delta": """WITH s AS (SELECT DISTINCT ON (id, target) id, target, scan_timestamp, total_vulns FROM scans),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY scan_timestamp, id) AS a, row_number() OVER (PARTITION BY target ORDER BY scan_timestamp DESC, id DESC) AS z FROM s)
SELECT target, count(*) AS n_scans, max(total_vulns) FILTER (a = 1) AS first_total, max(total_vulns) FILTER (z = 1) AS last_total, max(total_vulns) FILTER (z = 1) - max(total_vulns) FILTER (a = 1) AS delta FROM r GROUP BY target""",
    "trend_history": "SELECT DISTINCT id, target, scan_timestamp, total_vulns FROM scans ORDER BY scan_timestamp DESC, id DESC LIMIT 20",
    "compliance_report": _COMPLIANCE + "SELECT framework, control, findings, status FROM rep",
    "compliance_score": _COMPLIANCE + "SELECT framework, count(*) AS controls, count(*) FILTER (status = 'pass') AS passed, round(avg(CASE status WHEN 'pass' THEN 1.0 ELSE 0.0 END) * 100, 2) AS score FROM rep GROUP BY 1",
    "compliance_map": CURRENT + f"SELECT row_id, framework, control FROM cf JOIN (SELECT * FROM {_CONTROLS}) USING (cwe)",
    "risk_rank": CURRENT + f"""SELECT CASE WHEN score >= 75 THEN 'P0' WHEN score >= 50 THEN 'P1' WHEN score >= 25 THEN 'P2' ELSE 'P3' END AS priority, score, count(*) AS n FROM (
SELECT round(least(({_WEIGHT('severity', reports.RANK_SEVERITY, 30)})::DOUBLE * ({_WEIGHT('confidence', reports.RANK_CONFIDENCE, 0.65)})::DOUBLE * 1.0::DOUBLE * 0.7::DOUBLE * 0.5::DOUBLE * 0.75::DOUBLE, 100.0), 6) AS score FROM cf) GROUP BY 1, 2""",
    "finding_features": CURRENT + f"""SELECT row_id, ({_WEIGHT('confidence', reports.FEATURE_CONFIDENCE, 0.5)})::DOUBLE AS f0, ({_WEIGHT('severity', reports.FEATURE_SEVERITY, 0.3)})::DOUBLE AS f1,
CASE WHEN regexp_matches(lower(file_path), '(^|/)tests?/|_test\\.|\\.test\\.|\\.spec\\.') THEN 1.0 ELSE 0.0 END::DOUBLE AS f3, CASE WHEN coalesce(in_comment, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS f4,
0.0::DOUBLE AS f2, 0.0::DOUBLE AS f5, 0.5::DOUBLE AS f6, 0.0::DOUBLE AS f7, 0.5::DOUBLE AS f8 FROM cf""",
    "baseline_status": _ENDS + "SELECT rule_id, file_path, line_number, status FROM st",
    "drift": f"""WITH v AS (SELECT {_P} AS id, regexp_replace(lower(content_hash), '^sha256:', '') AS h, size_bytes AS z, coalesce(is_deleted, false) AS gone,
  row_number() OVER (PARTITION BY {_P} ORDER BY modified_at, delivered_at, batch_no) AS a, row_number() OVER (PARTITION BY {_P} ORDER BY modified_at DESC, delivered_at DESC, batch_no DESC) AS b FROM source_files WHERE file_path IS NOT NULL),
x AS (SELECT id, h, z FROM v WHERE a = 1 AND NOT gone), y AS (SELECT id, h, z FROM v WHERE b = 1 AND NOT gone),
j AS (SELECT coalesce(x.id, y.id) AS id, x.id IS NULL AS un, y.id IS NULL AS mi, concat_ws(',', CASE WHEN x.h IS DISTINCT FROM y.h THEN 'hash' END, CASE WHEN x.z IS DISTINCT FROM y.z THEN 'size' END) AS ks FROM x FULL OUTER JOIN y ON x.id = y.id)
SELECT id, CASE WHEN mi THEN 'missing' WHEN un THEN 'unmanaged' ELSE 'changed' END AS status, CASE WHEN NOT mi AND NOT un THEN ks END AS keys FROM j WHERE mi OR un OR ks <> ''""",
    "detect_language": f"SELECT file_path, {_language_sql()} AS detected FROM {_PATHS}",
    "scannable_paths": f"""SELECT file_path FROM {_PATHS} WHERE lower(regexp_extract(base, '^.+\\.([^.]+)$', 1)) NOT IN ({', '.join(map(_quote, rules.BINARY_EXTENSIONS))})
AND NOT list_has_any(string_split(file_path, '/')[:-2], [{', '.join(map(_quote, rules.SKIP_DIRS))}])""",
} | {f"baseline_{s}": _ENDS + f"SELECT rule_id, file_path, line_number FROM st WHERE status = '{s}'" for s in ("new", "resolved", "regression", "unchanged")}
