"""Summaries of findings: reports, grades, gates, rankings, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.functions.paths import path_form
from scanloom.operators.snapshots import SEVERITIES, severity_rank

# Weights of severities and confidences in grade, heatmap and ranking, and the grades' limits.
GRADE_SEVERITY = {"CRITICAL": 10.0, "HIGH": 5.0, "MEDIUM": 2.0, "LOW": 0.5, "INFO": 0.05}
GRADE_CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
GRADE_LIMITS = ((0.5, "A"), (2.0, "B"), (5.0, "C"), (10.0, "D"))
HEAT_SEVERITY = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}
RANK_SEVERITY = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 45, "LOW": 20, "INFO": 5}
RANK_CONFIDENCE = {"HIGH": 0.95, "MEDIUM": 0.7, "LOW": 0.4}
FEATURE_SEVERITY = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "INFO": 0.05}
FEATURE_CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.25}


def weigh(name: Column, table: dict, default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(name == k, F.lit(v)) if out is None else out.when(name == k, F.lit(v))
    return out.otherwise(F.lit(default))


def normalise(findings: DataFrame) -> DataFrame:
    """Severity and confidence in upper case, path form, null line 0."""
    return findings.withColumns(
        {
            "severity": F.upper(F.trim("severity")), "confidence": F.upper(F.trim("confidence")), "file_path": path_form(F.col("file_path")),
            "line_number": F.coalesce("line_number", F.lit(0)), "severity_rank": severity_rank(F.col("severity")).cast("tinyint"),
        }
    )


KEY = ("scan_id", "rule_id", "file_path", "line_number")


def current_findings(findings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per key and scan: the one delivered last (ties: highest row_id).

    ``columns``: what is wanted beside the key; all columns if None.  Others are not read.
    """
    if columns is not None:
        need = {*KEY, "delivered_at", "row_id", "severity" if {"severity", "severity_rank"} & set(columns) else "row_id", *columns}
        findings = findings.select(*[c for c in findings.columns if c in need])
        for c in ("severity", "confidence"):
            if c not in findings.columns:
                findings = findings.withColumn(c, F.lit(None).cast("string"))
    rows = normalise(findings)
    keep = [c for c in rows.columns if c not in KEY and (columns is None or c in columns)]
    packed = rows.groupBy(*KEY).agg(F.max_by(F.struct(*keep, F.lit(1).alias("_one")), F.struct("delivered_at", "row_id")).alias("r"))
    return packed.select(*KEY, *[F.col("r")[c].alias(c) for c in keep]).select(*[c for c in rows.columns if c in (*KEY, *keep)])


def count_severities() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SEVERITIES)]


def scan_report(findings: DataFrame, by: list[str]) -> DataFrame:
    """Totals by severity, files with issues and rules, per group (or one row)."""
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *count_severities(), F.countDistinct("file_path").alias("files_with_issues"), F.countDistinct("rule_id").alias("rules"))


def risk_grade(findings: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """Weighted findings per scanned file and a letter; ``files``: by, files_scanned (null or 0 counts as 1)."""
    penalty = weigh(F.col("severity"), GRADE_SEVERITY, 0.1) * weigh(F.col("confidence"), GRADE_CONFIDENCE, 0.6)
    total = findings.groupBy(by).agg(F.sum(F.round(penalty * 1000).cast("long")).alias("milli"))
    rows = files.join(total, by, "left").withColumn("penalty", F.coalesce("milli", F.lit(0)) / 1000.0)
    score = F.col("penalty") / F.greatest(F.coalesce("files_scanned", F.lit(1)), F.lit(1))
    grade = None
    for limit, letter in GRADE_LIMITS:
        grade = F.when(score <= limit, letter) if grade is None else grade.when(score <= limit, letter)
    return rows.select(by, F.col("penalty").alias("penalty_total"), F.round(score, 6).alias("score"), grade.otherwise("F").alias("grade"))


def heatmap(findings: DataFrame, by: str = "file_path") -> DataFrame:
    """File by severity with a weighted risk."""
    grid = findings.groupBy(by).agg(*count_severities())
    risk = sum((F.col(s.lower()) * w for s, w in HEAT_SEVERITY.items()), F.lit(0))
    return grid.withColumn("risk", risk.cast("long"))


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value, so the result is defined."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def top_k_per(df: DataFrame, group: str, by: str, k: int) -> DataFrame:
    """The k most frequent values of each group: counts first, so that a window sees one row per value."""
    n = df.groupBy(group, by).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), by))).where(F.col("rank") <= k)


def quality_gate(findings: DataFrame, by: str, max_critical: int = 0, max_high: int = 0, max_total: int = 999_999) -> DataFrame:
    rows = findings.groupBy(by).agg(F.count("*").alias("total"), *count_severities())
    fails = F.array_compact(
        F.array(F.when(F.col("critical") > max_critical, "critical"), F.when(F.col("high") > max_high, "high"), F.when(F.col("total") > max_total, "total"))
    )
    return rows.select(by, "total", "critical", "high", (F.size(fails) == 0).alias("passed"), F.array_join(fails, ",").alias("failures"))


def longitudinal(scans: DataFrame) -> DataFrame:
    """Per target: first and last total, their difference, number of scans.  Repeated scans count once."""
    s = scans.dropDuplicates(["id", "target"])
    at = F.struct("scan_timestamp", "id")
    return s.groupBy("target").agg(
        F.count("*").alias("n_scans"), F.min_by("total_vulns", at).alias("first_total"), F.max_by("total_vulns", at).alias("last_total"),
    ).withColumn("delta", F.col("last_total") - F.col("first_total"))


def risk_rank(findings: DataFrame, reachable: Column | None = None, exploitability: Column | None = None, epss: Column | None = None, business: Column | None = None, digits: int = 2) -> DataFrame:
    """Multiplicative priority score and its band."""
    reach = F.when(F.coalesce(reachable if reachable is not None else F.lit(True), F.lit(True)), 1.0).otherwise(0.35)
    score = (
        weigh(F.col("severity"), RANK_SEVERITY, 30).cast("double")
        * weigh(F.col("confidence"), RANK_CONFIDENCE, 0.65)
        * reach
        * (0.4 + 0.6 * (exploitability if exploitability is not None else F.lit(0.5)))
        * (0.5 + 0.5 * (epss if epss is not None else F.lit(0.0)))
        * (0.5 + (business if business is not None else F.lit(0.5)) / 2)
    )
    score = F.round(F.least(score, F.lit(100.0)), digits)
    return findings.withColumn("score", score).withColumn("priority", F.when(score >= 75, "P0").when(score >= 50, "P1").when(score >= 25, "P2").otherwise("P3"))


# The features and what stands for one that a finding lacks.
FEATURES = {"confidence": 0.5, "severity": 0.3, "reachable": 0.0, "test_file": 0.0, "in_comment": 0.0, "sanitized": 0.0, "exploitability": 0.5, "epss": 0.0, "business_criticality": 0.5}


def feature_vector(columns: list[str] = ("confidence", "severity", "file_path", "in_comment")) -> Column:
    """Numeric features of a finding for a false-positive model, in the order of ``FEATURES``; ``columns``: those the findings have."""
    test = F.lower("file_path").rlike("(^|/)tests?/|_test\\.|\\.test\\.|\\.spec\\.")
    own = {
        "confidence": weigh(F.col("confidence"), FEATURE_CONFIDENCE, 0.5), "severity": weigh(F.col("severity"), FEATURE_SEVERITY, 0.3), "test_file": test.cast("double"),
        **{c: F.coalesce(F.col(c), F.lit(False)).cast("double") for c in ("reachable", "in_comment", "sanitized")},
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(FEATURES[c])) for c in ("exploitability", "epss", "business_criticality")},
    }
    has = {*columns, *(["test_file"] if "file_path" in columns else [])}
    return F.array(*[own[f] if f in has else F.lit(v) for f, v in FEATURES.items()])


# Frameworks, controls and the weaknesses they cover.
FRAMEWORKS = {
    "OWASP-2021": {
        "A01 Broken Access Control": ["CWE-22", "CWE-284", "CWE-352", "CWE-601", "CWE-639", "CWE-862", "CWE-863"],
        "A02 Cryptographic Failures": ["CWE-295", "CWE-319", "CWE-326", "CWE-327", "CWE-328", "CWE-330", "CWE-338"],
        "A03 Injection": ["CWE-20", "CWE-74", "CWE-77", "CWE-78", "CWE-79", "CWE-89", "CWE-90", "CWE-94", "CWE-95", "CWE-611"],
        "A05 Security Misconfiguration": ["CWE-16", "CWE-209", "CWE-548", "CWE-732", "CWE-1188"],
        "A07 Authentication Failures": ["CWE-259", "CWE-287", "CWE-306", "CWE-307", "CWE-798"],
        "A08 Integrity Failures": ["CWE-494", "CWE-502", "CWE-829"],
        "A09 Logging Failures": ["CWE-117", "CWE-532", "CWE-778"],
        "A10 SSRF": ["CWE-918"],
    },
    "PCI-DSS": {
        "3.4 Stored data unreadable": ["CWE-311", "CWE-312", "CWE-327"],
        "4.1 Strong cryptography in transit": ["CWE-295", "CWE-319"],
        "6.5.1 Injection flaws": ["CWE-78", "CWE-89", "CWE-90", "CWE-94"],
        "6.5.7 Cross-site scripting": ["CWE-79"],
        "8.2.1 Credentials protected": ["CWE-522", "CWE-798"],
        "10.2 Audit trails": ["CWE-778"],
    },
    "CWE-TOP": {
        "Injection": ["CWE-78", "CWE-79", "CWE-89", "CWE-94"],
        "Memory": ["CWE-119", "CWE-120", "CWE-125", "CWE-416", "CWE-476", "CWE-787"],
        "Credentials": ["CWE-798", "CWE-522"],
        "Files": ["CWE-22", "CWE-434"],
    },
}


def controls(spark) -> DataFrame:
    rows = [(f, c, w) for f, cs in FRAMEWORKS.items() for c, ws in cs.items() for w in ws]
    return spark.createDataFrame(rows, "framework string, control string, cwe string")


def compliance_report(findings: DataFrame, control_table: DataFrame) -> DataFrame:
    """Each control with its number of findings and whether it passes; controls without findings stay.

    The control table is a constant of under 200 rows, hence the broadcast; findings are counted per weakness first.
    """
    per = findings.groupBy("cwe").agg(F.count("*").alias("n"))
    hit = per.join(F.broadcast(control_table), "cwe").groupBy("framework", "control").agg(F.sum("n").alias("findings"))
    all_ = control_table.select("framework", "control").distinct()
    out = all_.join(hit, ["framework", "control"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("findings") == 0, "pass").otherwise("fail"))


def compliance_score(report: DataFrame) -> DataFrame:
    return report.groupBy("framework").agg(F.count("*").alias("controls"), F.count_if(F.col("status") == "pass").alias("passed"), F.round(F.avg((F.col("status") == "pass").cast("double")) * 100, 2).alias("score"))


def anomalies(lines: DataFrame, limit: float = 0.8) -> DataFrame:
    """Files whose average line length is far from the mean of all files, generation markers adding to the score.

    ``lines``: file_path, line.  The mean is one row, joined to every file.
    """
    marks = F.size(F.regexp_extract_all(F.col("line"), F.lit(r"(?i)\b(TODO|FIXME|generated|as an ai)\b"), F.lit(1)))
    per = lines.groupBy("file_path").agg(F.avg(F.length("line")).alias("avg_len"), F.sum(marks).alias("markers"))
    mean = per.agg(F.avg("avg_len").alias("mean"))
    score = F.abs(F.col("avg_len") - F.col("mean")) / F.greatest(F.col("mean"), F.lit(1.0)) + F.col("markers") * 0.4
    return per.join(F.broadcast(mean)).withColumn("score", F.round(score, 3)).where(score > limit).select("file_path", "markers", "score")


def maturity(metrics: DataFrame, dims: list[str]) -> DataFrame:
    """Mean of dimensions clamped to 0–5 and its level."""
    clamped = [F.least(F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0)), F.lit(5.0)) for d in dims]
    mean = sum(clamped[1:], clamped[0]) / len(dims)
    level = F.when(mean >= 4.5, "optimised").when(mean >= 3.5, "managed").when(mean >= 2.5, "defined").when(mean >= 1.5, "repeatable").otherwise("initial")
    return metrics.withColumn("maturity", F.round(mean, 2)).withColumn("level", level)
