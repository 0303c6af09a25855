"""Packages: advisories by version, bump plans, look-alike names, licences, pinning, component lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.functions.text import cvss3_base, severity_of_score, version_array, version_lt

# Well-known packages by ecosystem, markers of private names, packages under the GPL, copyleft licences; part of a public advisory list.
POPULAR = {
    "pypi": "requests numpy pandas flask django urllib3 boto3 pytest setuptools pyyaml click jinja2 cryptography pillow scipy sqlalchemy matplotlib beautifulsoup4 selenium scrapy tensorflow torch fastapi pydantic".split(),
    "npm": "react lodash express axios vue webpack typescript eslint jest babel chalk commander moment underscore async request debug colors yargs react-dom next".split(),
    "cargo": "serde tokio rand clap reqwest regex log anyhow thiserror futures hyper actix-web".split(),
    "gem": "rails rack rspec devise nokogiri puma sidekiq".split(),
}
PRIVATE_MARKERS = ("internal-", "corp-", "private-", "-internal", "-private")
GPL_PACKAGES = {"mysql-connector-python": "GPL-2.0", "pyqt5": "GPL-3.0", "readline": "GPL-3.0", "gnu-libjpeg": "GPL-2.0"}
COPYLEFT = r"(?i)\b(?:AGPL|GPL)(?:-?v?\d[\d.]*)?\b"
ADVISORIES = (
    ("pyyaml", "CVE-2020-14343", "CRITICAL", "5.4"), ("django", "CVE-2022-28346", "CRITICAL", "3.2.13"), ("flask", "CVE-2023-30861", "HIGH", "2.2.5"), ("requests", "CVE-2023-32681", "MEDIUM", "2.31.0"),
    ("urllib3", "CVE-2021-33503", "HIGH", "1.26.5"), ("jinja2", "CVE-2020-28493", "MEDIUM", "2.11.3"), ("pillow", "CVE-2022-22817", "CRITICAL", "9.0.0"), ("cryptography", "CVE-2023-0286", "HIGH", "39.0.1"),
    ("lodash", "CVE-2021-23337", "HIGH", "4.17.21"), ("axios", "CVE-2021-3749", "HIGH", "0.21.2"), ("express", "CVE-2022-24999", "HIGH", "4.17.3"), ("minimist", "CVE-2021-44906", "CRITICAL", "1.2.6"),
    ("log4j-core", "CVE-2021-44228", "CRITICAL", "2.15.0"), ("spring-core", "CVE-2022-22965", "CRITICAL", "5.3.18"), ("tokio", "CVE-2021-45710", "HIGH", "1.13.1"), ("hyper", "CVE-2021-32714", "CRITICAL", "0.14.10"),
)


def advisories(spark: SparkSession, rows=ADVISORIES) -> DataFrame:
    return spark.createDataFrame(list(rows), "package string, cve_id string, severity string, fixed string")


def advisory_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def vulnerable(packages: DataFrame, advisory_table: DataFrame) -> DataFrame:
    """Packages older than an advisory's fixed version: the packages' columns, cve_id, severity, fixed.

    Names meet in lower case with ``_`` for ``-`` and ``.``; versions compare as four integers; null versions are
    older than any.  The join is on the name; its size decides between broadcast and shuffle.
    """
    adv = advisory_table.select(advisory_name(F.col("package")).alias("_key"), "cve_id", "severity", "fixed")
    return packages.withColumn("_key", advisory_name(F.col("name"))).join(adv, "_key").where(version_lt(F.col("version"), F.col("fixed"))).drop("_key")


def bump_plan(findings: DataFrame, by: list[str]) -> DataFrame:
    """Per group and package: the highest fixed version and all advisories."""
    return findings.groupBy(*by, "name").agg(F.max_by("fixed", version_array(F.col("fixed"))).alias("target"), F.array_join(F.array_sort(F.collect_set("cve_id")), ",").alias("cves"))


def typosquats(names: DataFrame, popular: DataFrame, max_distance: int = 2) -> DataFrame:
    """ecosystem, name, popular, distance: the nearest well-known name of the ecosystem at distance 1 to ``max_distance``.

    ``names``: ecosystem, name; ``popular``: ecosystem, name, ord (ties go to the lower ord, then name).  Names that are
    well known themselves give no row, nor do null names and ecosystems.  A well-known name is cut into one piece more
    than edits are allowed, so one piece survives them; the names look for it at most ``max_distance`` places away.  The
    join is thus on (ecosystem, length, piece), linear on both sides, and one aggregate keeps the nearest.
    """
    parts = max_distance + 1
    cut = lambda n, i: F.floor(n * i / parts).cast("int")
    known = popular.select("ecosystem", F.lower("name").alias("popular"), "ord").withColumn("_n", F.length("popular"))
    known = known.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(max_distance))))
    known = known.withColumn("_piece", F.substring("popular", cut(F.col("_n"), F.col("_i")) + 1, cut(F.col("_n"), F.col("_i") + 1) - cut(F.col("_n"), F.col("_i"))))
    a = names.select("ecosystem", "name").where("ecosystem is not null and name is not null").distinct()
    low = a.select("*", F.explode(F.sequence(F.greatest(F.length("name") - max_distance, F.lit(0)), F.length("name") + max_distance)).alias("_n"))
    low = low.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("_i")).select("*", F.explode(F.sequence(F.lit(-max_distance), F.lit(max_distance))).alias("_s"))
    start, size = cut(F.col("_n"), F.col("_i")) + F.col("_s"), cut(F.col("_n"), F.col("_i") + 1) - cut(F.col("_n"), F.col("_i"))
    low = low.where((start >= 0) & (start + size <= F.length("name"))).withColumn("_piece", F.substring(F.lower("name"), start + 1, size)).drop("_s").distinct()
    near = low.join(known, ["ecosystem", "_n", "_i", "_piece"]).withColumn("distance", F.levenshtein(F.lower("name"), F.col("popular"), max_distance))
    best = near.where("distance >= 0").groupBy("ecosystem", "name").agg(F.min(F.struct("distance", "ord", "popular")).alias("m"))
    return best.where("m.distance > 0").select("ecosystem", "name", "m.popular", "m.distance")


def popular_table(spark: SparkSession) -> DataFrame:
    rows = [(e, n, i) for e, ns in POPULAR.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "ecosystem string, name string, ord int")


def confusion_marker(name: Column) -> Column:
    """First marker of a private name found in a package name; names that begin with @ and have no slash are exempt."""
    hits = F.filter(F.array(*[F.lit(m) for m in PRIVATE_MARKERS]), lambda m: F.contains(F.lower(name), m))
    return F.when(name.startswith("@") & ~F.contains(name, F.lit("/")), None).otherwise(F.try_element_at(hits, F.lit(1)))


def licence_concern(name: Column, declared: Column) -> Column:
    """The copyleft licence a package is known for or declares, else null."""
    known = None
    for n, licence in GPL_PACKAGES.items():
        known = F.when(F.lower(name) == n, licence) if known is None else known.when(F.lower(name) == n, licence)
    return known.otherwise(F.when(copyleft(declared), declared))


def abandoned(packages: DataFrame, releases: DataFrame, as_of, max_age_days: int = 730) -> DataFrame:
    """ecosystem, name, last_release, days: packages without a known release, or whose last one is older than ``max_age_days``.

    ``releases``: ecosystem, name, released_at, as an offline copy of an index gives them; ``as_of``: the day that counts.
    """
    last = releases.groupBy("ecosystem", "name").agg(F.max("released_at").alias("last_release"))
    rows = packages.select("ecosystem", "name").where("name is not null").distinct().join(last, ["ecosystem", "name"], "left")
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_release").cast("date"))
    return rows.withColumn("days", days).where(F.col("days").isNull() | (F.col("days") > max_age_days))


def copyleft(licence: Column) -> Column:
    return F.coalesce(licence.rlike(COPYLEFT), F.lit(False))


def purl(kind: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise(""))


def osv_entries(documents: DataFrame) -> DataFrame:
    """Advisories from OSV JSON documents (column ``osv_json``): id, severity, fixed."""
    v = F.try_parse_json("osv_json")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    text = F.upper(get("$.database_specific.severity"))
    vector = get("$.severity[0].score")
    label = (
        F.when(text.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), text).when(text == "MODERATE", "MEDIUM")
        .when(F.upper(vector).startswith("CVSS:"), severity_of_score(cvss3_base(vector)))
        .when(vector.rlike(r"\d+\.\d+"), severity_of_score(F.regexp_extract(vector, r"(\d+\.\d+)", 1).cast("double"))).otherwise("MEDIUM")
    )
    events = F.from_json(get("$.affected[0].ranges[0].events", "string"), "array<struct<introduced:string,fixed:string>>")
    fixed = F.try_element_at(F.filter(events, lambda e: e["fixed"].isNotNull()), F.lit(1))["fixed"]
    return documents.select(get("$.id").alias("cve_id"), label.alias("severity"), F.coalesce(fixed, F.lit("")).alias("fixed"))


def unpinned(requirements: DataFrame) -> DataFrame:
    """Lines of requirement files that give a range (MEDIUM) or a version without a hash (LOW): file_path, line_number, package, severity."""
    line = F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", ""))
    name = F.regexp_extract(line, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    pinned = line.rlike(r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*==")
    severity = F.when(~pinned, "MEDIUM").when(~F.contains(line, F.lit("--hash=sha256:")), "LOW")
    return requirements.where((line != "") & ~line.startswith("-") & (name != "")).select("file_path", "line_number", name.alias("package"), severity.alias("severity")).where("severity is not null")
