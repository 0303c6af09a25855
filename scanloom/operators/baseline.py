"""Comparisons of two sets of findings or resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["rule_id", "file_path", "line_number"]


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key (the largest of the other columns), nulls in the key made plain."""
    return df.select(F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("line_number", F.lit(0)).alias("line_number"), *columns).groupBy(*KEY).agg(*[F.max(c).alias(c) for c in columns])


def baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """key, status (new, resolved, regression, unchanged): one full outer join on the key.

    Both need severity_rank.  Repeated keys count once; a null rank is 0; empty sides give all new or all resolved.
    """
    a = _keyed(current, ["severity_rank"]).withColumnRenamed("severity_rank", "now").withColumn("has_now", F.lit(True))
    b = _keyed(baseline, ["severity_rank"]).withColumnRenamed("severity_rank", "was").withColumn("has_was", F.lit(True))
    status = (
        F.when(F.col("has_was").isNull(), "new").when(F.col("has_now").isNull(), "resolved")
        .when(F.coalesce("now", F.lit(0)) > F.coalesce("was", F.lit(0)), "regression").otherwise("unchanged")
    )
    return a.join(b, KEY, "full_outer").select(*KEY, status.alias("status"))


def suppress_by_vex(findings: DataFrame, vex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) of package findings by the first statement on (vulnerability, product).

    ``vex``: ord, vulnerability, product, status; statuses not_affected and fixed suppress.
    """
    first = vex.groupBy("vulnerability", "product").agg(F.min_by("status", "ord").alias("status"))
    off = first.where(F.col("status").isin("not_affected", "fixed")).select(F.col("vulnerability").alias("cve_id"), F.col("product").alias("package"))
    return findings.join(off, ["cve_id", "package"], "left_anti"), findings.join(off, ["cve_id", "package"], "left_semi")


def drift(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """id, status (missing, unmanaged, changed), keys: resources compared by id, attributes (a map) by value.

    A null map counts as empty.  Unchanged resources give no row.
    """
    empty = F.create_map().cast("map<string,string>")
    a = desired.select("id", F.coalesce("attributes", empty).alias("a"))
    b = actual.select("id", F.coalesce("attributes", empty).alias("b"))
    keys = F.array_distinct(F.concat(F.map_keys("a"), F.map_keys("b")))
    changed = F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(F.col("a"), k).eqNullSafe(F.try_element_at(F.col("b"), k))))
    joined = a.join(b, "id", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unmanaged").when(F.size(changed) > 0, "changed")
    return joined.select("id", status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).alias("keys")).where("status is not null")
