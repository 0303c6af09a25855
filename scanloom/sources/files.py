"""File trees, diffs and stored rule files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.functions.paths import path_form
from scanloom.operators.rules import is_scannable

#: Larger files are listed with an error and not read into lines.
MAX_BYTES = 5 * 1024 * 1024


def read_tree(spark: SparkSession, *roots: str, max_bytes: int = MAX_BYTES, root_relative: bool = True) -> DataFrame:
    """file_path, content, size_bytes, modified_at, error of every scannable file below the roots.

    The size limit is a filter on the source's own column, so large files aren't read; bytes that are no UTF-8 become
    replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    if root_relative:
        for r in roots:
            bare = r.split("://")[-1].rstrip("/")
            path = F.when(path.startswith(bare + "/"), F.substring(path, F.lit(len(bare) + 2), F.length(path))).otherwise(path)
    rows = raw.select(path_form(path).alias("file_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    small = rows.where(F.col("size_bytes") <= max_bytes).withColumns({"content": F.decode("content", "UTF-8"), "error": F.lit(None).cast("string")})
    large = rows.where(F.col("size_bytes") > max_bytes).withColumns({"content": F.lit(None).cast("string"), "error": F.lit("too large")})
    return small.unionByName(large).where(is_scannable(F.col("file_path")))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file_path, line of text files, streamed line by line whatever their size (no line numbers)."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, file_name (null: everywhere) from lines ``RULE`` or ``FILE:RULE``; blank and # lines are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.regexp_extract(line, r"([^:]+)$", 1).alias("rule_id"), F.when(F.contains(line, F.lit(":")), F.regexp_extract(line, r"^(.*):[^:]+$", 1)).alias("file_name"))


def read_findings_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON report ({"findings": [...]}); a missing or broken report gives no rows."""
    schema = "findings array<struct<rule_id:string,severity:string,file_path:string,line_number:int,category:string,cwe:string,confidence:string,line_content:string>>"
    try:
        rows = spark.read.schema(schema).json(path, multiLine=True)
    except Exception:  # the path doesn't exist
        rows = spark.createDataFrame([], schema)
    return rows.select(F.explode("findings").alias("f")).select("f.*")


def read_advisory_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """osv_json: one advisory document per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("value").alias("osv_json"))
