"""Queries of the text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.llm import bpe, generated, leaks, pii, secrets
from scanloom.session import table


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("string")
    findings, entropy = table(spark, d, "findings"), table(spark, d, "entropy_findings")
    return secrets.credentials(
        [
            ("findings.line_content", findings.select("row_id", null.alias("name"), F.col("line_content").alias("text"))),
            ("entropy_findings.line_content", entropy.select("row_id", null.alias("name"), F.col("line_content").alias("text"))),
            ("entropy_findings.secret_value", entropy.select("row_id", F.col("variable_name").alias("name"), F.col("secret_value").alias("text"))),
        ]
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d).select("field_name", "row_id", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each text that holds a credential, once, with its secret values replaced."""
    return _credentials(spark, d).groupBy("field_name", "row_id").agg(F.first("redacted").alias("redacted"), F.count("*").alias("n_secrets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.generated_files(table(spark, d, "scan_results"), table(spark, d, "findings"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with up to two words changed, added or left out."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents")).select("doc_id", "pii_type", "start_pos").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p5_found, p6_ids, p7_found, p7_leaks, p8_found, p8_redacted)}
SQL: dict[str, str] = {}
