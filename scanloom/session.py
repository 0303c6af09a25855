"""Session defaults for local runs; on a cluster the submitter's settings stand."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "scanloom", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cpus if cpus != "*" else 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver found it, if the session's settings don't already."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str):
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df, rows: int, row_bytes: int, limit: int = 64 << 20):
    """Broadcast ``df`` only when its counted rows times a row's size stay under ``limit``.

    Beyond it the hint is left off and the optimiser joins by shuffle.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows * row_bytes <= limit else df


def spread(df):
    """``df`` over enough tasks for work that is heavy per row.

    A source of few files or row groups gives few tasks, however many cores there are.  Where a scan gives fewer than
    two tasks a core its rows are dealt out evenly; a large source has more tasks than that and is left alone, so this
    adds no shuffle at scale.  Only for frames without a shuffle of their own, whose tasks are known before they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
