"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tessarine", cores: str = "8") -> SparkSession:
    """A session for tests and benches; on a cluster bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's `spark.checkpoint.dir`.

    Only where that setting is absent (tests on one machine) a temporary folder
    is taken and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tessarine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that yields fewer partitions than there are cores.

    A single small file arrives as one partition; a large table never triggers this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows by key over a fixed number of partitions ahead of heavy work.

    Rows that are small in bytes but costly to process (ids about to fetch long texts)
    would otherwise be merged into a few tasks by adaptive coalescing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows behind a test that always holds and that the optimiser cannot see through.

    Without it Spark drops a sort below a join, and takes columns out of a shuffle for one of its
    readers, which then is a second shuffle and computes everything below it again. All readers of
    the result keep the given columns.
    """
    return df.filter(F.rand() >= F.least(F.lit(0), F.hash(*columns)))
