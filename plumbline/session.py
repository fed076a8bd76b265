"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Adds "size(x) > 0" below every explode(x). Where x is a whole extraction over a
# text, that filter costs a second and third evaluation and saves nothing.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on.

    Spark 4.1 may zip the inputs of a UNION partition by partition when both report
    the same hash partitioning; after adaptive coalescing their partition counts
    differ and the query fails or repeats rows, so that feature is switched off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    rules = [r for r in spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if r]
    if EXCLUDED_RULE not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, EXCLUDED_RULE]))


def build_session(app: str = "plumbline", cpus: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    tune(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and work tables: the one the cluster names in
    spark.checkpoint.dir; a fresh scratch folder only in local mode without one (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("plumbline.scratch.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("plumbline.scratch.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and Spark
    plans with the size that it has, not with an estimate."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
