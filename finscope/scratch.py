"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only in a single process that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("Name a folder that driver and executors share in spark.checkpoint.dir.")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there, and its files survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
