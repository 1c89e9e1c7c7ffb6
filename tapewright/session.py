"""Session helpers: the settings the operators rely on and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

SLICE = "_slice"

# Runtime SQL settings. Cluster sizing (memory, shuffle partitions, executor count) is left to the caller.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key in a JSON payload takes its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A session on one machine without that setting uses its warehouse folder; on a cluster there is no such guess.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = folder or default_folder(context.master, spark.conf.get("spark.sql.warehouse.dir"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def default_folder(master: str, warehouse: str) -> str:
    """Where a session without ``spark.checkpoint.dir`` writes; an error unless all its tasks run on one machine."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/_shared"


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one, so that runs never meet each other's files."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The frame as compressed files in ``folder``, which the caller removes. A checkpoint's files hold the plain rows."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, folder: str, part: Column) -> DataFrame:
    """Like :func:`stored`, cut by the number ``part``, which stays as column ``SLICE``: a slice is read without the others' files."""
    df.withColumn(SLICE, part.cast("int")).write.mode("overwrite").option("compression", "zstd").partitionBy(SLICE).parquet(folder)
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(SLICE, IntegerType())])).parquet(folder)
