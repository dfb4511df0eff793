"""Loaders of tables in Parquet, and scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; timestamps without a zone are read as UTC, so watermarks take them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder of the cluster (spark.checkpoint.dir); a folder in the warehouse where it is unset.

    All of a session lie in one folder of its application, which the driver deletes when it ends."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{base.rstrip('/')}/quern-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df once to a table in the shared folder and read it back: the plan's lineage ends there, and lost executors don't matter.

    path is a folder name of scratch_dir, for callers that discard the table before the session ends."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of materialize that no plan reads any more, all that came of it being written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: What is broadcast takes at most so many bytes by the count of small().
BROADCAST_BYTES = 32 << 20


def weight(df: DataFrame) -> int:
    """The bytes that df's rows take, by a count: 16 a column, and what strings, binaries and arrays hold."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema:
        if f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif f.dataType.typeName() == "array":
            width = width + F.coalesce(16 * F.size(f"`{f.name}`"), F.lit(0))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its rows take at most BROADCAST_BYTES by weight(), which is counted first; beyond, df as it is."""
    return F.broadcast(df) if weight(df) <= BROADCAST_BYTES else df
