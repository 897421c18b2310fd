"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows of sessions are wide beside what their shuffle weighs: a task of 64 MB of it holds gigabytes while it sorts.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
# Bytes of an input table for which a shuffle begins with a partition of its own; small ones are merged afterwards.
BYTES_A_PARTITION = 3 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: UTC clock, adaptive plans, split of skewed joins."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def sized_for(spark: SparkSession, table: DataFrame) -> int:
    """Lets shuffles begin with as many partitions as the table's size asks for, so that a task's share does not grow with it."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return partitions


def first_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle begins with: what `sized_for` asked for, else the session's number."""
    sized = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(sized or spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, else the context's, else one in the warehouse.

    A warehouse on the local disk is shared only where everything runs on one machine: on a cluster it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    kind = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    if kind == "file" and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on a local disk")
    return f"{warehouse}/keyvigil-stored"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str, partitioned_by: Sequence[str] = ()) -> DataFrame:
    """The frame, written once as Parquet in the shared folder and read back.

    It cuts the lineage, survives lost executors, gives later readers column pruning and a size Catalyst knows,
    and fixes values such as a partition number that another run of the same plan could change.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    writer = frame.write.mode("errorifexists")
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(frame.schema).parquet(path).select(*frame.columns)


def discard_written(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once nothing derived from them is needed any more."""
    count = 0
    while _made:
        target = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        count += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return count
