"""Tables and checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own in local mode (tests), and an error on a cluster, whose hosts share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: the lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_run(df: DataFrame, name: str, *keys: str, path: str | None = None) -> DataFrame:
    """df written as a run: Parquet in the shared folder (or at path), dealt into buckets by keys and sorted by them in each.

    There are as many buckets as shuffle partitions, so rows that a shuffle by keys has dealt are not dealt again. Joins of runs
    by their keys, and of rows dealt so, merge file by file without an exchange or a sort, if they end in another run (scans count as sorted only
    while one is written). The table's name is gone from the catalog at once; the files stay.
    """
    spark = df.sparkSession
    table, path = f"run_{uuid.uuid4().hex}", path or new_path(spark, name)
    before = spark.conf.get(SORTED_SCANS)
    spark.conf.set(SORTED_SCANS, "true")
    try:
        df.write.format("parquet").bucketBy(bucket_count(spark), *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        found = spark.table(table)
        found.schema  # resolved before the name goes
        spark.sql(f"DROP TABLE {table}")
    finally:
        spark.conf.set(SORTED_SCANS, before)
    return found


def opened_run(spark: SparkSession, path: str, buckets: int, schema: str, *keys: str) -> DataFrame:
    """A run that an earlier session wrote (with so many buckets), with its buckets and their order."""
    table, by, at = f"run_{uuid.uuid4().hex}", ", ".join(keys), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet OPTIONS (path '{at}') CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS")
    found = spark.table(table)
    found.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return found
