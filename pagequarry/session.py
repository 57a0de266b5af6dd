"""What operators need from the session: size-checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold this many narrow rows (terms, ids, weights: some 10 MB).
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side counted to be small; otherwise Spark shuffles.

    The count stops at the bound, so a side of any size costs at most ``max_rows`` rows.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; only local runs may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and go on from there.

    The table outlives lost executors, is read column by column, and its size is known to
    the planner, unlike that of a checkpointed RDD.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/pagequarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsorted_partitions(spark: SparkSession) -> int:
    """Into this many partitions an exchange writes rows as they come; into more it holds and sorts them."""
    return int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work on an input of few splits (a no-op on large inputs)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_dealt(df: DataFrame) -> bool:
    """Whether rows go through an exchange; then to ask for the number of partitions, as :func:`spread` does, is to run it."""
    return "- Exchange " in df._jdf.queryExecution().executedPlan().toString()


def spread_read(df: DataFrame, *by: str) -> DataFrame:
    """:func:`spread` for rows as they are read, by the columns ``by``, also where few of many splits hold rows.

    A file of one row group is read by one task, whatever its splits.  Rows are counted without
    their columns, and dealt into no more partitions than are written as the rows come.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    readers = df.select(F.spark_partition_id()).distinct().count()
    return df.repartition(min(cores, unsorted_partitions(df.sparkSession)), *by) if readers < cores else df
