"""Intermediate tables in the folder that driver and executors share, and ranks that need no single task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder if driver and executors are one
    process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestack-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestack/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds a global 1-based rank by ``order`` (which must be unique) without gathering the rows in one task.

    Rows are range-partitioned and written with their partition number, which fixes it; ranks are the place within
    the partition plus the rows of lower partitions (a table with one row per partition).
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *(c.alias(f"rank_key{i}") for i, c in enumerate(order)))
    keys = [f"rank_key{i}" for i in range(len(order))]
    dealt = materialise(keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("rank_part").agg(F.count(F.lit(1)).alias("rank_n"))
    below = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("rank_part", F.coalesce(F.sum("rank_n").over(below), F.lit(0)).alias("rank_before"))
    own = F.row_number().over(Window.partitionBy("rank_part").orderBy(*keys))
    joined = dealt.withColumn("rank_own", own).join(F.broadcast(before), "rank_part")
    return joined.withColumn(name, F.col("rank_before") + F.col("rank_own")).drop("rank_part", "rank_before", "rank_own", *keys)
