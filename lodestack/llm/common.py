"""Shared helpers of the operators: texts and ids, hashes, ranks; durable tables come from the library."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialise, new_path, remove, shared_dir

__all__ = ["WORD_SPLIT", "id_and_text", "materialise", "new_path", "scratch", "shared_dir", "spread_rank", "text_or_empty", "uniform"]

#: Words are runs of anything but ASCII white space.
WORD_SPLIT = "[ \\x09-\\x0D]+"


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as ``materialise`` gives it, and a function that deletes its table, for once all made from it is written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), partial(remove, spark, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as text, so that ids pass through Python exactly, null ones too) and text (null: empty)."""
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the 53 upper bits of a hash of ``key``."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def spread_rank(rows: DataFrame, group: list[str], n_col: str, order: list[str], per_bucket: int = 4096) -> DataFrame:
    """Adds ``rank``, from 0 and gapless within ``group``, whose number of rows is in ``n_col``.

    Rows of a group fall into hash buckets of about ``per_bucket``; a rank is the rows of lower buckets plus the place
    in the own bucket, so that no group, however large, meets in one task. Group columns must not be null.
    """
    bucketed = rows.withColumn("rank_bucket", F.floor(uniform(*map(F.col, order), F.lit(11)) * F.ceil(F.col(n_col) / per_bucket)))
    keys = [*group, "rank_bucket"]
    below = Window.partitionBy(*group).orderBy("rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rank_n"))
    counts = counts.select(*keys, F.coalesce(F.sum("rank_n").over(below), F.lit(0)).alias("rank_before"))
    own = Window.partitionBy(*keys).orderBy(*order)
    return bucketed.join(counts, keys).withColumn("rank", F.col("rank_before") + F.row_number().over(own) - 1).drop("rank_bucket", "rank_before")
