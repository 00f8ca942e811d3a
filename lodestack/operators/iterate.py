"""Walks with callbacks, and what belongs to an entry's inode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.paths import order_key
from .select import list_subtree, tree_order


def iterate_tree(entries: DataFrame, callback: Callable[[Row], int | None], top: str = "/", children_only: bool = False) -> int:
    """Calls ``callback`` for each entry at or below ``top`` in the order of a walk; a result other than 0 or None ends it.

    Rows come to the driver a partition at a time. Returns the last result. A missing ``top`` is an error.
    """
    if top != "/" and entries.where(F.col("path") == top).isEmpty():
        raise FileNotFoundError(top)
    return _each(list_subtree(entries, top, children_only).orderBy(*tree_order(F.col("path"))), callback)


def iterate_blobs(blobs: DataFrame, callback: Callable[[Row], int | None]) -> int:
    """Calls ``callback`` for each blob (hash, ...) by hash; a result other than 0 or None ends it."""
    return _each(blobs.orderBy("hash"), callback)


def _each(rows: DataFrame, callback: Callable[[Row], int | None]) -> int:
    for row in rows.toLocalIterator():
        if result := callback(row):
            return result
    return 0


def aliases(entries: DataFrame) -> DataFrame:
    """Every entry (path, inode) with the number of names of its inode and the first of them, by which the others are linked.

    No list is built, so that an inode with very many names takes no task's memory.
    """
    groups = entries.groupBy("inode").agg(F.count(F.lit(1)).alias("n_names"), F.min(F.struct(order_key("path").alias("k"), F.col("path").alias("path"))).alias("least"))
    return entries.join(groups, "inode").select(*entries.columns, "n_names", F.col("least.path").alias("first_name"))


def number_inodes(inodes: DataFrame, order: list[Column]) -> DataFrame:
    """Adds inode_number from 1, gapless in the given order, which must be unique; no task gets all rows."""
    from ..plans.durable import global_rank

    return global_rank(inodes, order, "inode_number")


def tree_numbers(entries: DataFrame) -> DataFrame:
    """Entries (image, path) with their place in a walk of their image, from 1: parents before children, siblings by name."""
    walk = Window.partitionBy("image").orderBy(*tree_order(F.col("path")))
    return entries.withColumn("place", F.row_number().over(walk))
