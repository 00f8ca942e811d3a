"""Plans for writing archives: which blobs, in which order, in place or anew, and what must hold for that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import global_rank
from .layout import raw_copies

#: What happens to a blob that is to be written.
KEPT, SOFT, HARD = "written", "already here", "elsewhere"


def output_filter(blobs: DataFrame, here: DataFrame, elsewhere: DataFrame | None = None, skip_external: bool = False) -> DataFrame:
    """Adds status: a blob that the archive has already (``here``, when appending) isn't written again but stays in its table;
    one that another archive has isn't written at all if externals are skipped."""
    mark = lambda df, name: df.select("hash").distinct().withColumn(name, F.lit(True))
    out = blobs.join(mark(here, "is_here"), "hash", "left")
    out = out.join(mark(elsewhere, "is_out"), "hash", "left") if elsewhere is not None and skip_external else out.withColumn("is_out", F.lit(None).cast("boolean"))
    return out.withColumn("status", F.when(F.col("is_here"), SOFT).when(F.col("is_out"), HARD).otherwise(KEPT)).drop("is_here", "is_out")


def resources_past(resources: DataFrame, end: int | Column) -> DataFrame:
    """Resources (offset, stored) that reach past ``end``; appending there would overwrite them."""
    return resources.where(F.col("offset") + F.col("stored") > (F.lit(end) if isinstance(end, int) else end))


def append_is_safe(resources: DataFrame, end: int) -> bool:
    return resources_past(resources, end).isEmpty()


def changed_images(images: DataFrame, backing: DataFrame) -> DataFrame:
    """Images (image_index, metadata_hash) whose metadata isn't that of the stored archive; new ones too."""
    return images.join(backing.select("image_index", "metadata_hash"), ["image_index", "metadata_hash"], "left_anti")


def overwrite_strategy(resources: DataFrame, table_end: int, deleted_images: int = 0, wants_rebuild: bool = False, wants_compaction: bool = False, is_pipable: bool = False, read_only: bool = False, parts: int = 1) -> str:
    """How to overwrite an archive: "refuse", "compact" (move what stays down), "rebuild" (into a new file) or "append".

    Read-only archives and those of several parts can't be changed. Appending leaves deleted images' data where it is, needs
    the resources to end before the tables, and can't be done to a pipable archive.
    """
    if read_only or parts != 1:
        return "refuse"
    if wants_compaction:
        return "rebuild" if is_pipable else "compact"
    if wants_rebuild or is_pipable or deleted_images:
        return "rebuild"
    return "append" if append_is_safe(resources, table_end) else "rebuild"


def write_stats(blobs: DataFrame) -> DataFrame:
    """One row: n_blobs, n_bytes, n_parts (parts that the blobs come from), n_compressed."""
    return blobs.agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"), F.count_distinct("part_number").alias("n_parts"), F.count_if(F.col("is_compressed")).alias("n_compressed"))


def has_solid(resources: DataFrame) -> DataFrame:
    """Per archive whether any resource is solid."""
    return resources.groupBy("archive").agg(F.bool_or("is_solid").alias("has_solid"))


def finished_files(streams: DataFrame, written: DataFrame) -> DataFrame:
    """Per file (streams: path, hash; null: nothing to write) how many of its contents aren't in ``written`` yet, and whether
    it is done with."""
    there = written.select("hash").distinct().withColumn("there", F.lit(True))
    joined = streams.join(there, "hash", "left")
    left = F.count_if(F.col("hash").isNotNull() & F.col("there").isNull())
    return joined.groupBy("path").agg(left.alias("n_left"), (left == 0).alias("is_done"))


def output_order() -> list[Column]:
    """Sort keys of the blob table: by the resource's place in the output, then the blob's place in the resource."""
    return [F.col("out_offset"), F.col("offset_in_res"), F.col("hash")]


def write_plan(blobs: DataFrame, resource: str, same_format: Column) -> DataFrame:
    """How every blob of ``blobs`` (resource, hash, size, wanted) gets into the output: "raw" with its whole resource, or
    "again" through decompression; blobs that aren't wanted get "dropped" unless their resource is copied."""
    raw = raw_copies(blobs, resource, F.col("wanted"), same_format).select(resource, "is_raw_copy")
    how = F.when(F.col("is_raw_copy"), "raw").when(F.col("wanted"), "again").otherwise("dropped")
    return blobs.join(raw, resource).withColumn("how", how).drop("is_raw_copy")


def compacted(resources: DataFrame, start: int = 0) -> DataFrame:
    """Places of resources (archive, resource_no, offset, stored) after moving each down to the end of the one before:
    adds new_offset, never above offset."""
    before = Window.partitionBy("archive").orderBy("offset", "resource_no").rowsBetween(Window.unboundedPreceding, -1)
    return resources.withColumn("new_offset", F.lit(start) + F.coalesce(F.sum("stored").over(before), F.lit(0)))


def pipable_order(blobs: DataFrame) -> DataFrame:
    """Records of a pipable archive in the order they are written: per image its metadata before its contents, a content with
    the first image that needs it. ``blobs`` has hash, image_index (of the first use), is_metadata; adds record_no, from 1."""
    return global_rank(blobs, [F.col("image_index"), ~F.col("is_metadata"), F.col("hash")], "record_no")
