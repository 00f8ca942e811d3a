"""Content: single instancing, reference counts, statistics, links, missing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_blobs(streams: DataFrame) -> DataFrame:
    """One blob per hash: hash, size, refcnt, is_collision (sizes differ). Rows have hash, size and perhaps nlink."""
    n = F.sum("nlink") if "nlink" in streams.columns else F.count(F.lit(1))
    return streams.where("hash is not null").groupBy("hash").agg(F.min("size").alias("size"), n.alias("refcnt"), (F.min("size") != F.max("size")).alias("is_collision"))


def link_groups(files: DataFrame, keys: list[str]) -> DataFrame:
    """Inodes from files that share a key (such as device and number, and content): keys, size, nlink, first_path."""
    return files.groupBy(*keys).agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("nlink"), F.min("path").alias("first_path"))


def hard_links(entries: DataFrame) -> DataFrame:
    """Entries (link_id, hash, is_directory, entry_id) in groups of one inode each: adds inode (its least entry_id), nlink.

    Entries with the same link id and content are one inode; directories and link id 0 stand alone.
    """
    alone = F.col("is_directory") | (F.coalesce("link_id", F.lit(0)) == 0)
    together = entries.where(~alone)
    groups = together.groupBy("link_id", "hash").agg(F.min("entry_id").alias("inode"), F.count(F.lit(1)).alias("nlink"))
    joined = together.join(groups, together["link_id"].eqNullSafe(groups["link_id"]) & together["hash"].eqNullSafe(groups["hash"])).select(together["*"], "inode", "nlink")
    return joined.unionByName(entries.where(alone).withColumn("inode", F.col("entry_id")).withColumn("nlink", F.lit(1).cast("long")))


def image_stats(inodes: DataFrame, directories: DataFrame) -> DataFrame:
    """Per image dir_count, file_count, total_bytes and hard_link_bytes.

    ``inodes`` has image, size (null: content is missing, counts 0) and nlink; ``directories`` has image and path.
    """
    size = F.coalesce("size", F.lit(0))
    files = inodes.groupBy("image").agg(F.sum("nlink").alias("file_count"), F.sum(size * F.col("nlink")).alias("total_bytes"), F.sum(size * (F.col("nlink") - 1)).alias("hard_link_bytes"))
    dirs = directories.select("image", "path").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("dir_count"))
    joined = files.join(dirs, "image", "full")
    return joined.select("image", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dir_count", "file_count", "total_bytes", "hard_link_bytes")))


def savings(files: DataFrame, group: str) -> DataFrame:
    """Bytes that single instancing saves within each group: total_bytes, stored_bytes, saved_bytes."""
    once = files.groupBy(group, "hash").agg(F.sum("size").alias("all_bytes"), F.max("size").alias("one"))
    return once.groupBy(group).agg(F.sum("all_bytes").alias("total_bytes"), F.sum("one").alias("stored_bytes"), F.sum(F.col("all_bytes") - F.col("one")).alias("saved_bytes"))


def unique_sizes(blobs: DataFrame) -> DataFrame:
    """Adds is_unique_size: no other blob has this size, so that it needn't be hashed before it is written."""
    counts = blobs.groupBy("size").agg((F.count(F.lit(1)) == 1).alias("is_unique_size"))
    return blobs.join(counts, blobs["size"].eqNullSafe(counts["size"])).select(blobs["*"], "is_unique_size")


def missing(streams: DataFrame, blobs: DataFrame) -> DataFrame:
    """Streams whose content is in none of ``blobs``; a null hash is an empty stream, which misses nothing."""
    return streams.where("hash is not null").join(blobs.select("hash"), "hash", "left_anti")


def placeholders(streams: DataFrame, blobs: DataFrame) -> DataFrame:
    """Hashes that a forward-only reader must wait for: needed, not there yet."""
    return missing(streams, blobs).select("hash").distinct()


def adjust_refcounts(blobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Reference counts after ``changes`` (hash, delta); never below zero, rows with none stay."""
    total = changes.groupBy("hash").agg(F.sum("delta").alias("delta"))
    return blobs.join(total, "hash", "left").withColumn("refcnt", F.greatest(F.col("refcnt") + F.coalesce("delta", F.lit(0)), F.lit(0))).drop("delta")


def targets(streams: DataFrame) -> DataFrame:
    """Where each blob goes: hash, n_targets, first_target; one row per blob, however many inodes share it."""
    return streams.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n_targets"), F.min("path").alias("first_target"))


def feature_tally(entries: DataFrame, features: dict[str, Column]) -> DataFrame:
    """One row: how many entries have each feature."""
    return entries.agg(*(F.count_if(c).alias(n) for n, c in features.items()))


def unsupported(tally: DataFrame, supported: dict[str, bool]) -> DataFrame:
    """Features that are in use and not supported: feature, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in tally.columns))).alias("f")
    return tally.select(pairs).select("f.*").where((F.col("n") > 0) & ~F.col("feature").isin([n for n, ok in supported.items() if ok]))


def template_reuse(new: DataFrame, template: DataFrame) -> DataFrame:
    """Streams of new inodes that can take a template's content.

    Both have path, times (created, written, accessed), stream_type, stream_name, size; the template has hash. A file
    qualifies if created and written are equal, the template wasn't accessed later, and each of its own streams has one
    in the template with the same type, name and size. Streams only in the template don't matter.
    """
    old = template.select("path", "stream_type", "stream_name", F.col("size").alias("t_size"), "hash", *(F.col(c).alias(f"t_{c}") for c in ("created", "written", "accessed")))
    both = new.join(old, ["path", "stream_type", "stream_name"], "left")
    fits = F.coalesce((F.col("size") == F.col("t_size")) & (F.col("created") == F.col("t_created")) & (F.col("written") == F.col("t_written")) & (F.col("accessed") >= F.col("t_accessed")), F.lit(False))
    good = both.groupBy("path").agg(F.bool_and(fits).alias("fits")).where("fits").select("path")
    return both.join(good, "path", "left_semi").select("path", "stream_type", "stream_name", "size", "hash")


def descriptors(entries: DataFrame) -> DataFrame:
    """Distinct security descriptors (image, descriptor, ordinal) numbered from 0 by first occurrence in their image."""
    from pyspark.sql import Window

    once = entries.groupBy("image", "descriptor").agg(F.min("ordinal").alias("first_seen"))
    return once.select("image", "descriptor", (F.row_number().over(Window.partitionBy("image").orderBy("first_seen")) - 1).alias("security_id"))


def with_descriptor(inodes: DataFrame, table: DataFrame) -> DataFrame:
    """Joins descriptors by (image, security_id); an id out of range becomes -1."""
    joined = inodes.join(table, ["image", "security_id"], "left")
    return joined.withColumn("security_id", F.when(F.col("descriptor").isNull(), -1).otherwise(F.col("security_id")))


def stream_roles(streams: DataFrame) -> DataFrame:
    """Role of every stream (inode, stream_id, name, hash, is_reparse, is_encrypted): data, reparse_point, encrypted, named,
    or unused. Of an encrypted file's unnamed streams the first with content counts; otherwise the first is the reparse
    data of a reparse point, the next one with it the file's data."""
    from pyspark.sql import Window

    unnamed = F.coalesce(F.col("name"), F.lit("")) == ""
    order = Window.partitionBy("inode", unnamed).orderBy(F.when(F.col("is_encrypted") & F.col("hash").isNull(), 1).otherwise(0), "stream_id")
    place = F.row_number().over(order)
    role = F.when(~unnamed, "named").when(F.col("is_encrypted"), F.when(place == 1, "encrypted").otherwise("unused"))
    role = role.when(F.col("is_reparse"), F.when(place == 1, "reparse_point").when(place == 2, "data").otherwise("unused")).otherwise(F.when(place == 1, "data").otherwise("unused"))
    return streams.withColumn("role", role)
