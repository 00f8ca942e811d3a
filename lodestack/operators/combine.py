"""Putting archives together and taking them apart: references, export, parts, overlays, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent_path, under
from ..plans.packing import pack_in_order


def reference(dest: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """``dest`` with the blobs of ``sources`` that it lacks; of several sources the first wins. Adds is_external."""
    columns = dest.columns
    every = dest.withColumn("source_no", F.lit(-1))
    for i, s in enumerate(sources):
        every = every.unionByName(s.select(*columns).withColumn("source_no", F.lit(i)))
    first = every.groupBy("hash").agg(F.min("source_no").alias("first_no"))
    once = every.join(first, "hash").where("source_no = first_no")
    mine = once.where("source_no < 0")
    outside = once.where("source_no >= 0").dropDuplicates(["hash"])
    return mine.unionByName(outside).select(*columns, (F.col("source_no") >= 0).alias("is_external"))


def export_image(streams: DataFrame, dest: DataFrame) -> DataFrame:
    """Blob table of ``dest`` (hash, size, refcnt) after an image's streams (hash, size, nlink) were exported into it."""
    new = streams.where("hash is not null").groupBy("hash").agg(F.min("size").alias("new_size"), F.sum("nlink").alias("new_refs"))
    joined = dest.join(new, "hash", "full")
    return joined.select("hash", F.coalesce("size", "new_size").alias("size"), (F.coalesce("refcnt", F.lit(0)) + F.coalesce("new_refs", F.lit(0))).alias("refcnt"), F.col("refcnt").isNull().alias("is_added"))


def name_collisions(images: DataFrame, dest_images: DataFrame) -> DataFrame:
    """Images whose non-empty name is taken in the destination."""
    return images.where("name <> ''").join(dest_images.select("name").distinct(), "name", "left_semi")


def split_parts(blobs: DataFrame, limit: int) -> DataFrame:
    """Adds part_number: blobs (ordinal, size, is_metadata) in order of ordinal fill parts of up to ``limit`` bytes.

    A blob starts a new part if it would reach the limit, unless the part is empty so far or the blob is metadata.
    """
    return pack_in_order(blobs, limit)


def join_parts(parts: DataFrame) -> DataFrame:
    """The blobs of all parts (guid, part_number, total_parts, hash, size) as one table; refuses a set that isn't whole."""
    facts = parts.select("guid", "part_number", "total_parts").distinct().agg(F.count_distinct("guid").alias("guids"), F.count_distinct("total_parts").alias("totals"), F.max("total_parts").alias("total"), F.count_distinct("part_number").alias("n"), F.min("part_number").alias("low"), F.max("part_number").alias("high")).first()
    if facts["n"] and not (facts["guids"] == facts["totals"] == 1 and facts["low"] == 1 and facts["high"] == facts["n"] == facts["total"]):
        raise ValueError(f"the parts don't make one archive: {facts.asDict()}")
    return parts.drop("part_number", "total_parts")


def overlay(base: DataFrame, top: DataFrame, replace: bool = True) -> DataFrame:
    """Lays tree ``top`` over ``base`` (path, is_directory, and the same further columns).

    Directories merge, a file replaces a file unless ``replace`` is off; a file over a directory or the reverse is an
    error that the action raises. Adds origin: base, top or both.
    """
    rest = [c for c in base.columns if c != "path"]
    b, t = base.select("path", *(F.col(c).alias(f"b_{c}") for c in rest)), top.select("path", *(F.col(c).alias(f"t_{c}") for c in rest))
    clash = F.col("b_is_directory") != F.col("t_is_directory")
    both = b.join(t, "path", "full").withColumn("b_is_directory", F.when(clash, F.raise_error(F.concat(F.lit("a file and a directory meet at "), "path")).cast("boolean")).otherwise(F.col("b_is_directory")))
    in_base, in_top = F.col("b_is_directory").isNotNull(), F.col("t_is_directory").isNotNull()
    from_top = in_top & (F.lit(replace) | ~in_base)
    return both.select("path", *(F.when(from_top, F.col(f"t_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in rest), F.when(in_base & in_top, "both").when(in_top, "top").otherwise("base").alias("origin"))


def with_directories(entries: DataFrame) -> DataFrame:
    """Adds the directories that entries (path, is_directory) imply and lack."""
    implied = entries.select(F.explode(ancestors("path")).alias("path")).distinct().join(entries.select("path"), "path", "left_anti")
    return entries.unionByName(implied.withColumn("is_directory", F.lit(True)), allowMissingColumns=True)


def delete_path(entries: DataFrame, path: str, force: bool = False, recursive: bool = False) -> DataFrame:
    """Entries without ``path``. A missing path is an error unless ``force``, a directory needs ``recursive``."""
    found = entries.where(F.col("path") == path).select("is_directory").first()
    if found is None:
        if force:
            return entries
        raise FileNotFoundError(path)
    if found["is_directory"] and not recursive:
        raise IsADirectoryError(path)
    return entries.where(~under("path", F.lit(path)))


def rename_path(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Entries with ``old`` and what is below it moved to ``new``, under the rules of rename(2)."""
    if old == new:
        return entries
    kinds = {r["path"]: r["is_directory"] for r in entries.where(F.col("path").isin(old, new)).select("path", "is_directory").collect()}
    if old not in kinds:
        raise FileNotFoundError(old)
    if new.startswith(old + "/"):
        raise ValueError("a directory can't move below itself")
    if new in kinds:
        if kinds[old] and not kinds[new]:
            raise NotADirectoryError(new)
        if kinds[new] and not kinds[old]:
            raise IsADirectoryError(new)
        if kinds[new] and not entries.where(under("path", F.lit(new)) & (F.col("path") != new)).isEmpty():
            raise OSError(f"{new} is not empty")
    return move_subtree(entries.where(F.col("path") != new), old, new)


def move_subtree(entries: DataFrame, old: str, new: str) -> DataFrame:
    rest = F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path"))
    return entries.withColumn("path", F.when(under("path", F.lit(old)), F.concat(F.lit(new), rest)).otherwise(F.col("path")))


def update(entries: DataFrame, commands: list[dict]) -> DataFrame:
    """Applies an ordered list of commands to a tree; if one fails nothing of the list takes effect.

    Commands: {"op": "add", "tree": DataFrame, "at": path, "replace": bool}, {"op": "delete", "path", "force",
    "recursive"}, {"op": "rename", "old", "new"}.
    """
    now = entries
    for c in commands:
        if c["op"] == "add":
            at = c.get("at", "/").rstrip("/")
            now = overlay(now, c["tree"].withColumn("path", F.concat(F.lit(at), "path")), c.get("replace", True)).drop("origin")
        elif c["op"] == "delete":
            now = delete_path(now, c["path"], c.get("force", False), c.get("recursive", False))
        elif c["op"] == "rename":
            now = rename_path(now, c["old"], c["new"])
        else:
            raise ValueError(f"unknown command {c['op']!r}")
    return now


def delete_images(images: DataFrame, gone: list[int], boot_index: int = 0) -> tuple[DataFrame, int]:
    """Images (image_index, ...) without ``gone``, numbered anew from 1, and the new boot index (0: none)."""
    left = images.where(~F.col("image_index").isin(gone) if gone else F.lit(True))
    shifted = left.withColumn("image_index", F.row_number().over(Window.orderBy("image_index")))  # at most 65535 rows
    boot = 0 if boot_index in gone else boot_index - sum(g < boot_index for g in set(gone))
    return shifted, boot


def set_property(images: DataFrame, index: int, key: str, value: str) -> DataFrame:
    """Sets or, with an empty text, removes a property in the map of one image. Names stay unique."""
    if key == "NAME" and value and not images.where((F.col("image_index") != index) & (F.element_at("properties", "NAME") == value)).isEmpty():
        raise ValueError("another image has that name")
    without = F.map_filter("properties", lambda k, _: k != key)
    changed = F.map_concat(without, F.create_map(F.lit(key), F.lit(value))) if value else without
    return images.withColumn("properties", F.when(F.col("image_index") == index, changed).otherwise(F.col("properties")))


def children_of(entries: DataFrame) -> DataFrame:
    """Number of direct children by directory: parent, n_children."""
    return entries.where("path <> '/'").groupBy(parent_path("path").alias("parent")).agg(F.count(F.lit(1)).alias("n_children"))
