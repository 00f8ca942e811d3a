"""Physical layout: extents, solid resources, write orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, fold, order_key


def overlaps(extents: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Extents (group, start, size) that begin before any of those in front of them in their group ends."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return extents.withColumn("before_end", F.max(F.col("start") + F.col("size")).over(w)).where("start < before_end")


def out_of_bounds(extents: DataFrame, end: int) -> DataFrame:
    """Extents that don't lie within [0, end]."""
    return extents.where((F.col("start") < 0) | (F.col("size") < 0) | (F.col("start") + F.col("size") > end))


def solid_offsets(blobs: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Offset of each blob in its solid resource: the sizes in front of it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blobs.withColumn("offset_in_res", F.coalesce(F.sum("size").over(w), F.lit(0)))


def assign_resources(blobs: DataFrame, resources: DataFrame, run: str) -> DataFrame:
    """The first resource of a run whose end covers each blob's end: adds resource_no, offset_in_res.

    ``blobs`` has run, offset (from the start of the run's data) and size; ``resources`` has run, resource_no and usize.
    A blob that straddles two resources gets a negative offset, which validation refuses; one beyond them all is left out.
    Blobs and ends are merged in one order from the back, so that a run with many of both takes no pairs.
    """
    w = Window.partitionBy(run).orderBy("resource_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = resources.withColumn("res_end", F.sum("usize").over(w))
    found = F.struct("resource_no", (F.col("res_end") - F.col("usize")).alias("res_start"))
    marks = ends.where("usize > 0").select(run, F.col("res_end").alias("place"), F.lit(0).alias("kind"), found.alias("found"))
    wanted = blobs.select(F.col(run), (F.col("offset") + F.col("size")).alias("place"), F.lit(1).alias("kind"), F.struct(*blobs.columns).alias("blob"))
    back = Window.partitionBy(run).orderBy(F.col("place").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(wanted, allowMissingColumns=True).withColumn("found", F.last("found", ignorenulls=True).over(back))
    inside = merged.where((F.col("kind") == 1) & F.col("found").isNotNull() & (F.col("place") > 0)).select("blob.*", "found.*")
    return inside.select(*blobs.columns, "resource_no", (F.col("offset") - F.col("res_start")).alias("offset_in_res"))


def raw_copies(blobs: DataFrame, group: str, selected: Column, same_format: Column | None = None) -> DataFrame:
    """Per resource whether it is copied as it is: the wanted bytes are over two thirds of it and its format is right."""
    ok = F.bool_and(same_format) if same_format is not None else F.lit(True)
    sums = blobs.groupBy(group).agg(F.sum(F.when(selected, F.col("size")).otherwise(0)).alias("wanted_bytes"), F.sum("size").alias("all_bytes"), ok.alias("same_format"))
    return sums.select(group, "wanted_bytes", "all_bytes", (F.col("same_format") & (F.col("wanted_bytes") * 3 > F.col("all_bytes") * 2)).alias("is_raw_copy"))


def solid_order(path: Column) -> list[Column]:
    """Sort keys that bring like content together: without name first, then without extension by name, then by
    extension and name."""
    name = basename(path)
    named = path.isNotNull() & (name != "")
    ext = extension(path)
    return [named, ext.isNotNull(), order_key(fold(F.coalesce(ext, F.lit("")))), order_key(fold(F.coalesce(name, F.lit(""))))]


def sort_names(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds sort_name: the shortest path under which a blob's hash occurs in ``entries`` (path, hash)."""
    names = entries.groupBy("hash").agg(F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("path"))).alias("least"))
    return blobs.join(names.select("hash", F.col("least.path").alias("sort_name")), "hash", "left")


#: Read order: what is in archives before what is in files, compacted archives first.
SEQUENTIAL = ("location", "is_compacted", "guid", "part_number", "res_offset", "offset_in_res", "path")


def sequential_order(columns: list[str]) -> list[Column]:
    """Sort keys over those of the columns that are there; is_compacted is boolean."""
    return [~F.col(c) if c == "is_compacted" else F.col(c) for c in SEQUENTIAL if c in columns]


def sparse_regions(blobs: DataFrame, unit: int = 4096) -> DataFrame:
    """Alternating runs of zero and other data in units of ``unit`` bytes: hash, is_zero, start, size (blobs: hash, content)."""
    n = F.octet_length("content")
    units = blobs.withColumn("bytes", n).where("bytes > 0").select("hash", "bytes", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / unit).cast("int"))).alias("i"))
    piece = F.substring(F.col("content"), F.col("i") * unit + 1, F.lit(unit))
    flagged = units.select("hash", "bytes", "i", (F.translate(F.hex(piece), "0", "") == "").alias("is_zero"))
    by_hash = Window.partitionBy("hash").orderBy("i")
    starts = flagged.withColumn("is_start", (F.col("is_zero") != F.coalesce(F.lag("is_zero").over(by_hash), ~F.col("is_zero"))).cast("int"))
    runs = starts.withColumn("run", F.sum("is_start").over(by_hash)).groupBy("hash", "run", "is_zero").agg((F.min("i") * unit).cast("long").alias("start"), F.least((F.max("i") + 1) * unit, F.max("bytes")).alias("run_end"))
    return runs.select("hash", "is_zero", "start", (F.col("run_end") - F.col("start")).cast("long").alias("size"))


def chunk_ranges(ranges: DataFrame, chunk: int) -> DataFrame:
    """Chunks that byte ranges (id, offset, size) need: id, chunk_no, from_byte, n_bytes within the chunk."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / chunk)
    each = ranges.where("size > 0").select("id", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / chunk), last)).alias("chunk_no"))
    begin = F.greatest(F.col("offset") - F.col("chunk_no") * chunk, F.lit(0))
    end = F.least(F.col("offset") + F.col("size") - F.col("chunk_no") * chunk, F.lit(chunk))
    return each.select("id", "chunk_no", begin.alias("from_byte"), (end - begin).alias("n_bytes"))
