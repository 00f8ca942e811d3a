"""Checks: digests, integrity tables, archive invariants, tree comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_bit


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs (hash, content) whose content has another digest."""
    return blobs.withColumn("found", F.sha1("content")).where(F.col("found") != F.col("hash")).select("hash", "found")


def verify_archive(streams: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: n_streams, n_missing (content in no blob), n_corrupt (blobs with another digest)."""
    known = blobs.groupBy("hash").agg(F.lit(True).alias("known"))
    uses = streams.join(known, "hash", "left").agg(F.count(F.lit(1)).alias("n_streams"), F.count_if(F.col("hash").isNotNull() & F.col("known").isNull()).alias("n_missing"))
    bad = blobs.agg(F.count_if(F.sha1("content") != F.col("hash")).alias("n_corrupt"))
    return uses.join(F.broadcast(bad), F.lit(True))  # one row each


def integrity_chunks(files: DataFrame, chunk: int) -> DataFrame:
    """Digest of every slice of ``chunk`` characters (text) or bytes (binary) of content: id, chunk_no, sha1, length.

    A text is cut in one pass; slices of bytes are found without one.
    """
    if files.schema["content"].dataType.simpleString() == "string":
        pieces = F.regexp_extract_all("content", F.lit(f"(?s)(.{{1,{chunk}}})"), 1)
        cut = files.select("id", F.posexplode(pieces).alias("chunk_no", "piece"))
        return cut.select("id", "chunk_no", F.sha1("piece").alias("sha1"), F.length("piece").alias("length"))
    n = F.length("content")
    each = files.select("id", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / chunk), F.lit(0)).cast("int"))).alias("chunk_no"))
    piece = F.substring(F.col("content"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return each.select("id", "chunk_no", F.sha1(piece).alias("sha1"), F.length(piece).alias("length")).where("length > 0")


def refresh_integrity(new: DataFrame, old: DataFrame, chunk: int) -> DataFrame:
    """Digests of ``new`` (id, chunk_no, sha1, length), those of full chunks taken from ``old`` where it has them."""
    known = old.where(F.col("length") == chunk).select("id", "chunk_no", F.col("sha1").alias("old_sha1"))
    return new.join(known, ["id", "chunk_no"], "left").select("id", "chunk_no", F.coalesce("old_sha1", "sha1").alias("sha1"), "length", F.col("old_sha1").isNotNull().alias("is_reused"))


def check_integrity(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Per id whether all chunks agree: id, n_chunks, n_bad (different, lost or surplus), is_intact."""
    a, b = found.select("id", "chunk_no", F.col("sha1").alias("a")), stored.select("id", "chunk_no", F.col("sha1").alias("b"))
    bad = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return a.join(b, ["id", "chunk_no"], "full").groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), bad.alias("n_bad"), (bad == 0).alias("is_intact"))


def invariants(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Broken rules of the data model with how often each is: rule, n. Entries have parent, name, is_directory, is_reparse, nlink."""
    doubles = entries.groupBy("parent", "name").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rule = lambda df, cond, name: df.agg(F.count_if(cond).alias("n")).select(F.lit(name).alias("rule"), "n")
    found = rule(blobs, F.col("size") <= 0, "empty blob")
    for cond, name in (
        (F.col("is_directory") & (F.col("nlink") > 1), "linked directory"),
        (F.col("is_reparse") & (F.col("nlink") > 1), "linked reparse point"),
        (F.col("name").isin("", ".", "..") | F.col("name").contains("/"), "bad name"),
    ):
        found = found.unionByName(rule(entries, cond, name))
    return found.unionByName(doubles.select(F.lit("double name").alias("rule"), "n")).where("n > 0")


def compare_trees(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Differences of two trees by path: path, difference (missing, extra, or the first column that differs)."""
    a = first.select("path", F.lit(True).alias("in_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = second.select("path", F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    differs = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra")
    for c in columns:
        differs = differs.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return a.join(b, "path", "full").select("path", differs.alias("difference")).where("difference is not null")


def compare_images(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences that count when an image is read back: path, stream_name, difference.

    Not symmetric: streams or a descriptor only in the second are accepted, the sparse bit may be lost but not gained.
    Rows have path, stream_name, hash, descriptor, attributes.
    """
    keys = ["path", "stream_name"]
    a = first.select(*keys, F.lit(True).alias("in_a"), F.col("hash").alias("a_hash"), F.col("descriptor").alias("a_sd"), F.col("attributes").alias("a_attr"))
    b = second.select(*keys, F.lit(True).alias("in_b"), F.col("hash").alias("b_hash"), F.col("descriptor").alias("b_sd"), F.col("attributes").alias("b_attr"))
    same_path = second.select("path").distinct().withColumn("path_in_b", F.lit(True))
    own_path = first.select("path").distinct().withColumn("path_in_a", F.lit(True))
    gained = has_bit(F.col("b_attr"), "sparse") & ~has_bit(F.col("a_attr"), "sparse")
    other = F.col("a_attr").bitwiseAND(F.bitwise_not(F.lit(0x200).cast("long"))) != F.col("b_attr").bitwiseAND(F.bitwise_not(F.lit(0x200).cast("long")))
    joined = a.join(b, keys, "full").join(same_path, "path", "left").join(own_path, "path", "left")
    difference = (
        F.when(F.col("path_in_b").isNull(), "missing path")
        .when(F.col("path_in_a").isNull(), "extra path")
        .when(F.col("in_b").isNull(), "missing stream")
        .when(F.col("in_a").isNull(), None)
        .when(~F.col("a_hash").eqNullSafe(F.col("b_hash")), "content")
        .when(F.col("a_sd").isNotNull() & ~F.col("a_sd").eqNullSafe(F.col("b_sd")), "descriptor")
        .when(gained | other, "attributes")
    )
    return joined.select(*keys, difference.alias("difference")).where("difference is not null")


def link_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths whose hard links aren't the same in two trees (path, inode): inodes must map one to one, both ways."""
    both = first.select("path", F.col("inode").alias("a")).join(second.select("path", F.col("inode").alias("b")), "path")
    forward = both.groupBy("a").agg(F.count_distinct("b").alias("n_b"))
    back = both.groupBy("b").agg(F.count_distinct("a").alias("n_a"))
    return both.join(forward, "a").join(back, "b").where("n_a > 1 or n_b > 1").select("path")
