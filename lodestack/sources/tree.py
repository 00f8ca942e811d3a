"""A directory tree as a source and as a sink, and random trees for tests."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import excluded
from ..functions.paths import canonical_path
from ..functions.values import ATTRIBUTES, filetime_of


#: Java, compiled by the compiler that Spark has for its own code. ``listFiles`` would ask for the owner of each file, for which
#: local folders start a process, and calls from Python for each file are slow as well.
_EMPTY_FILES = """
StringBuilder out = new StringBuilder();
java.util.ArrayDeque todo = new java.util.ArrayDeque();
todo.add(root);
while (!todo.isEmpty()) {
    org.apache.hadoop.fs.FileStatus[] found = store.listStatus((org.apache.hadoop.fs.Path) todo.removeLast());
    for (int i = 0; i < found.length; i++) {
        if (found[i].isDirectory()) todo.add(found[i].getPath());
        else if (found[i].getLen() == 0) out.append(found[i].getPath().toString()).append((char) 0).append(found[i].getModificationTime()).append((char) 0);
    }
}
return out.toString();
"""


def empty_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Paths and times (in milliseconds) of the files without content below ``root``, in any store. The driver's JVM goes through
    the folders, only what is found comes to Python."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    where = jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    named = lambda *names: array(jvm.java.lang.Class, *(jvm.org.apache.spark.util.Utils.classForName(n, True, False) for n in names))
    code = jvm.org.codehaus.janino.ScriptEvaluator()
    code.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    code.setReturnType(named("java.lang.String")[0])
    code.setThrownExceptions(named("java.io.IOException"))
    code.setParameters(array(jvm.java.lang.String, "store", "root"), named("org.apache.hadoop.fs.FileSystem", "org.apache.hadoop.fs.Path"))
    code.cook(_EMPTY_FILES)
    found = code.evaluate(array(jvm.java.lang.Object, store, where)).split("\0")[:-1]
    return [(path, int(millis)) for path, millis in zip(found[::2], found[1::2], strict=True)]


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the store names it, which is how the paths below it begin."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where).toString().rstrip("/")


def scan_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, exceptions: list[str] | None = None, with_content: bool = True) -> DataFrame:
    """Files below ``root`` in any store: path, size, written, created, attributes, hash, content. An empty file has no hash.

    What the exclusion list leaves out is dropped before the contents are read. Spark's file scans pass over empty
    files, so that those come from the listing, which the driver makes in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    nothing = spark.createDataFrame(empty_files(spark, root), "path string, millis long")
    files = files.unionByName(nothing.select("path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    base = _qualified(spark, root)
    inner = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    named = files.withColumn("path", canonical_path(inner)).where(~excluded(F.col("path"), exclude or [], exceptions or []))
    written = filetime_of(F.col("modificationTime"))
    out = named.select("path", F.col("length").alias("size"), written.alias("written"), written.alias("created"), F.lit(ATTRIBUTES["normal"]).cast("long").alias("attributes"), F.when(F.col("length") > 0, F.sha1("content")).alias("hash"), "content")
    return out if with_content else out.drop("content")


def relative_target(target: str, link: str, root: str) -> str:
    """Target of a symbolic link; an absolute one inside the captured root becomes absolute from the root."""
    root = posixpath.normpath(root)
    if target == root or target.startswith(root + "/"):
        return target[len(root) :] or "/"
    return target


def split_target(entries: DataFrame, max_bytes: int) -> int:
    """Number of partitions for a sink such that each writes about ``max_bytes``."""
    total = entries.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // max_bytes))


def write_tree(entries: DataFrame, root: str, tasks: int | None = None) -> None:
    """Writes files (path, content) below ``root``: a local or mounted folder that every executor sees.

    Each file is written under a temporary name and renamed, so that a task that runs again does no harm. With ``tasks`` the
    files are dealt out to so many first: small ones take time by their number, and few partitions can hold many.
    """
    import os
    from urllib.parse import urlsplit

    if root.startswith("file:"):
        root = urlsplit(root).path

    def write(rows) -> None:
        made = None
        for r in rows:
            at = os.path.join(root, r["path"].lstrip("/"))
            if os.path.dirname(at) != made:
                made = os.path.dirname(at)
                os.makedirs(made, exist_ok=True)
            with open(f"{at}.part{os.getpid()}", "wb") as f:
                f.write(bytes(r["content"] or b""))
            os.replace(f.name, at)

    files = entries.select("path", "content")
    (files.repartition(tasks) if tasks else files).foreachPartition(write)


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A random tree of ``n`` nodes: id, parent_id, name, is_directory, size; node 0 is the top, parents are directories."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    nodes = spark.range(n).select("id", ((F.col("id") % 4 == 0) | (F.col("id") == 0)).alias("is_directory"), draw(1).alias("a"), draw(2).alias("b"))
    parent = (F.floor(F.col("a") * F.ceil(F.col("id") / 4)) * 4).cast("long")
    size = F.when(F.col("is_directory") | (F.col("b") < 0.29), 0).otherwise(F.floor(F.pow(2.0, F.col("b") * 18))).cast("long")
    return nodes.select("id", F.when(F.col("id") > 0, parent).alias("parent_id"), F.concat(F.lit("n"), F.hex("id")).alias("name"), "is_directory", size.alias("size"))
