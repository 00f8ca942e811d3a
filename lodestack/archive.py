"""An archive of images over single-instanced contents, as three tables and the commands on them.

An ``Archive`` doesn't change: every command gives a new one, and nothing is stored before ``write``. Stored archives
are folders of Parquet tables, one folder per version; the last step of a write names the current version, so that
readers see the old or the new one: it makes a file with the next number that names the version, and readers take the
greatest that is whole. Nothing is deleted or renamed, so that a crash leaves the old version; of two writers that take the
same number one fails.

images: image_index, properties (NAME, DESCRIPTION, FLAGS, ...)
entries: image_index, path, is_directory, attributes, size, hash, created, written, accessed, link_id
contents: hash, size, content, is_external
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import ATTRIBUTES
from .operators import combine, dedup, iterate, select, verify
from .plans.durable import materialise
from .sources.archive import build_xml

IMAGES = "image_index int, properties map<string,string>"
ENTRIES = "image_index int, path string, is_directory boolean, attributes long, size long, hash string, created long, written long, accessed long, link_id long"
CONTENTS = "hash string, size long, content binary, is_external boolean"
COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]


class ArchiveError(Exception):
    """A command that can't be carried out."""


#: Pointers to versions are files of this name and a number; the greatest one that is whole counts.
POINTER = "CURRENT-"


def _pointers(spark: SparkSession, path: str) -> tuple[list[int], object]:
    """Numbers of the pointers at ``path``, ascending, and the store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
    return sorted(int(n[len(POINTER) :]) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdigit()), store


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    images: DataFrame
    entries: DataFrame
    contents: DataFrame
    guid: str
    boot_index: int = 0

    # --- life

    @classmethod
    def create(cls, spark: SparkSession) -> Archive:
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, empty(IMAGES), empty(ENTRIES), empty(CONTENTS), uuid.uuid4().hex)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive:
        """The current version of a stored archive."""
        for number in reversed(_pointers(spark, path)[0]):
            line = spark.read.text(f"{path}/{POINTER}{number:010d}").first()
            if line is not None and len(line[0].split()) == 4 and line[0].endswith(" ."):
                break
        else:
            raise ArchiveError(f"no archive at {path}")
        version, guid, boot, _ = line[0].split()
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{version}/{name}")
        return cls(spark, read("images", IMAGES), read("entries", ENTRIES), read("contents", CONTENTS), guid, int(boot))

    def write(self, path: str, with_external: bool = True) -> Archive:
        """Stores a new version at ``path`` and makes it the current one."""
        version = f"v-{uuid.uuid4().hex}"
        self.images.coalesce(1).write.parquet(f"{path}/{version}/images")
        self.entries.repartition("image_index", "path").write.parquet(f"{path}/{version}/entries")
        kept = self.contents if with_external else self.contents.where("not is_external")
        kept.write.parquet(f"{path}/{version}/contents")
        numbers, store = _pointers(self.spark, path)
        number = numbers[-1] + 1 if numbers else 0
        try:
            out = store.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}{number:010d}"), False)
            out.write(bytearray(f"{version} {self.guid} {self.boot_index} .\n".encode()))
            out.close()
        except Py4JJavaError as e:
            raise ArchiveError(f"another version was written to {path} at the same time") from e
        return Archive.open(self.spark, path)

    # --- images

    def resolve(self, image: int | str) -> int:
        """Number of the one image that a number or a name selects."""
        named = self.images.select("image_index", F.coalesce(F.try_element_at("properties", F.lit("NAME")), F.lit("")).alias("name"))
        found = [r["image_index"] for r in select.resolve_images(named, str(image)).limit(2).collect()]
        if len(found) != 1:
            raise ArchiveError(f"{image!r} doesn't select one image")
        return found[0]

    def name_in_use(self, name: str) -> bool:
        return bool(name) and not self.images.where(F.try_element_at("properties", F.lit("NAME")) == name).isEmpty()

    def tree(self, image: int | str) -> DataFrame:
        return self.entries.where(F.col("image_index") == self.resolve(image)).drop("image_index")

    def add_image(self, name: str, tree: DataFrame | None = None, description: str | None = None, boot: bool = False) -> Archive:
        """Appends an image; ``tree`` has path and is_directory, and may have content and the other columns of entries."""
        if self.name_in_use(name):
            raise ArchiveError(f"an image is named {name!r} already")
        index = (self.images.agg(F.max("image_index")).first()[0] or 0) + 1
        properties = {"NAME": name} | ({"DESCRIPTION": description} if description else {})
        images = self.images.unionByName(self.spark.createDataFrame([(index, properties)], IMAGES))
        made = replace(self, images=images, boot_index=index if boot else self.boot_index)
        top = self.spark.createDataFrame([(index, "/", True, ATTRIBUTES["directory"], 0)], "image_index int, path string, is_directory boolean, attributes long, size long")
        made = replace(made, entries=made.entries.unionByName(top, allowMissingColumns=True))
        return made if tree is None else made.update_image(index, [{"op": "add", "tree": tree}])

    def delete_image(self, image: int | str) -> Archive:
        gone = self.resolve(image)
        images, boot = combine.delete_images(self.images, [gone], self.boot_index)
        entries = self.entries.where(F.col("image_index") != gone).withColumn("image_index", F.col("image_index") - (F.col("image_index") > gone).cast("int"))
        return replace(self, images=images, entries=entries, boot_index=boot)

    def export_image(self, image: int | str, dest: Archive, name: str | None = None, description: str | None = None) -> Archive:
        """``dest`` with a copy of an image and those of its contents that it lacks."""
        index = self.resolve(image)
        own = self.properties(index)
        new_name = own.get("NAME", "") if name is None else name
        if dest.name_in_use(new_name):
            raise ArchiveError(f"an image is named {new_name!r} already")
        number = (dest.images.agg(F.max("image_index")).first()[0] or 0) + 1
        merged = {k: v for k, v in (own | {"NAME": new_name} | ({"DESCRIPTION": description} if description is not None else {})).items() if v}
        entries = self.entries.where(F.col("image_index") == index).withColumn("image_index", F.lit(number))
        needed = self.contents.join(entries.select("hash").where("hash is not null").distinct(), "hash", "left_semi").join(dest.contents.select("hash"), "hash", "left_anti")
        return replace(dest, images=dest.images.unionByName(self.spark.createDataFrame([(number, merged)], IMAGES)), entries=dest.entries.unionByName(entries.select(*dest.entries.columns)), contents=dest.contents.unionByName(needed.select(*dest.contents.columns)))

    def properties(self, image: int | str) -> dict[str, str]:
        return dict(self.images.where(F.col("image_index") == self.resolve(image)).first()["properties"])

    def set_property(self, image: int | str, key: str, value: str) -> Archive:
        return replace(self, images=combine.set_property(self.images, self.resolve(image), key, value))

    def set_boot(self, image: int | str | None) -> Archive:
        return replace(self, boot_index=0 if image is None else self.resolve(image))

    # --- trees

    def update_image(self, image: int | str, commands: list[dict]) -> Archive:
        """Applies add, delete and rename commands to an image, all or none; contents that come with trees are stored once."""
        index = self.resolve(image)
        contents, prepared = self.contents, []
        for c in commands:
            if c["op"] == "add":
                tree, contents = self._with_contents(c["tree"], contents)
                c = {**c, "tree": tree}
            prepared.append(c)
        tree = combine.update(self.entries.where(F.col("image_index") == index).drop("image_index"), prepared)
        tree = combine.with_directories(tree).withColumn("image_index", F.lit(index)).select(*COLUMNS)
        tree = materialise(tree, "image")  # errors in the commands show here, before anything is taken over
        return replace(self, entries=self.entries.where(F.col("image_index") != index).unionByName(tree), contents=contents)

    def _with_contents(self, tree: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
        if "content" in tree.columns:
            empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
            tree = materialise(tree.withColumn("hash", F.when(~empty, F.sha1("content"))).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")), "tree")
            new = tree.where("hash is not null").select("hash", "size", "content", F.lit(False).alias("is_external")).dropDuplicates(["hash"])
            contents = contents.unionByName(new.join(contents.select("hash"), "hash", "left_anti").select(*contents.columns))
            tree = tree.drop("content")
        directory = F.when(F.col("is_directory"), ATTRIBUTES["directory"]).otherwise(ATTRIBUTES["normal"]).cast("long")
        types = dict(c.split() for c in ENTRIES.split(", "))
        missing = {c: directory if c == "attributes" else F.lit(None).cast(types[c]) for c in COLUMNS if c not in tree.columns and c != "image_index"}
        return tree.withColumns(missing).select(*(F.col(c).cast(types[c]).alias(c) for c in COLUMNS if c != "image_index")), contents

    def add_tree(self, image: int | str, tree: DataFrame, at: str = "/", replace_files: bool = True) -> Archive:
        return self.update_image(image, [{"op": "add", "tree": tree, "at": at, "replace": replace_files}])

    def delete_path(self, image: int | str, path: str, force: bool = False, recursive: bool = False) -> Archive:
        return self.update_image(image, [{"op": "delete", "path": path, "force": force, "recursive": recursive}])

    def rename_path(self, image: int | str, old: str, new: str) -> Archive:
        return self.update_image(image, [{"op": "rename", "old": old, "new": new}])

    def list(self, image: int | str, top: str = "/", children_only: bool = False) -> DataFrame:
        """Entries at or below ``top`` in the order of a walk."""
        return select.list_subtree(self.tree(image), top, children_only).orderBy(*select.tree_order(F.col("path")))

    def extract(self, image: int | str, patterns: list[str] | None = None) -> DataFrame:
        """Entries that globs from the root select, with what lies below them, and their contents.

        A file whose content isn't there is an error that the action raises; an empty file has empty content.
        """
        tree = self.tree(image)
        if patterns is not None:
            from .functions.globs import matches_any

            tree = tree.where(matches_any(F.col("path"), ["/" + p.strip("/") for p in patterns], below=True))
        joined = tree.join(self.contents.select("hash", "content"), "hash", "left")
        lost = F.col("hash").isNotNull() & F.col("content").isNull()
        content = F.when(lost, F.raise_error(F.concat(F.lit("the content is missing: "), "path")).cast("binary")).when(~F.col("is_directory"), F.coalesce("content", F.lit(b""))).otherwise(F.col("content"))
        return joined.withColumn("content", content)

    def cat(self, image: int | str, path: str, out) -> int:
        """Writes the content of one file to a binary stream, such as ``sys.stdout.buffer``; returns its size."""
        found = self.tree(image).where(F.col("path") == path).select("path", "is_directory", "hash").limit(1)
        row = found.first()
        if row is None:
            raise FileNotFoundError(path)
        if row["is_directory"]:
            raise IsADirectoryError(path)
        if row["hash"] is None:
            return 0
        blob = self.contents.where(F.col("hash") == row["hash"]).select("content").first()
        if blob is None:
            raise ArchiveError(f"the content is missing: {path}")
        return out.write(bytes(blob["content"]))

    def iterate(self, image: int | str, callback, top: str = "/", children_only: bool = False) -> int:
        """Calls ``callback`` for each entry in the order of a walk; a result other than 0 or None ends it."""
        return iterate.iterate_tree(self.tree(image), callback, top, children_only)

    def reuse_template(self, image: int | str, template: int | str, other: Archive | None = None) -> DataFrame:
        """Files of an image whose times and sizes tell that a template has their content: path, hash, ..."""
        files = lambda a, i: a.tree(i).where("not is_directory").select("path", F.lit("data").alias("stream_type"), F.lit("").alias("stream_name"), "size", "hash", "created", "written", "accessed")
        return dedup.template_reuse(files(self, image).drop("hash"), files(other or self, template))

    # --- the whole

    def blobs(self) -> DataFrame:
        """hash, size, refcnt (counted anew, never read), is_external of every content."""
        refs = self.entries.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("refcnt"))
        return self.contents.select("hash", "size", "is_external").join(refs, "hash", "left").withColumn("refcnt", F.coalesce("refcnt", F.lit(0)))

    def statistics(self) -> DataFrame:
        """Per image dir_count, file_count, total_bytes and hard_link_bytes."""
        files = self.entries.where("not is_directory").withColumn("link", F.when(F.coalesce("link_id", F.lit(0)) > 0, F.col("link_id").cast("string")).otherwise(F.concat(F.lit("/"), "path")))
        inodes = files.groupBy(F.col("image_index").alias("image"), "link", "hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("nlink"))
        return dedup.image_stats(inodes, self.entries.where("is_directory").select(F.col("image_index").alias("image"), "path"))

    def info(self) -> dict:
        sums = self.contents.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
        return {"guid": self.guid, "image_count": self.images.count(), "boot_index": self.boot_index, "blob_count": sums["n"], "total_bytes": sums["size"] or 0}

    def xml(self) -> str:
        """The images' properties and statistics as a document."""
        stats = {r["image"]: r.asDict() for r in self.statistics().collect()}
        tags = (("dir_count", "DIRCOUNT"), ("file_count", "FILECOUNT"), ("total_bytes", "TOTALBYTES"), ("hard_link_bytes", "HARDLINKBYTES"))
        rows = self.images.orderBy("image_index").collect()
        return build_xml([dict(r["properties"]) | {tag: stats[r["image_index"]][k] for k, tag in tags if r["image_index"] in stats} for r in rows], self.info()["total_bytes"])

    def reference(self, others: list[Archive]) -> Archive:
        """With the contents that it lacks taken from others as external ones; of several the first wins."""
        have = self.contents.select("hash")
        lacking = combine.reference(have, [o.contents.select("hash") for o in others]).where("is_external").select("hash")
        contents = self.contents
        for o in others:
            new = o.contents.join(lacking, "hash", "left_semi").join(contents.select("hash"), "hash", "left_anti")
            contents = contents.unionByName(new.withColumn("is_external", F.lit(True)).select(*contents.columns))
        return replace(self, contents=contents)

    def reference_files(self, patterns: list[str]) -> Archive:
        """With the contents that it lacks taken from stored archives; a pattern without a match stands for itself, and is an
        error if there is no such archive."""
        jvm = self.spark.sparkContext._jvm
        found: list[str] = []
        for pattern in patterns:
            where = jvm.org.apache.hadoop.fs.Path(pattern)
            matches = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
            found += sorted(m.getPath().toString() for m in matches) or [pattern]
        return self.reference([Archive.open(self.spark, path) for path in dict.fromkeys(found)])

    def split(self, limit: int) -> DataFrame:
        """The contents with part_number (from 1) and total_parts: parts of up to ``limit`` bytes in the order of digests."""
        from .plans.durable import global_rank

        ranked = global_rank(self.contents.select("hash", "size"), [F.col("hash")], "ordinal").withColumn("is_metadata", F.lit(False))
        parts = materialise(combine.split_parts(ranked, limit).select("hash", "part_number"), "parts")
        total = parts.agg(F.max("part_number")).first()[0] or 1
        return self.contents.join(parts, "hash").withColumn("total_parts", F.lit(total)).withColumn("guid", F.lit(self.guid))

    def join_parts(self, parts: DataFrame) -> Archive:
        return replace(self, contents=combine.join_parts(parts).drop("guid").select(*self.contents.columns))

    def optimise(self) -> Archive:
        """Without the contents that no entry refers to."""
        return replace(self, contents=self.contents.join(self.entries.select("hash").where("hash is not null").distinct(), "hash", "left_semi").select(*self.contents.columns))

    def verify(self) -> DataFrame:
        """One row: n_streams, n_missing, n_corrupt."""
        return verify.verify_archive(self.entries.where("hash is not null").select("hash"), self.contents.select("hash", "content"))

    def compare(self, image: int | str, other: Archive, other_image: int | str) -> DataFrame:
        """Differences between two images by path."""
        return verify.compare_trees(self.tree(image), other.tree(other_image), ["is_directory", "attributes", "size", "hash", "created", "written"])
