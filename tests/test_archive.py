"""Archives end to end: capture, store, export, split, update, verify."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestack.archive import Archive, ArchiveError


@pytest.fixture(scope="module")
def archive(spark):
    rows = [("/d/a.txt", False, bytearray(b"one"), 5), ("/d/b.txt", False, bytearray(b"one"), 5), ("/d/e", False, None, 0), ("/d/sub/c.bin", False, bytearray(b"three"), 0)]
    tree = spark.createDataFrame(rows, "path string, is_directory boolean, content binary, link_id long")
    return Archive.create(spark).add_image("first", tree, "the first", boot=True)


def paths(df):
    return [r.path for r in df.collect()]


def test_capture_and_list(archive):
    assert paths(archive.list("first")) == ["/", "/d", "/d/a.txt", "/d/b.txt", "/d/e", "/d/sub", "/d/sub/c.bin"]
    assert paths(archive.list(1, "/d", children_only=True)) == ["/d/a.txt", "/d/b.txt", "/d/e", "/d/sub"]
    assert {r.hash: r.refcnt for r in archive.blobs().collect()} == {hashlib.sha1(b"one").hexdigest(): 2, hashlib.sha1(b"three").hexdigest(): 1}
    s = archive.statistics().first()
    assert (s.dir_count, s.file_count, s.total_bytes, s.hard_link_bytes) == (3, 4, 11, 3)
    assert archive.info()["boot_index"] == 1 and "<NAME>first</NAME>" in archive.xml()
    with pytest.raises(ArchiveError):
        archive.add_image("first")
    with pytest.raises(ArchiveError):
        archive.resolve("nobody")


def test_store_and_open(spark, archive, tmp_path):
    at = f"{tmp_path}/a"
    stored = archive.write(at)
    assert stored.compare(1, archive, 1).isEmpty() and stored.guid == archive.guid
    changed = stored.set_property(1, "NAME", "renamed").rename_path(1, "/d/sub", "/d/moved").write(at)
    assert "/d/moved/c.bin" in paths(changed.list("renamed")) and Archive.open(spark, at).properties(1)["NAME"] == "renamed"
    assert {r.difference for r in stored.compare(1, changed, 1).collect()} == {"missing", "extra"}


def test_export_extract_verify(spark, archive):
    dest = archive.export_image("first", Archive.create(spark), name="copy")
    assert archive.compare(1, dest, "copy").isEmpty() and dest.contents.count() == 2
    got = {r.path: r.content for r in dest.extract(1, ["d/?.txt", "d/e"]).collect()}
    assert {p: bytes(c) for p, c in got.items()} == {"/d/a.txt": b"one", "/d/b.txt": b"one", "/d/e": b""}
    assert tuple(dest.verify().first()) == (3, 0, 0)
    spoilt = Archive(spark, dest.images, dest.entries, dest.contents.where(F.col("size") == 3).withColumn("content", F.lit(b"bad")), dest.guid)
    assert tuple(spoilt.verify().first()) == (3, 1, 1)
    with pytest.raises(Exception, match="content is missing"):
        spoilt.extract(1).collect()
    whole = spoilt.reference([archive])
    assert whole.contents.where("is_external").count() == 1 and whole.reference([archive]).contents.count() == 2


def test_delete_update_optimise(spark, archive):
    two = archive.add_image("second", spark.createDataFrame([("/x", False, bytearray(b"x"))], "path string, is_directory boolean, content binary"))
    left = two.delete_image("first")
    assert paths(left.list(1)) == ["/", "/x"] and left.boot_index == 0 and left.contents.count() == 3 and left.optimise().contents.count() == 1
    with pytest.raises(IsADirectoryError):
        two.delete_path("first", "/d")
    gone = two.update_image("first", [{"op": "delete", "path": "/d", "recursive": True}])
    assert paths(gone.list("first")) == ["/"] and paths(gone.list("second")) == ["/", "/x"]


def test_split_and_join(archive):
    parts = archive.split(5)
    assert parts.select("part_number").distinct().count() == 2
    assert archive.join_parts(parts).contents.exceptAll(archive.contents).isEmpty()
    with pytest.raises(ValueError):
        archive.join_parts(parts.where("part_number = 1"))


def test_template(archive):
    timed = archive.entries.withColumns({c: F.lit(7).cast("long") for c in ("created", "written", "accessed")})
    same = Archive(archive.spark, archive.images, timed, archive.contents, archive.guid)
    assert same.reuse_template(1, 1).count() == 4
