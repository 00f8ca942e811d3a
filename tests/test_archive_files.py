"""Compression, solid resources, ranges, mounted trees, versions, walks and write plans."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestack import errors
from lodestack.archive import POINTER, Archive, ArchiveError
from lodestack.functions import paths
from lodestack.operators import iterate, layout, select, verify, writing
from lodestack.sources import archive as files
from lodestack.sources import codecs, lzx, unix

RND = random.Random(4)
TEXT = b" ".join(RND.choice([b"alpha", b"beta", b"gamma", b"delta", b"\xe8\x10\x00\x00\x00", b"\xe8\xff\xff\xff\xff"]) for _ in range(5000))


@pytest.mark.parametrize("kind", [lzx.VERBATIM, lzx.ALIGNED, lzx.UNCOMPRESSED])
@pytest.mark.parametrize("data", [b"a", b"ab" * 3, TEXT[:20_000], TEXT[:32_768], bytes(32_768), RND.randbytes(3001), b"\xe8" * 40])
def test_lzx_chunks(kind, data):
    assert lzx.decompress(lzx.compress(data, 32_768, kind), len(data)) == data


def test_lzx_with_a_large_window():
    data = TEXT * 12
    packed = lzx.compress(data, 1 << 20)
    assert len(packed) < len(data) // 2 and lzx.decompress(packed, len(data), 1 << 20) == data


def test_lzx_tables():
    assert [lzx.FOOTER_BITS[s] for s in (0, 3, 4, 5, 6, 36, 49)] == [0, 0, 1, 1, 2, 17, 17]
    assert [lzx.BASES[s] for s in (0, 1, 2, 3, 4, 5, 6, 30)] == [0, 1, 2, 3, 4, 6, 8, 32768]
    assert [lzx.window_order(c) for c in (1, 32_768, 32_769, 1 << 21)] == [15, 15, 16, 21]


def test_lzx_refuses_bad_chunks():
    rnd = random.Random(6)
    good = lzx.compress(TEXT[:4000])
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rnd.randint(1, 4)):
            bad[rnd.randrange(len(bad))] ^= 1 << rnd.randrange(8)
        try:
            assert len(lzx.decompress(bytes(bad), 4000)) == 4000
        except codecs.BadData:
            pass
    with pytest.raises(codecs.BadData):
        lzx.decompress(b"", 10)


def test_calls_are_translated_there_and_back():
    rnd = random.Random(7)
    for _ in range(50):
        data = bytes(rnd.choice([0xE8, 0, 0xFF, 1, rnd.randrange(256)]) for _ in range(rnd.randint(0, 400)))
        assert bytes(lzx.translate_calls(lzx.translate_calls(data), back=True)) == data
    call = b"\xe8" + struct.pack("<i", 16) + bytes(20)
    assert lzx.translate_calls(b"\0" * 8 + call)[8:13] == b"\xe8" + struct.pack("<i", 24)


@pytest.mark.parametrize("kind", [codecs.XPRESS_FLAG, codecs.LZX_FLAG])
@pytest.mark.parametrize("lengths_only", [False, True])
def test_ranges_of_resources(kind, lengths_only):
    data = TEXT[:9000] + RND.randbytes(5000) + TEXT[:1000]
    stored = codecs.write_chunked(data, 4096, kind, lengths_only)
    for first, end in ((0, None), (0, 1), (4095, 4097), (5000, 5000), (9000, 14_900), (14_999, 15_000), (100, 10**6)):
        assert codecs.read_chunked(stored, len(data), 4096, kind, first, end, lengths_only) == data[first:end]
    with pytest.raises(codecs.BadData):
        codecs.read_chunked(stored, len(data), 4096, kind, 99_999, 99_999, lengths_only)


@pytest.mark.parametrize("chunk,kind,solid", [(0, codecs.XPRESS_FLAG, True), (4096, codecs.XPRESS_FLAG, True), (32_768, codecs.LZX_FLAG, False), (32_768, codecs.LZX_FLAG, True)])
def test_archives_of_every_kind(spark, chunk, kind, solid):
    rows = [("a", i % 2 + 3, f"image {i % 2}", f"/d{i % 3}/f{i}", TEXT[i * 10 : i * 700]) for i in range(8)] + [("b", 1, "other", "/x", b"only")]
    made = files.build_archives(spark.createDataFrame(rows, "archive string, image_index int, image_name string, path string, content binary"), chunk, kind, solid).cache()
    contents = files.parse_archives(made, "contents").collect()
    assert {(r.archive, bytes(r.content)) for r in contents} == {(a, c) for a, _, _, _, c in rows if c} and all(r.is_intact for r in contents)
    blobs = files.parse_archives(made, "blobs").where(F.col("flags").bitwiseAND(F.lit(files.METADATA)) == 0)
    assert all(bool(r.flags & files.SOLID) == solid for r in blobs.collect())
    parts = files.read_ranges(made, blobs.select(F.col("archive").alias("path"), "hash", F.lit(3).cast("long").alias("first"), F.lit(9).cast("long").alias("end"))).collect()
    assert {bytes(r.bytes) for r in parts} == {c[3:9] for *_, c in rows if c}
    images = files.image_properties(files.parse_archives(made, "xml")).orderBy("archive", "image_index").collect()
    assert [(r.archive, r.image_index, r.name, r.file_count, r.description) for r in images] == [("a", 1, "image 0", 4, None), ("a", 2, "image 1", 4, None), ("b", 1, "other", 1, None)]
    assert files.parse_archives(made, "integrity").where("not is_intact").isEmpty()


def test_items_that_only_some_images_have(spark):
    xml = files.build_xml([{"NAME": "one"}, {"NAME": "two", "DESCRIPTION": "second"}, {"FLAGS": "x"}])
    got = files.image_properties(spark.createDataFrame([(xml,)], "xml string")).orderBy("image_index").collect()
    assert [(r.name, r.description, r.flags) for r in got] == [("one", None, None), ("two", "second", None), (None, None, "x")]


def test_mounted_trees(spark, tmp_path):
    root = tmp_path / "data" / "x" / "data"
    (root / "sub" / "empty").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"content")
    (root / "sub" / "none").write_bytes(b"")
    os.link(root / "a.txt", root / "sub" / "b.txt")
    os.symlink("../a.txt", root / "sub" / "rel")
    os.symlink(str(root / "a.txt"), root / "abs")
    os.symlink("/elsewhere", root / "out")
    os.chmod(root / "sub", 0o750)
    os.utime(root / "a.txt", ns=(10**18 + 100, 10**18 + 12_345_600))
    (root / "skip").mkdir()
    (root / "skip" / "f").write_bytes(b"x")
    got = {r.path: r for r in unix.scan_unix(spark, str(root), ["/skip"]).collect()}
    assert set(got) == {"/", "/a.txt", "/sub", "/sub/empty", "/sub/none", "/sub/b.txt", "/sub/rel", "/abs", "/out"}
    assert got["/a.txt"].link_id == got["/sub/b.txt"].link_id > 0 and got["/sub/none"].link_id == 0
    assert (got["/sub/rel"].target, got["/abs"].target, got["/out"].target) == ("../a.txt", "/a.txt", "/elsewhere")
    assert got["/sub"].mode & 0o777 == 0o750 and got["/sub/none"].hash is None
    copy = tmp_path / "copy"
    unix.write_unix(unix.scan_unix(spark, str(root), ["/skip"]), str(copy))
    assert (copy / "a.txt").read_bytes() == b"content" and os.stat(copy / "a.txt").st_ino == os.stat(copy / "sub" / "b.txt").st_ino
    assert os.readlink(copy / "sub" / "rel") == "../a.txt" and (copy / "sub" / "empty").is_dir()
    assert os.stat(copy / "sub").st_mode & 0o777 == 0o750 and os.stat(copy / "a.txt").st_mtime_ns == 10**18 + 12_345_600
    unix.write_unix(unix.scan_unix(spark, str(root), ["/skip"]), str(copy))  # again, over itself
    assert sorted(os.listdir(copy)) == ["a.txt", "abs", "out", "sub"]


def tree_of(spark, *names):
    return spark.createDataFrame([(f"/{n}", False, n.encode()) for n in names], "path string, is_directory boolean, content binary")


def test_versions_of_an_archive(spark, tmp_path):
    path = str(tmp_path / "stored")
    with pytest.raises(ArchiveError):
        Archive.open(spark, path)
    one = Archive.create(spark).add_image("x", tree_of(spark, "a", "b")).write(path)
    one.delete_path("x", "/a").write(path)
    names = lambda: {r.path for r in Archive.open(spark, path).tree("x").collect()}
    assert names() == {"/", "/b"}
    (tmp_path / "stored" / f"{POINTER}0000000002").write_text("v-half 123")  # a writer that crashed
    assert names() == {"/", "/b"}
    one.write(path)
    assert names() == {"/", "/a", "/b"}


def test_reference_by_globs(spark, tmp_path):
    for n in ("p1", "p2"):
        Archive.create(spark).add_image("x", tree_of(spark, n)).write(str(tmp_path / n))
    own = Archive.create(spark).add_image("x", tree_of(spark, "p1", "q"))
    got = own.reference_files([str(tmp_path / "p*")])
    assert {(bytes(r.content), r.is_external) for r in got.contents.collect()} == {(b"p1", False), (b"q", False), (b"p2", True)}
    with pytest.raises(ArchiveError):
        own.reference_files([str(tmp_path / "none*")])


def test_cat_and_callbacks(spark):
    import io

    made = Archive.create(spark).add_image("x", tree_of(spark, "a", "B", "c"))
    out = io.BytesIO()
    assert made.cat("x", "/B", out) == 1 and out.getvalue() == b"B"
    for path, error in (("/none", FileNotFoundError), ("/", IsADirectoryError)):
        with pytest.raises(error):
            made.cat("x", path, out)
    seen = []
    assert made.iterate("x", lambda r: seen.append(r["path"])) == 0 and seen == ["/", "/a", "/B", "/c"]
    assert made.iterate("x", lambda r: 7 if r["path"] == "/B" else 0) == 7
    with pytest.raises(FileNotFoundError):
        iterate.iterate_tree(made.tree("x"), print, "/none")


def test_paths_of_deep_broken_and_circular_trees(spark):
    nodes = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(100, 101, "c"), (101, 102, "d"), (102, 100, "e"), (103, 102, "f"), (200, 999, "lost"), (201, 200, "g"), (300, None, "top")]
    got = {r.id: (r.path, r.depth) for r in select.materialise_paths(spark.createDataFrame(nodes, "id long, parent_id long, name string"), 64).collect()}
    assert set(got) == {*range(40), 300} and got[39] == ("".join(f"/n{i}" for i in range(40)), 40)
    with pytest.raises(ValueError):
        select.materialise_paths(spark.createDataFrame(nodes, "id long, parent_id long, name string"), 32).count()


def test_overlaps_see_every_extent_in_front(spark):
    rows = spark.createDataFrame([("g", 0, 100), ("g", 10, 5), ("g", 50, 5), ("g", 100, 5), ("h", 60, 1)], "g string, start long, size long")
    assert {(r.start, r.before_end) for r in layout.overlaps(rows, "g", ["start"]).collect()} == {(10, 100), (50, 100)}


def test_assigned_resources_against_all_pairs(spark):
    rnd = random.Random(9)
    resources = [(g, n, rnd.randint(0, 20)) for g in "ab" for n in range(12)]
    blobs = [(g, rnd.randint(0, 140), rnd.randint(1, 9)) for g in "abc" for _ in range(60)]
    got = {(r.g, r.offset, r.size): (r.resource_no, r.offset_in_res) for r in layout.assign_resources(spark.createDataFrame(blobs, "g string, offset long, size long"), spark.createDataFrame(resources, "g string, resource_no long, usize long"), "g").collect()}
    want = {}
    for g, offset, size in blobs:
        end = 0
        for n, usize in ((n, u) for h, n, u in resources if h == g):
            end += usize
            if offset + size <= end:
                want[g, offset, size] = (n, offset - (end - usize))
                break
    assert got == want


def test_chunks_of_text_and_bytes(spark):
    text = "aé🎉\n\r\n" * 50
    for content, kind in ((text, "string"), (text.encode(), "binary")):
        got = sorted(verify.integrity_chunks(spark.createDataFrame([(1, content), (2, content[:0])], f"id long, content {kind}"), 7).collect(), key=lambda r: r.chunk_no)
        assert [r.length for r in got] == [len(content[i : i + 7]) for i in range(0, len(content), 7)]


def test_folding(spark):
    names = ["abc", "Éa", "straße", "ﬁ", "ǆ", "𐐨", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(paths.fold("n")).collect()]
    assert got == ["ABC", "ÉA", "STRAßE", "ﬁ", "Ǆ", "𐐨", None, ""]


def test_write_plans(spark):
    resources = spark.createDataFrame([(0, 10), (10, 20)], "offset long, stored long")
    strategy = lambda **k: writing.overwrite_strategy(resources, k.pop("end", 30), **k)
    assert [strategy(), strategy(end=29), strategy(deleted_images=1), strategy(wants_compaction=True), strategy(is_pipable=True), strategy(read_only=True), strategy(parts=2)] == ["append", "rebuild", "rebuild", "compact", "rebuild", "refuse", "refuse"]
    assert errors.error_of(FileNotFoundError("x")) == 49 and errors.error_of(KeyError("x")) == 68 and errors.version_text().count(".") == 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from lodestack.plans import durable

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Unset:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            @staticmethod
                            def isDefined():
                                return False

                        return No

                return Unset

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        durable.shared_dir(Session())
