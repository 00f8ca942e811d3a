"""Functions, operators and sources of the archive model."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestack.functions import paths, values
from lodestack.functions.globs import excluded, path_matches
from lodestack.operators import combine, dedup, layout, select, verify
from lodestack.plans import durable
from lodestack.plans.queries import QUERIES
from lodestack.sources import archive, text, tree
from lodestack.streaming import extract


def one(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("", "/"), ("a", "/a"), ("\\a\\\\b\\", "/a/b"), ("//a///b//", "/a/b"), ("/", "/")])
def test_canonical_path(spark, raw, want):
    assert one(spark, paths.canonical_path("p"), p=raw) == want
    assert one(spark, paths.canonical_path(paths.canonical_path("p")), p=raw) == want


def test_path_parts(spark):
    row = spark.createDataFrame([("/a/b.tar.gz",), ("/",), ("/x.",), ("/d/n",), ("/f:s:t",)], "p string").select(
        paths.basename("p"), paths.parent_path("p"), paths.depth("p"), paths.extension("p"), paths.stream_suffix("p"), paths.ancestors("p", own=True)
    )
    assert [tuple(r) for r in row.collect()] == [
        ("b.tar.gz", "/a", 2, "gz", None, ["/a", "/a/b.tar.gz"]), ("", "/", 0, None, None, ["/"]), ("x.", "/", 1, "", None, ["/x."]), ("n", "/d", 2, None, None, ["/d", "/d/n"]), ("f:s:t", "/", 1, None, "s:t", ["/f:s:t"]),
    ]


def test_names(spark):
    assert one(spark, paths.image_directory("n", "i"), n="good", i=3) == "good"
    assert one(spark, paths.image_directory("n", "i"), n="a/b", i=3) == "3"
    assert one(spark, paths.image_directory("n", "i"), n="x" * 129, i=3) == "3"
    assert one(spark, paths.fixed_name("n", "i"), n="a/b", i=2) == "a_b (invalid filename #2)"
    assert one(spark, paths.link_target(F.col("t")), t="\\??\\C:\\dir\\file") == "/dir/file"
    order = spark.createDataFrame([("\U0001f600",), ("\uff5e",)], "n string").orderBy(paths.order_key("n")).collect()
    assert [r.n for r in order] == ["\U0001f600", "\uff5e"]  # by 16-bit units, not by code points


def test_values(spark):
    assert one(spark, values.shown_size(F.col("x")), x=10 << 20) == "10 MiB" and one(spark, values.shown_size(F.col("x")), x=10239) == "10239 bytes"
    beyond = spark.sql("SELECT cast(x AS decimal(38,0)) AS x FROM VALUES ('86400000000000000000'), ('11811160063'), ('10239'), ('-1') AS t(x)")
    assert [r[0] for r in beyond.select(values.shown_size(F.col("x"))).collect()] == ["80466270446 GiB", "10 GiB", "10239 bytes", "-1 bytes"]
    assert one(spark, values.number_of(F.col("x")), x="12x") == 0 and one(spark, values.number_of(F.col("x")), x="0x1F") == 31
    assert one(spark, values.filetime_of_parts(F.col("h"), F.col("l")), h="0x01D00000", l="0x00000001") == 0x01D0000000000001
    assert one(spark, values.attribute_names(F.col("x")), x=0x411) == ["readonly", "directory", "reparse_point"]
    assert not one(spark, values.is_directory(F.col("x")), x=0x410)
    assert one(spark, values.language_name(F.col("x")), x=0x409) == "en-US"


def test_shown_values_of_many_parts(spark, tmp_path):
    keys = [0, 1, 590_000, 1_199_999, 100_000_000]
    spark.createDataFrame([(k, 50 if k else 1) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.shown for r in QUERIES["shown_values"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{50 * k**3 >> 30} GiB" if k > 1 else f"{50 * k} bytes" for k in keys}


EXCLUSIONS = [
    (["/dir"], ["/dir/keep"], False, {"/dir/keep": False, "/dir": False, "/dir/other": True, "/x/dir": False}),
    (["*.log", "tmp"], [], False, {"/a.log": True, "/a.LOG": False, "/tmp/x": True, "/x/tmp/y/z": True, "/tmpx": False}),
    (["*.LOG"], [], True, {"/a/b.log": True}),
    (["/a/*/c?"], [], False, {"/a/b/cd": True, "/a/b/c": False, "/a/b/x/cd": False, "/a/b/cd/e": True}),
    (["data"], ["*.txt"], False, {"/data/a.txt": True, "/data.txt": False}),
]


@pytest.mark.parametrize(("exclude", "exceptions", "ignore_case", "want"), EXCLUSIONS)
def test_exclusions(spark, exclude, exceptions, ignore_case, want):
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", excluded(F.col("p"), exclude, exceptions, ignore_case).alias("x")).collect()
    assert {r.p: r.x for r in rows} == want


def test_glob_against_fnmatch(spark):
    import fnmatch
    import itertools

    names = ["".join(x) for n in range(1, 4) for x in itertools.product("ab.", repeat=n)]
    df = spark.createDataFrame([(f"/{n}",) for n in names], "p string")
    for pattern in ("a*", "*b", "?", "a?b", "*.*", "a.b"):
        got = {r.p[1:] for r in df.where(path_matches(F.col("p"), pattern)).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}


def test_resolve_images(spark):
    images = spark.createDataFrame([(1, "2"), (2, "b"), (3, "")], "image_index int, name string")
    index = lambda w: sorted(r.image_index for r in select.resolve_images(images, w).collect())
    assert index("ALL") == index("*") == [1, 2, 3] and index("2") == [2] and index("b") == [2] and index("9") == [] and index("") == []


def test_lookup_prefers_exact_case(spark):
    entries = spark.createDataFrame([("/A",), ("/a",), ("/B",)], "path string")
    got = select.lookup_paths(entries, spark.createDataFrame([("/a",), ("/b",), ("/c",)], "wanted string"))
    assert {r.wanted: r.path for r in got.collect()} == {"/a": "/a", "/b": "/B"}


def test_materialise_paths_leaves_cycles_out(spark):
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "id long, parent_id long, name string")
    assert {r.path: r.depth for r in select.materialise_paths(nodes).collect()} == {"/r": 1, "/r/a": 2, "/r/a/b": 3}


def test_hard_links(spark):
    rows = [(7, "h", False, 1), (7, "h", False, 2), (7, "g", False, 3), (0, "h", False, 4), (0, "h", False, 5), (7, "h", True, 6), (7, None, False, 8), (7, None, False, 9)]
    got = {r.entry_id: (r.inode, r.nlink) for r in dedup.hard_links(spark.createDataFrame(rows, "link_id long, hash string, is_directory boolean, entry_id long")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 8: (8, 2), 9: (8, 2)}


def test_reference_twice_changes_nothing(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "hash string, size long")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "hash string, size long")
    first = combine.reference(a, [b])
    assert sorted(tuple(r) for r in first.collect()) == [("x", 1, False), ("y", 2, False), ("z", 3, True)]
    assert combine.reference(first.drop("is_external"), [b]).count() == 3


def test_split_then_join(spark):
    sizes = [40, 50, 10, 200, 1]
    blobs = spark.createDataFrame([(i, s, False) for i, s in enumerate(sizes)], "ordinal long, size long, is_metadata boolean")
    parts = combine.split_parts(blobs, 100)
    assert [r.part_number for r in parts.orderBy("ordinal").collect()] == [1, 1, 2, 3, 4]
    whole = parts.withColumn("guid", F.lit("g")).withColumn("total_parts", F.lit(4))
    assert combine.join_parts(whole).count() == 5
    with pytest.raises(ValueError):
        combine.join_parts(whole.where("part_number <> 2"))


TREE = [("/", True), ("/a", True), ("/a/x", False), ("/b", True), ("/f", False)]


def test_rename_and_delete(spark):
    entries = spark.createDataFrame(TREE, "path string, is_directory boolean")
    names = lambda df: sorted(r.path for r in df.collect())
    moved = combine.rename_path(entries, "/a", "/b")
    assert names(moved) == ["/", "/b", "/b/x", "/f"] and names(combine.rename_path(combine.rename_path(entries, "/a", "/c"), "/c", "/a")) == names(entries)
    for old, new, error in (("/f", "/a", IsADirectoryError), ("/a", "/f", NotADirectoryError), ("/b", "/a", OSError), ("/a", "/a/y", ValueError), ("/no", "/x", FileNotFoundError)):
        with pytest.raises(error):
            combine.rename_path(entries, old, new)
    with pytest.raises(IsADirectoryError):
        combine.delete_path(entries, "/a")
    assert names(combine.delete_path(entries, "/a", recursive=True)) == ["/", "/b", "/f"]
    assert combine.delete_path(entries, "/no", force=True).count() == 5


def test_update_is_all_or_nothing(spark):
    entries = spark.createDataFrame(TREE, "path string, is_directory boolean")
    new = spark.createDataFrame([("/n", False)], "path string, is_directory boolean")
    got = combine.update(entries, [{"op": "add", "tree": new, "at": "/b"}, {"op": "rename", "old": "/b", "new": "/c"}, {"op": "delete", "path": "/f"}])
    assert sorted(r.path for r in got.collect()) == ["/", "/a", "/a/x", "/c", "/c/n"]
    with pytest.raises(FileNotFoundError):
        combine.update(entries, [{"op": "delete", "path": "/f"}, {"op": "delete", "path": "/f"}])


def test_overlay(spark):
    entries = spark.createDataFrame(TREE, "path string, is_directory boolean")
    assert {r.origin for r in combine.overlay(entries, entries).collect()} == {"both"}
    with pytest.raises(Exception, match="file and a directory"):
        combine.overlay(entries, spark.createDataFrame([("/a", False)], "path string, is_directory boolean")).collect()


def test_delete_images_moves_the_boot_index(spark):
    images = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "image_index int, name string")
    left, boot = combine.delete_images(images, [2, 3], boot_index=5)
    assert [(r.image_index, r.name) for r in left.orderBy("image_index").collect()] == [(1, "n1"), (2, "n4"), (3, "n5")] and boot == 3
    assert combine.delete_images(images, [5], boot_index=5)[1] == 0


def test_properties(spark):
    images = spark.createDataFrame([(1, {"NAME": "a"}), (2, {"NAME": "b"})], "image_index int, properties map<string,string>")
    assert combine.set_property(images, 1, "DESCRIPTION", "x").where("image_index = 1").first().properties == {"NAME": "a", "DESCRIPTION": "x"}
    assert combine.set_property(images, 1, "NAME", "").where("image_index = 1").first().properties == {}
    with pytest.raises(ValueError):
        combine.set_property(images, 1, "NAME", "b")


def test_global_rank(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.k + 1 == r["rank"] for r in durable.global_rank(rows, [F.col("k")]).collect())


def test_compare_images_is_not_symmetric(spark):
    schema = "path string, stream_name string, hash string, descriptor string, attributes long"
    a = spark.createDataFrame([("/f", "", "h", None, 0x220), ("/g", "", "h", "d", 0x20)], schema)
    b = spark.createDataFrame([("/f", "", "h", "gained", 0x20), ("/f", "s", "x", None, 0x20), ("/g", "", "h", "other", 0x20)], schema)
    assert {(r.path, r.difference) for r in verify.compare_images(a, b).collect()} == {("/g", "descriptor")}
    assert {(r.path, r.stream_name, r.difference) for r in verify.compare_images(b, a).collect()} == {("/f", "", "descriptor"), ("/f", "s", "missing stream"), ("/g", "", "descriptor")}
    assert verify.compare_images(a, a).count() == 0


def test_sparse_regions(spark):
    data = bytearray(b"x" * 4096 + bytes(8192) + b"y" * 10)
    got = layout.sparse_regions(spark.createDataFrame([("h", data)], "hash string, content binary")).orderBy("start").collect()
    assert [(r.is_zero, r.start, r.size) for r in got] == [(False, 0, 4096), (True, 4096, 8192), (False, 12288, 10)]


def test_integrity_reuse(spark):
    files = spark.createDataFrame([(1, "a" * 25)], "id long, content string")
    chunks = verify.integrity_chunks(files, 10)
    assert [r.length for r in chunks.orderBy("chunk_no").collect()] == [10, 10, 5]
    assert [r.is_reused for r in verify.refresh_integrity(chunks, chunks, 10).orderBy("chunk_no").collect()] == [True, True, False]


def entry(path, attributes=0x20, content=None, **more):
    digest = hashlib.sha1(content).digest() if content else None
    return {"path": path, "attributes": attributes, "streams": [(0, None, digest), *more.pop("named", [])], **more}


def make_archive(**more):
    one, two = b"first file", b"second"
    entries = [
        entry("/", 0x10), entry("/dir", 0x10, security_id=0), entry("/dir/a.txt", content=one, link_id=5, short_name="A~1.TXT", created=1, written=2, accessed=3),
        entry("/dir/b.txt", content=one, link_id=5, extra={0x337DD873: b"u" * 16}, named=[(1, "alt", hashlib.sha1(two).digest())]), entry("/empty"), entry("/link", 0x420, content=two, reparse_tag=0xA000000C),
    ]
    return archive.build_archive([({"NAME": "first", "FILECOUNT": 4}, entries, [b"sd-bytes"]), ({"NAME": "<2>"}, [entry("/", 0x10)], [])], [one, two, one], **more)


def test_archive_round_trip(spark, tmp_path):
    (tmp_path / "x.archive").write_bytes(make_archive(chunk=100))
    at = str(tmp_path / "x.archive")
    read = lambda t: archive.read_archives(spark, at, t)
    h = read("header").first()
    assert (h.image_count, h.part_number, h.total_parts, h.boot_index, h.is_pipable) == (2, 1, 1, 0, False)
    blobs = read("blobs").collect()
    assert [(r.size, r.refcnt) for r in blobs if not r.flags & archive.METADATA] == [(10, 2), (6, 2)]
    got = {(r.image_index, r.path): r for r in read("entries").collect()}
    assert set(p for i, p in got if i == 1) == {"/", "/dir", "/dir/a.txt", "/dir/b.txt", "/empty", "/link"}
    a, b, link = (got[1, p] for p in ("/dir/a.txt", "/dir/b.txt", "/link"))
    assert bytes(a.streams[0].hash) == hashlib.sha1(b"first file").digest() and (a.created, a.written, a.accessed, a.short_name, a.link_id) == (1, 2, 3, "A~1.TXT", 5)
    assert b.streams[1].name == "alt" and bytes(b.extra[0x337DD873]) == b"u" * 16 and bytes(got[1, "/dir"].descriptor) == b"sd-bytes"
    assert link.reparse_tag == 0xA000000C and not link.is_directory and a.reparse_tag is None and got[1, "/empty"].streams[0].hash is None
    assert all(r.is_intact for r in read("integrity").collect()) and read("integrity").count() > 1
    images = archive.image_properties(read("xml")).orderBy("image_index").collect()
    assert [(r.image_index, r.name, r.file_count) for r in images] == [(1, "first", 4), (2, "<2>", None)]


def test_broken_archives():
    data = make_archive()
    for bad in (b"", b"x" * 300, data[:8] + b"\0" * 4 + data[12:], data[:40] + b"\2\0" + data[42:]):
        with pytest.raises(archive.BadArchive):
            archive.parse_header(bad)
    header = archive.parse_header(data)
    at = next(o for _, _, _, _, _, o, _, f, _ in archive.parse_blobs(data, header) if f & archive.METADATA)
    with pytest.raises(archive.BadArchive):
        list(archive._entries(data[:at] + b"\1" + data[at + 1 :], header))
    flipped = data[:300] + bytes([data[300] ^ 1]) + data[301:]
    assert not all(ok for *_, ok in archive.parse_integrity(flipped, header))


def test_hostile_names_are_left_out():
    entries = [entry("/", 0x10), entry("/ok"), entry("/.."), entry("/ok", attributes=0x21), entry("/plain")]
    meta = archive.build_metadata(entries, [])
    assert [e["path"] for e in archive.parse_metadata(meta)] == ["/", "/ok", "/plain"] and archive.parse_metadata(meta)[1]["attributes"] == 0x20


def test_machine(spark):
    program = bytearray(b"MZ" + bytes(58) + (0x80).to_bytes(4, "little") + bytes(64) + b"PE\0\0" + (0x8664).to_bytes(2, "little"))
    got = spark.createDataFrame([(program,), (bytearray(b"no"),)], "c binary").select(archive.machine_of(F.col("c"))).collect()
    assert [r[0] for r in got] == [0x8664, None]


def test_text_lists(spark, tmp_path):
    (tmp_path / "c.ini").write_text("top\n[One]\n# no\n  a b \n;x\n'quoted'\n\n[Two]\nlast")
    got = text.read_sections(spark, str(tmp_path / "c.ini")).orderBy("line_no").collect()
    assert [(r.section, r.line) for r in got] == [(None, "top"), ("One", "a b"), ("One", "quoted"), ("Two", "last")]
    assert text.source_list("a b\n'x y' /z\n# c\nalone") == [("a", "b"), ("x y", "/z"), ("alone", "alone")]
    assert text.update_commands("add src /dst --no-replace\ndelete --force 'a b'\nrename x y")[1] == {"op": "delete", "path": "a b", "force": True}
    with pytest.raises(ValueError):
        text.update_commands("move a b")
    for encoding in ("utf-8", "utf-8-sig", "utf-16"):
        assert text.decode_text("häuser".encode(encoding)) == "häuser"
    assert text.decode_text("plain text".encode("utf-16-le")) == "plain text"


def test_scan_and_write_tree(spark, tmp_path):
    for name, data in (("in/a.txt", b"1"), ("in/sub/b.log", b"2"), ("in/sub/c", b"")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = tree.scan_tree(spark, f"{tmp_path}/in", exclude=["*.log"])
    assert {r.path: (r.size, r.hash) for r in got.collect()} == {"/a.txt": (1, hashlib.sha1(b"1").hexdigest()), "/sub/c": (0, None)}
    tree.write_tree(got, f"{tmp_path}/out")
    assert (tmp_path / "out/a.txt").read_bytes() == b"1" and (tmp_path / "out/sub/c").exists()


def test_empty_files_are_found_in_few_calls(spark, tmp_path, monkeypatch):
    names = ["d/_hidden", "d/a\nb %20", "top", *(f"d/e/{i}" for i in range(200))]
    for name in [*names, "d/full"]:
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" if name == "d/full" else b"")
    client, calls = spark.sparkContext._gateway._gateway_client, []
    monkeypatch.setattr(client, "send_command", lambda *a, f=client.send_command, **b: calls.append(a) or f(*a, **b))
    found = dict(tree.empty_files(spark, str(tmp_path)))
    assert found == {f"file:{tmp_path}/{n}": (tmp_path / n).stat().st_mtime_ns // 1_000_000 for n in names}
    assert 0 < len(calls) < len(names)


def test_written_tree_is_dealt_out(spark, tmp_path):
    entries = spark.createDataFrame([(f"/d/{i}", f"{i}".encode()) for i in range(40)], "path string, content binary")
    spark.sparkContext.setJobGroup("written", "")
    tree.write_tree(entries, f"{tmp_path}/out", 5)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("written")
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert 5 in [s.numTasks for s in stages if s]
    assert {p.read_bytes() for p in (tmp_path / "out/d").iterdir()} == {f"{i}".encode() for i in range(40)}


def test_random_tree_is_a_tree(spark):
    nodes = tree.random_tree(spark, 300, seed=4)
    assert select.materialise_paths(nodes).count() == 300
    assert nodes.join(nodes.select(F.col("id").alias("parent_id"), F.col("is_directory").alias("up")), "parent_id").where("not up").isEmpty()


def test_stream_ends_early(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    needed = spark.createDataFrame([(3,), (7,)], "id long")
    extract.extract_stream(stream, needed, "id", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.id for r in extract.extracted(spark, f"{tmp_path}/out", needed, "id").collect()) == [3, 7]
    with pytest.raises(EOFError):
        extract.extracted(spark, f"{tmp_path}/out", spark.createDataFrame([(99,)], "id long"), "id")
