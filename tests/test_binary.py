"""Binary records, encodings and registry hives."""

import struct

import pytest
from pyspark.sql import functions as F

from lodestack.functions import binary, texts
from lodestack.functions.values import UNIX_DATA_TAG
from lodestack.sources import registry


def test_tagged_items_and_unix_data(spark):
    df = spark.createDataFrame([({UNIX_DATA_TAG: bytearray(struct.pack("<4I", 1000, 100, 0o100644, 7)), 5: bytearray(b"x")},), ({},)], "extra map<bigint,binary>")
    got = df.select(binary.unix_data(F.col("extra")).alias("u"), binary.tagged_item(F.col("extra"), 5, 2).alias("short")).collect()
    assert tuple(got[0].u) == (1000, 100, 0o100644, 7) and got[0].short is None and got[1].u is None
    new = df.select(binary.with_tagged_item(F.col("extra"), 5, binary.unix_bytes(*(F.lit(x).cast("long") for x in (1, 2, 3, 70000)))).alias("e")).first().e
    assert bytes(new[5]) == struct.pack("<4I", 1, 2, 3, 70000) and len(new) == 2


def test_reparse_round_trip(spark):
    df = spark.createDataFrame([("\\??\\C:\\dir", "C:\\dir", False), ("..\\é", "..\\é", True)], "s string, p string, r boolean")
    made = df.select("*", binary.make_reparse_link(F.col("s"), F.col("p"), F.col("r")).alias("d"))
    for r in made.select("s", "p", "r", binary.reparse_link(F.lit(binary.SYMLINK), F.col("d")).alias("x")).collect():
        assert tuple(r.x) == (r.s, r.p, r.r)
    assert made.select(binary.reparse_link(F.lit(1), F.col("d")).alias("x")).first().x is None


def test_lone_surrogates_pass_both_ways(spark):
    raw = "a\ud800b".encode("utf-16-le", "surrogatepass")
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "n binary")
    got = df.select(texts.utf16_of_utf8(texts.utf8_of_utf16("n")).alias("n"), texts.shown_utf16("n").alias("t")).collect()
    assert bytes(got[0].n) == raw and got[0].t == "a\ufffdb" and got[1].n is None


def test_xml_escaped(spark):
    assert spark.createDataFrame([('a<b>&"\x01c',)], "t string").select(binary.xml_escaped(F.col("t"))).first()[0] == "a&lt;b&gt;&amp;&quot;c"


def make_hive() -> bytes:
    """A hive with key A\\B that has a text and a number."""
    cells, at = [], 32

    def put(raw: bytes) -> int:
        nonlocal at
        raw += b"\0" * (-(len(raw) + 4) % 8)
        cells.append(struct.pack("<i", -(len(raw) + 4)) + raw)
        here, at = at, at + len(raw) + 4
        return here

    def key(name: bytes, subkeys: list[int], values: list[int]) -> int:
        listed = put(b"lf" + struct.pack("<H", len(subkeys)) + b"".join(struct.pack("<I4s", s, b"hash") for s in subkeys)) if subkeys else 0xFFFFFFFF
        table = put(struct.pack(f"<{len(values)}I", *values)) if values else 0xFFFFFFFF
        head = bytearray(76)
        head[:2] = b"nk"
        struct.pack_into("<H", head, 2, 0x20)
        struct.pack_into("<I", head, 20, len(subkeys))
        struct.pack_into("<I", head, 28, listed)
        struct.pack_into("<II", head, 36, len(values), table)
        struct.pack_into("<H", head, 72, len(name))
        return put(bytes(head) + name)

    def value(name: bytes, kind: int, data: bytes) -> int:
        inline = len(data) <= 4
        where = int.from_bytes(data.ljust(4, b"\0"), "little") if inline else put(data)
        return put(b"vk" + struct.pack("<HIIIHH", len(name), len(data) | (inline << 31), where, kind, 1, 0) + name)

    b = key(b"B", [], [value(b"text", 1, "hello\0".encode("utf-16-le")), value(b"num", 4, struct.pack("<I", 77))])
    root = key(b"ROOT", [key(b"A", [b], [])], [])
    head = bytearray(4096)
    head[:4] = b"regf"
    struct.pack_into("<I", head, 36, root)
    return bytes(head) + bytes(32) + b"".join(cells)


def test_registry(spark):
    files = spark.createDataFrame([("h", bytearray(make_hive()))], "path string, content binary")
    got = registry.read_hives(files).collect()
    assert {r.key for r in got} == {"", "\\A", "\\A\\B"}
    assert {(r.value_name, r.text, r.number) for r in got if r.value_name} == {("text", "hello", None), ("num", None, 77)}


def test_broken_hives():
    data = make_hive()
    for bad in (b"", data[:4100], data[:36] + struct.pack("<I", 1 << 30) + data[40:]):
        with pytest.raises(registry.BadHive):
            list(registry.Hive(bad).walk())
