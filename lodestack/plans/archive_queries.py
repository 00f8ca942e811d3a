"""Further registered queries: archives as files, records and names, write plans, commands on images.

Suppliers stand for the files of small archives, one archive for each region and an image for each nation in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..archive import Archive
from ..functions import binary, paths, values
from ..operators import combine, dedup, iterate, layout, select, verify, writing
from ..sources import archive as files
from ..sources import codecs, registry, text, tree
from .queries import _EXTENTS, _FILES, _PAGES, _extents, _files, _pages, _query, _table

# --- archives as files


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the archives: archive (region), image_index, image_name (nation), path, content (text)."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("archive"), F.col("n_nationkey").cast("int").alias("image_index"), F.col("n_name").alias("image_name"))
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("image_index"), F.concat(F.lit("/d"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/"), "s_name").alias("path"), F.repeat(F.concat("s_name", F.lit(" ")), (F.col("s_suppkey") % 7).cast("int") * 40).alias("content"))
    return nation.join(supplier, "image_index").select("archive", "image_index", "image_name", "path", "content")


_SUPPLIED = """(SELECT 'r' || n_regionkey AS archive, n_nationkey, n_name, '/d' || (s_suppkey % 3) || '/' || s_name AS path, repeat(s_name || ' ', (s_suppkey % 7 * 40)::INTEGER) AS content,
    dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS image_index FROM nation JOIN supplier ON s_nationkey = n_nationkey)"""


def _archives(spark: SparkSession, sf_dir: str, chunk: int = 0, kind: int = codecs.XPRESS_FLAG, solid: bool = False) -> DataFrame:
    from .durable import materialise

    made = files.build_archives(_supplied(spark, sf_dir).withColumn("content", F.encode("content", "UTF-8")), chunk, kind, solid, boot_index=1)
    return materialise(made, "archives")


@_query(f"SELECT archive, 68864::BIGINT AS version, count(DISTINCT n_nationkey)::INTEGER AS image_count, 1 AS part_number, 1 AS total_parts, 1 AS boot_index, 32768::BIGINT AS chunk_size, (262144 + 2)::BIGINT AS flags FROM {_SUPPLIED} GROUP BY archive")
def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.parse_archives(_archives(spark, sf_dir, 32768, codecs.LZX_FLAG), "header")
    return found.select("archive", "version", "image_count", "part_number", "total_parts", "boot_index", "chunk_size", "flags")


@_query(f"""
    SELECT archive, sha1(content) AS hash, octet_length(encode(content))::BIGINT AS size, count(*) AS refcnt FROM {_SUPPLIED} WHERE content <> '' GROUP BY archive, content""")
def archive_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob tables of archives whose contents are one solid resource each."""
    found = files.parse_archives(_archives(spark, sf_dir, 32768, codecs.XPRESS_FLAG, solid=True), "blobs").where(F.col("flags").bitwiseAND(F.lit(files.METADATA)) == 0)
    return found.select("archive", F.lower(F.hex("hash")).alias("hash"), "size", "refcnt")


@_query(f"""
    WITH s AS {_SUPPLIED}, f AS (SELECT archive, image_index, path, false AS is_directory, CASE WHEN content <> '' THEN sha1(content) END AS hash FROM s
      UNION ALL SELECT DISTINCT archive, image_index, left(path, 3), true, NULL FROM s UNION ALL SELECT DISTINCT archive, image_index, '/', true, NULL FROM s)
    SELECT archive, image_index::INTEGER AS image_index, path, is_directory, hash FROM f""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.parse_archives(_archives(spark, sf_dir, 32768, codecs.LZX_FLAG), "entries")
    return found.select("archive", "image_index", "path", "is_directory", F.lower(F.hex(F.col("streams")[0]["hash"])).alias("hash"))


_CONTENTS = f"SELECT DISTINCT archive, sha1(content) AS hash, octet_length(encode(content))::BIGINT AS size, content, true AS is_intact FROM {_SUPPLIED} WHERE content <> ''"


def _contents(found: DataFrame) -> DataFrame:
    return found.select("archive", F.lower(F.hex("hash")).alias("hash"), "size", F.decode("content", "UTF-8").alias("content"), "is_intact")


@_query(_CONTENTS)
def contents_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(files.parse_archives(_archives(spark, sf_dir), "contents"))


@_query(_CONTENTS)
def contents_xpress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(files.parse_archives(_archives(spark, sf_dir, 4096), "contents"))


@_query(_CONTENTS)
def contents_lzx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(files.parse_archives(_archives(spark, sf_dir, 32768, codecs.LZX_FLAG), "contents"))


@_query(_CONTENTS)
def contents_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(files.parse_archives(_archives(spark, sf_dir, 32768, codecs.LZX_FLAG, solid=True), "contents"))


@_query(f"""
    SELECT DISTINCT archive, sha1(content) AS hash, octet_length(encode(content)) // 3 AS first, substr(content, (octet_length(encode(content)) // 3 + 1)::INTEGER, 50) AS part FROM {_SUPPLIED} WHERE content <> ''""")
def resource_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty bytes from a third on of every blob, out of compressed resources."""
    made = _archives(spark, sf_dir, 4096)
    blobs = files.parse_archives(made, "blobs").where(F.col("flags").bitwiseAND(F.lit(files.METADATA)) == 0)
    first = F.floor(F.col("size") / 3)
    found = files.read_ranges(made, blobs.select(F.col("archive").alias("path"), "hash", first.alias("first"), (first + 50).alias("end")))
    return found.select(F.col("path").alias("archive"), F.lower(F.hex("hash")).alias("hash"), "first", F.decode("bytes", "UTF-8").alias("part"))


@_query(f"SELECT archive, image_index::INTEGER AS image_index, any_value(n_name) AS name, count(DISTINCT left(path, 3)) AS dir_count, count(*) AS file_count FROM {_SUPPLIED} GROUP BY archive, image_index")
def archive_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.image_properties(files.parse_archives(_archives(spark, sf_dir), "xml"))
    return found.select("archive", "image_index", "name", "dir_count", "file_count")


@_query(f"SELECT archive, 1::BIGINT AS n_chunks, true AS all_intact FROM {_SUPPLIED} GROUP BY archive")
def archive_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.parse_archives(_archives(spark, sf_dir), "integrity")
    return found.groupBy("archive").agg(F.count(F.lit(1)).alias("n_chunks"), F.bool_and("is_intact").alias("all_intact"))


@_query("SELECT '/f/' || s_suppkey || '.txt' AS path, length(s_name) AS size, sha1(s_name) AS hash FROM supplier")
def tree_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers written as files of a directory tree and scanned again; the nations' files beside them are excluded."""
    from .durable import new_path

    root, tasks = new_path(spark, "tree/f/tree"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = lambda mark, table, key, name: _table(spark, sf_dir, table).select(F.concat(F.lit(mark), F.col(key).cast("string"), F.lit(".txt")).alias("path"), F.encode(name, "UTF-8").alias("content"))
    tree.write_tree(named("/f/", "supplier", "s_suppkey", "s_name").unionByName(named("/tmp/", "nation", "n_nationkey", "n_name")), root, tasks)
    return tree.scan_tree(spark, root, ["/tmp"]).select("path", "size", "hash").coalesce(tasks)  # a scan has a task for every 32 small files


@_query("SELECT r_regionkey AS region, '/' || s_name AS path, s_suppkey AS size FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of source lists (a supplier and its target), written and parsed again."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    rows = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("'"), F.col("s_suppkey").cast("string"), F.lit("' \"/"), "s_name", F.lit('"'))

    @F.pandas_udf("array<struct<source:string,target:string>>")
    def parsed(lists):
        return lists.map(lambda x: [{"source": s, "target": t} for s, t in text.source_list(x)])

    lists = rows.groupBy("region", F.pmod(F.col("s_suppkey"), F.lit(64)).alias("list_no")).agg(F.concat(F.lit("# a list\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("list"))
    return lists.select("region", F.explode(parsed("list")).alias("x")).select("region", F.col("x.target").alias("path"), F.col("x.source").cast("long").alias("size"))


@_query("SELECT n_nationkey AS n, 'rename' AS op, '/old ' || n_name AS old, '/new/' || n_name AS new FROM nation")
def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<op:string,old:string,new:string>")
    def parsed(lines):
        import pandas as pd

        return pd.DataFrame([{k: c[k] for k in ("op", "old", "new")} for line in lines for c in text.update_commands(line)])

    line = F.concat(F.lit("# move\nrename '/old "), "n_name", F.lit("' '/new/"), "n_name", F.lit("'"))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), parsed(line).alias("c")).select("n", "c.*")


@_query("SELECT 'k' || n_regionkey AS key, n_name AS value_name, n_nationkey AS number FROM nation")
def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as numbers below a key for each region in a hive that is made and read."""
    import struct

    def hive(rows) -> bytes:
        cells = bytearray()

        def cell(body: bytes) -> int:
            at = len(cells) + 32
            size = -(-(len(body) + 4) // 8) * 8
            cells.extend(struct.pack("<i", -size) + body + bytes(size - 4 - len(body)))
            return at

        def key(name: str, subkeys: list[int], values: list[int]) -> int:
            listed = cell(b"lf" + struct.pack("<H", len(subkeys)) + b"".join(struct.pack("<I4x", s) for s in subkeys)) if subkeys else 0xFFFFFFFF
            table = cell(b"".join(struct.pack("<I", v) for v in values)) if values else 0xFFFFFFFF
            raw = b"nk" + struct.pack("<H", 0x20) + bytes(16) + struct.pack("<IIIIII", len(subkeys), 0, listed, 0xFFFFFFFF, len(values), table) + bytes(28) + struct.pack("<HH", len(name), 0) + name.encode("latin-1")
            return cell(raw)

        regions: dict[str, list[int]] = {}
        for region, name, number in rows:
            raw = name.encode("latin-1")
            regions.setdefault(f"k{region}", []).append(cell(b"vk" + struct.pack("<HIIIHH", len(raw), 0x80000004, number, 4, 1, 0) + raw))
        root = key("root", [key(k, [], v) for k, v in sorted(regions.items())], [])
        return b"regf" + bytes(32) + struct.pack("<I", root) + bytes(4096 - 40) + b"hbin" + bytes(28) + bytes(cells)

    rows = sorted(map(tuple, _table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey").collect()))  # a fixed table of 25 rows
    made = spark.createDataFrame([("h", hive(rows))], "path string, content binary")
    found = registry.read_hives(made).where("value_name is not null")
    return found.select(F.substring_index("key", "\\", -1).alias("key"), "value_name", "number")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 257) % 65536 ELSE -1 END AS machine FROM part")
def program_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine numbers out of the headers of programs made of parts; every third is none (-1)."""
    number = F.col("p_size") * 257 % 65536
    low, high = (F.lpad(F.hex(x.cast("long")), 2, "0") for x in (number % 256, F.floor(number / 256)))
    start = F.when(F.col("p_partkey") % 3 != 0, "4D5A").otherwise("4D5B")
    content = F.unhex(F.concat(start, F.lit("00" * 58 + "48000000" + "00" * 8), F.lit("50450000"), low, high, F.lit("00" * 8)))
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(files.machine_of(content), F.lit(-1)).alias("machine"))


# --- names, texts, numbers, records


@_query("""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ':ads' WHEN 1 THEN '..' WHEN 2 THEN 'a/' || p_name WHEN 3 THEN repeat('x', 130) WHEN 4 THEN '' ELSE p_name END AS name FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'ads' END AS stream, p_partkey % 6 NOT IN (1, 2, 4) AS is_valid, CASE WHEN p_partkey % 6 = 2 THEN replace(name, '/', '_') || ' (invalid filename #' || p_partkey || ')' ELSE name END AS fixed,
           CASE WHEN p_partkey % 6 IN (0, 5) THEN name ELSE p_partkey::VARCHAR END AS directory FROM n""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, own = F.col("p_partkey"), F.col("p_name")
    name = F.when(key % 6 == 0, F.concat(own, F.lit(":ads"))).when(key % 6 == 1, "..").when(key % 6 == 2, F.concat(F.lit("a/"), own)).when(key % 6 == 3, "x" * 130).when(key % 6 == 4, "").otherwise(own)
    n = _table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return n.select("p_partkey", F.when(~F.col("name").contains("/"), paths.stream_suffix("name")).alias("stream"), paths.valid_name("name").alias("is_valid"), paths.fixed_name("name", "p_partkey").alias("fixed"), paths.image_directory("name", "p_partkey").alias("directory"))


@_query("SELECT p_partkey, '/base/' || replace(p_name, ' ', '/') AS target, CASE WHEN p_partkey % 2 = 0 THEN 'C:\\' || p_name ELSE 'd' || p_partkey || '/f' END AS relative FROM part")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("\\??\\C:\\"), F.translate("p_name", " ", "\\"))
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C:/"), "p_name")).otherwise(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("\\f")))
    return _table(spark, sf_dir, "part").select("p_partkey", paths.link_target(shown, F.lit("/base")).alias("target"), paths.link_target(mixed).alias("relative"))


@_query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: printf('%02X00', ord(c))), '') AS utf16, p_name AS back FROM part")
def utf16_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("p_name", "UTF-16LE")
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex(raw).alias("utf16"), F.decode(raw, "UTF-16LE").alias("back"))


@_query("SELECT c_custkey, '\\??\\C:\\' || c_name AS substitute, c_name AS shown, c_custkey % 2 = 0 AS is_relative, 20 + 2 * (2 * length(c_name) + 7) - 8 AS size FROM customer")
def reparse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = binary.make_reparse_link(F.concat(F.lit("\\??\\C:\\"), "c_name"), F.col("c_name"), F.col("c_custkey") % 2 == 0)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", data.alias("data"))
    link = binary.reparse_link(F.lit(binary.SYMLINK), F.col("data"))
    return rows.select("c_custkey", link.alias("link"), F.octet_length("data").cast("long").alias("size")).select("c_custkey", F.col("link.substitute").alias("substitute"), F.col("link.print").alias("shown"), F.col("link.is_relative").alias("is_relative"), "size")


@_query("SELECT c_custkey, c_custkey % 1000 AS uid, c_nationkey AS gid, CASE WHEN c_custkey % 4 = 0 THEN 16877 ELSE 33188 END AS mode, c_custkey % 2 = 0 AS has_object_id FROM customer")
def tagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    packed = binary.unix_bytes(key % 1000, F.col("c_nationkey").cast("long"), F.when(key % 4 == 0, 0o40755).otherwise(0o100644).cast("long"), F.lit(0).cast("long"))
    none = F.create_map(F.lit(binary.XATTR_TAG).cast("long"), F.encode(F.lit("x"), "UTF-8"))
    extra = binary.with_tagged_item(none, values.UNIX_DATA_TAG, packed)
    extra = F.when(key % 2 == 0, binary.with_tagged_item(extra, binary.OBJECT_ID_TAG, F.unhex(F.lit("00" * 16)))).otherwise(extra)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", extra.alias("extra"))
    data = binary.unix_data(F.col("extra"))
    return rows.select("c_custkey", data["uid"].alias("uid"), data["gid"].alias("gid"), data["mode"].alias("mode"), binary.tagged_item(F.col("extra"), binary.OBJECT_ID_TAG, 16).isNotNull().alias("has_object_id"))


@_query("SELECT p_partkey, '&lt;' || p_name || '&gt; &amp; &quot;' AS escaped, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 16 + 10 ELSE 0 END AS number FROM part")
def xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    number = F.when(F.col("p_partkey") % 3 == 0, size.cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("0x"), F.hex(size), F.lit("A"))).otherwise(F.concat(size.cast("string"), F.lit(" x")))
    shown = binary.xml_escaped(F.concat(F.lit("<"), "p_name", F.lit('\x01> & "')))
    return _table(spark, sf_dir, "part").select("p_partkey", shown.alias("escaped"), values.number_of(number).cast("long").alias("number"))


@_query("""
    WITH t AS (SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 AS x FROM events)
    SELECT event_id, x AS filetime, '0x' || printf('%08X', x >> 32) AS high, '0x' || printf('%08X', x & 4294967295) AS low FROM t""")
def xml_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    half = lambda v: F.concat(F.lit("0x"), F.lpad(F.hex(v), 8, "0"))
    rows = _table(spark, sf_dir, "events").select("event_id", values.filetime_of(F.col("ts")).alias("x")).select("event_id", half(F.shiftright(x, 32)).alias("high"), half(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    return rows.select("event_id", values.filetime_of_parts(F.col("high"), F.col("low")).alias("filetime"), "high", "low")


@_query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de-DE' WHEN 2 THEN 'fr-FR' END AS language, CASE n_nationkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'integrity' WHEN 2 THEN 'invalid header' ELSE 'unknown error' END AS error FROM nation")
def named_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("n_nationkey") % 4
    language = F.when(turn == 0, 0x409).when(turn == 1, 0x407).when(turn == 2, 0x40C).otherwise(1)
    code = F.when(turn == 0, 0).when(turn == 1, 13).when(turn == 2, 17).otherwise(7)
    return _table(spark, sf_dir, "nation").select("n_nationkey", values.language_name(language).alias("language"), errors.error_text(code).alias("error"))


@_query("""
    WITH b AS (SELECT p_partkey, p_size % 4 AS head, p_size % 3 AS body, p_partkey % 2 AS tail FROM part), r AS (
      SELECT p_partkey, true AS is_zero, 0 AS start, head * 16 AS size FROM b UNION ALL SELECT p_partkey, false, head * 16, body * 16 FROM b WHERE tail = 1 OR body > 0
      UNION ALL SELECT p_partkey, true, (head + body) * 16, tail * 8 FROM b)
    SELECT p_partkey, is_zero, min(start)::BIGINT AS start, sum(size)::BIGINT AS size FROM (
      SELECT p_partkey, is_zero, start, size, CASE WHEN body = 0 THEN 0 WHEN is_zero AND start > 0 OR is_zero AND start = 0 AND size = tail * 8 AND head = 0 THEN 2 ELSE 1 END AS run
      FROM r JOIN b USING (p_partkey) WHERE size > 0) GROUP BY p_partkey, is_zero, CASE WHEN is_zero AND start > 0 AND run = 2 THEN 2 ELSE 0 END""")
def sparse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero and other runs of contents that have zeroes in front, letters, and perhaps half a unit of zeroes at the end."""
    size, unit = F.col("p_size"), 16
    zeroes = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    body = F.unhex(F.concat(zeroes(size % 4 * unit), F.repeat(F.lit("41"), (size % 3 * unit).cast("int")), zeroes(F.col("p_partkey") % 2 * 8)))
    blobs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), body.alias("content"))
    return layout.sparse_regions(blobs, unit).select(F.col("hash").alias("p_partkey"), "is_zero", "start", "size")


# --- plans for writing


_STATUS = f"""
    WITH f AS {_FILES}, b AS (SELECT hash, min(size) AS size FROM f WHERE id % 2 = 0 GROUP BY hash)
    SELECT hash, size, CASE WHEN hash IN (SELECT hash FROM f WHERE id % 3 = 0) THEN 'already here' WHEN hash IN (SELECT hash FROM f WHERE id % 5 = 0) THEN 'elsewhere' ELSE 'written' END AS status FROM b"""


@_query(_STATUS)
def output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark, sf_dir)
    blobs = dedup.dedup_blobs(own.where("id % 2 = 0")).select("hash", "size")
    return writing.output_filter(blobs, own.where("id % 3 = 0"), own.where("id % 5 = 0"), skip_external=True)


@_query(f"SELECT res, start AS \"offset\", size AS stored, l_partkey, l_suppkey FROM (SELECT *, l_linenumber * 40 AS start FROM {_EXTENTS}) WHERE start + size > 250")
def append_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extents(spark, sf_dir).select("res", (F.col("l_linenumber") * 40).cast("long").alias("offset"), F.col("size").alias("stored"), "l_partkey", "l_suppkey")
    return writing.resources_past(rows, 250)


@_query("SELECT n_nationkey AS image_index, CASE WHEN n_nationkey % 5 = 0 THEN upper(n_name) || '!' ELSE n_name END AS metadata_hash FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey > 20")
def changed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_index"), F.col("n_name").alias("metadata_hash"))
    now = nation.withColumn("metadata_hash", F.when(F.col("image_index") % 5 == 0, F.concat(F.upper("metadata_hash"), F.lit("!"))).otherwise(F.col("metadata_hash")))
    return writing.changed_images(now, nation.where("image_index <= 20"))


@_query("""SELECT * FROM (VALUES ('append', 0, false), ('rebuild', 1, false), ('compact', 0, true), ('rebuild', 2, false)) AS t(strategy, deleted, compaction)""")
def overwrite_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies for an archive whose resources are the line items' extents, which end before 400; the last one's end inside."""
    rows = _extents(spark, sf_dir).select((F.col("l_linenumber") * 40).alias("offset"), F.col("size").alias("stored"))
    cases = ((400, 0, False), (400, 1, False), (400, 0, True), (250, 2, False))
    return spark.createDataFrame([(writing.overwrite_strategy(rows, end, gone, wants_compaction=c), gone, c) for end, gone, c in cases], "strategy string, deleted int, compaction boolean")


@_query(f"SELECT count(*) AS n_blobs, sum(size)::BIGINT AS n_bytes, count(DISTINCT source) AS n_parts, count(*) FILTER (id % 3 = 0) AS n_compressed FROM {_FILES}")
def write_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.write_stats(_files(spark, sf_dir).select("size", F.col("source").alias("part_number"), (F.col("id") % 3 == 0).alias("is_compressed")))


@_query("SELECT s_nationkey AS archive, bool_or(s_suppkey % 10 = 0) AS has_solid FROM supplier GROUP BY s_nationkey")
def has_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.has_solid(_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("archive"), (F.col("s_suppkey") % 10 == 0).alias("is_solid")))


@_query("""
    WITH s AS (SELECT conv_id AS path, sha1(text) AS hash FROM conversations)
    SELECT path, count(*) FILTER (hash NOT IN (SELECT sha1(text) FROM conversations WHERE conv_id % 3 = 0)) AS n_left, count(*) FILTER (hash NOT IN (SELECT sha1(text) FROM conversations WHERE conv_id % 3 = 0)) = 0 AS is_done FROM s GROUP BY path""")
def finished_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.sha1("text").alias("hash"))
    return writing.finished_files(streams, streams.where("path % 3 = 0"))


@_query(f"SELECT hash, row_number() OVER (ORDER BY size, source_no, hash) AS rank FROM (SELECT hash, min(size) AS size, min(length(source)) AS source_no FROM {_FILES} GROUP BY hash)")
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .durable import global_rank

    blobs = _files(spark, sf_dir).groupBy("hash").agg(F.min("size").alias("out_offset"), F.min(F.length("source")).alias("offset_in_res"))
    return global_rank(blobs, writing.output_order()).select("hash", "rank")


@_query(f"""
    WITH e AS (SELECT *, l_discount > 0.05 AS wanted FROM {_EXTENTS}), r AS (SELECT res, res % 4 <> 0 AND sum(CASE WHEN wanted THEN size ELSE 0 END) * 3 > sum(size) * 2 AS raw FROM e GROUP BY res)
    SELECT e.res, l_linenumber, l_partkey, l_suppkey, CASE WHEN raw THEN 'raw' WHEN wanted THEN 'again' ELSE 'dropped' END AS how FROM e JOIN r USING (res)""")
def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extents(spark, sf_dir).withColumn("wanted", F.col("l_discount") > 0.05)
    return writing.write_plan(rows, "res", F.col("res") % 4 != 0).select("res", "l_linenumber", "l_partkey", "l_suppkey", "how")


@_query(f"""
    SELECT res AS archive, l_linenumber, l_partkey, l_suppkey, (208 + coalesce(sum(size) OVER (PARTITION BY res ORDER BY l_linenumber * 100, l_partkey * 10000 + l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS new_offset FROM {_EXTENTS}""")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extents(spark, sf_dir).select(F.col("res").alias("archive"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("resource_no"), (F.col("l_linenumber") * 100).alias("offset"), F.col("size").alias("stored"), "l_linenumber", "l_partkey", "l_suppkey")
    return writing.compacted(rows, 208).select("archive", "l_linenumber", "l_partkey", "l_suppkey", "new_offset")


@_query("SELECT s_suppkey AS hash, s_nationkey AS image_index, s_suppkey % 10 = 0 AS is_metadata, row_number() OVER (ORDER BY s_nationkey, s_suppkey % 10 <> 0, s_suppkey) AS record_no FROM supplier")
def pipable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hash"), F.col("s_nationkey").alias("image_index"), (F.col("s_suppkey") % 10 == 0).alias("is_metadata"))
    return writing.pipable_order(rows)


# --- trees, links, parts


@_query("SELECT feature, n FROM (SELECT 'reparse' AS feature, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem UNION ALL SELECT 'large', count(*) FILTER (l_quantity > 40) FROM lineitem) WHERE n > 0")
def unsupported_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = dedup.feature_tally(_table(spark, sf_dir, "lineitem"), {"reparse": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "large": F.col("l_quantity") > 40, "none": F.col("l_quantity") > 1000})
    return dedup.unsupported(tally, {"open": True})


@_query(f"SELECT DISTINCT hash FROM {_FILES} WHERE hash NOT IN (SELECT hash FROM {_FILES} WHERE id % 3 = 0)")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark, sf_dir)
    return dedup.placeholders(own, own.where("id % 3 = 0"))


@_query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return combine.name_collisions(names.where("s_suppkey % 3 = 0").select("name"), names.where("s_suppkey % 2 = 0").select("name"))


@_query(f"SELECT 'g' AS guid, hash, min(size) AS size FROM {_FILES} GROUP BY hash")
def join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs dealt into the parts of a split archive and put together again."""
    blobs = dedup.dedup_blobs(_files(spark, sf_dir)).select("hash", "size")
    number = (F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % 3 + 1).alias("part_number")
    return combine.join_parts(blobs.select(F.lit("g").alias("guid"), number, F.lit(3).alias("total_parts"), "hash", "size")).select("guid", "hash", "size")


@_query("""
    WITH e AS (SELECT '/' || c_name AS path, c_nationkey AS inode FROM customer)
    SELECT path, inode, count(*) OVER (PARTITION BY inode) AS n_names, min(path) OVER (PARTITION BY inode) AS first_name FROM e""")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.aliases(_table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), "c_name").alias("path"), F.col("c_nationkey").alias("inode")))


@_query(f"""
    WITH f AS {_FILES}, n AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY length(path), path) AS k FROM f WHERE id % 4 <> 0)
    SELECT b.hash, n.path AS sort_name FROM (SELECT DISTINCT hash FROM f) b LEFT JOIN n ON n.hash = b.hash AND k = 1""")
def sort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark, sf_dir)
    return layout.sort_names(own.select("hash").distinct(), own.where("id % 4 <> 0"))


@_query("""
    WITH p AS (SELECT s_nationkey AS image, CASE WHEN s_suppkey % 4 = 0 THEN 'Windows' ELSE 'r' || (s_suppkey % 4) END AS root, s_suppkey % 3 AS mark FROM supplier),
    s AS (SELECT image, root, count(DISTINCT mark) AS score FROM p GROUP BY image, root)
    SELECT image, root, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, root = 'Windows' DESC, upper(root)) AS k FROM s) WHERE k = 1""")
def system_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("s_suppkey") % 4 == 0, "Windows").otherwise(F.concat(F.lit("r"), (F.col("s_suppkey") % 4).cast("string")))
    mark = F.element_at(F.array(F.lit("System32/Kernel.dll"), F.lit("system32/config/software"), F.lit("SYSTEM32/config/system")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image"), F.concat(F.lit("/"), root, F.lit("/"), mark).alias("path"))
    return select.system_roots(rows, ["system32/kernel.dll", "system32/config/software", "system32/config/system"], "Windows")


@_query(f"""
    WITH p AS (SELECT DISTINCT 'i' || (page_id % 3) AS image, path FROM {_PAGES}),
    k AS (SELECT *, list_transform(string_split(path, '/'), lambda c: translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS folded, string_split(path, '/') AS exact FROM p)
    SELECT image, path, row_number() OVER (PARTITION BY image ORDER BY folded, exact) AS place FROM k""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select(F.concat(F.lit("i"), (F.col("page_id") % 3).cast("string")).alias("image"), "path").distinct()
    return iterate.tree_numbers(rows).withColumn("place", F.col("place").cast("long"))


@_query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS inode_number FROM customer")
def inode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.number_inodes(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [F.col("c_nationkey"), F.col("c_custkey")]).select("c_custkey", "inode_number")


@_query("SELECT count(*) AS n_entries, (SELECT min(c_name) FROM customer) AS first_name FROM customer")
def iterate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks over a tree of customers: all are counted, and a second walk is ended by the first one."""
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), "c_name").alias("path"))
    seen: list[str] = []
    iterate.iterate_tree(rows, lambda r: seen.append(r["path"]))
    ended: list[str] = []
    iterate.iterate_tree(rows, lambda r: ended.append(r["path"]) or 1)
    return spark.createDataFrame([(len(seen), ended[0][1:])], "n_entries long, first_name string")


@_query("SELECT count(DISTINCT sha1(text)) AS n_blobs, (SELECT min(sha1(text)) FROM conversations) AS first_hash FROM conversations")
def iterate_blob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _table(spark, sf_dir, "conversations").select(F.sha1("text").alias("hash")).distinct()
    seen: list[str] = []
    iterate.iterate_blobs(blobs, lambda r: seen.append(r["hash"]))
    return spark.createDataFrame([(len(seen), seen[0])], "n_blobs long, first_hash string")


@_query(f"SELECT res, l_linenumber, l_partkey, l_suppkey FROM {_EXTENTS} WHERE l_linenumber * 40 + size > 300")
def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extents(spark, sf_dir).withColumn("start", (F.col("l_linenumber") * 40).cast("long"))
    return layout.out_of_bounds(rows, 300).select("res", "l_linenumber", "l_partkey", "l_suppkey")


@_query("""
    WITH a AS (SELECT c_custkey AS k, sha1(c_name) AS hash, CASE WHEN c_custkey % 2 = 0 THEN 'sd' END AS sd, 32 AS attr FROM customer WHERE c_custkey % 3 <> 0),
    b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE sha1(c_name) END AS hash, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'sd' END AS sd, CASE WHEN c_custkey % 5 = 0 THEN 544 ELSE 32 END AS attr FROM customer WHERE c_custkey % 3 <> 1)
    SELECT '/' || k AS path, '' AS stream_name, d AS difference FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing path' WHEN a.k IS NULL THEN 'extra path' WHEN a.hash <> b.hash THEN 'content'
      WHEN a.sd IS NOT NULL AND a.sd IS DISTINCT FROM b.sd THEN 'descriptor' WHEN b.attr = 544 THEN 'attributes' END AS d FROM a FULL JOIN b ON a.k = b.k) WHERE d IS NOT NULL""")
def compare_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison that isn't symmetric: a descriptor only in the second image is accepted."""
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/"), key.cast("string")).alias("path"), F.lit("").alias("stream_name"), F.sha1("c_name").alias("hash"))
    first = rows.where("c_custkey % 3 <> 0").select("path", "stream_name", "hash", F.when(key % 2 == 0, "sd").alias("descriptor"), F.lit(0x20).cast("long").alias("attributes"))
    second = rows.where("c_custkey % 3 <> 1").select("path", "stream_name", F.when(key % 7 == 0, "other").otherwise(F.col("hash")).alias("hash"), F.when(key % 4 != 0, "sd").alias("descriptor"), F.when(key % 5 == 0, 0x220).otherwise(0x20).cast("long").alias("attributes"))
    return verify.compare_images(first, second)


@_query("SELECT '/' || c_custkey AS path FROM customer WHERE c_custkey % 10 < 2 AND c_custkey + 1 - c_custkey % 10 * 2 IN (SELECT c_custkey FROM customer)")
def link_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten customers are an inode; in the second tree the second of each ten is linked to the first no more."""
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), key.cast("string")).alias("path"), F.when(key % 10 < 2, F.floor(key / 10) * 10).otherwise(key).alias("inode"), key.alias("other"))
    return verify.link_differences(rows.select("path", "inode"), rows.select("path", F.col("other").alias("inode"))).distinct()


# --- commands on archives


def _with_files(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive of one image, the parts as files below their brand."""
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.lit(False).alias("is_directory"), F.encode("p_type", "UTF-8").alias("content"))
    return Archive.create(spark).add_image("parts", rows, boot=True)


_PARTS = "SELECT '/' || p_brand || '/' || p_partkey AS path, false AS is_directory, sha1(p_type) AS hash FROM part"


@_query(f"{_PARTS} UNION ALL SELECT DISTINCT '/' || p_brand, true, NULL FROM part UNION ALL SELECT '/', true, NULL")
def add_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_files(spark, sf_dir).tree("parts").select("path", "is_directory", "hash")


@_query(f"""
    WITH p AS ({_PARTS}), b AS (SELECT min(p_brand) AS lo, max(p_brand) AS hi FROM part)
    SELECT replace(path, '/' || hi || '/', '/moved/') AS path, is_directory, hash FROM p, b WHERE NOT starts_with(path, '/' || lo || '/')
    UNION ALL SELECT DISTINCT CASE WHEN p_brand = hi THEN '/moved' ELSE '/' || p_brand END, true, NULL FROM part, b WHERE p_brand <> lo UNION ALL SELECT '/', true, NULL
    UNION ALL SELECT '/new', true, NULL UNION ALL SELECT '/new/' || n_name, false, sha1(n_name) FROM nation""")
def update_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of three commands: delete a brand, rename another, add a tree of nations."""
    brands = _table(spark, sf_dir, "part").agg(F.min("p_brand"), F.max("p_brand")).first()
    tree_ = _table(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_name").alias("path"), F.lit(False).alias("is_directory"), F.encode("n_name", "UTF-8").alias("content"))
    commands = [{"op": "delete", "path": f"/{brands[0]}", "recursive": True}, {"op": "rename", "old": f"/{brands[1]}", "new": "/moved"}, {"op": "add", "tree": tree_, "at": "/new"}]
    return _with_files(spark, sf_dir).update_image("parts", commands).tree("parts").select("path", "is_directory", "hash")


@_query("SELECT sha1(p_type) AS hash, length(p_type)::BIGINT AS size, count(*) AS refcnt FROM part GROUP BY p_type")
def archive_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs, counted anew, of an archive that was written twice and opened; contents are stored once."""
    from .durable import new_path

    path = new_path(spark, "stored")
    first = _with_files(spark, sf_dir).write(path)
    first.set_property("parts", "DESCRIPTION", "again").write(path)
    return Archive.open(spark, path).blobs().select("hash", "size", "refcnt")


@_query("SELECT 'parts' AS name, 'a text' AS description, 1 AS boot_index, count(*) AS file_count, count(DISTINCT p_brand) + 1 AS dir_count, sum(length(p_type))::BIGINT AS total_bytes FROM part")
def image_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _with_files(spark, sf_dir).set_property("parts", "DESCRIPTION", "a text")
    properties = made.properties(1)
    return made.statistics().select(F.lit(properties["NAME"]).alias("name"), F.lit(properties["DESCRIPTION"]).alias("description"), F.lit(made.boot_index).alias("boot_index"), "file_count", "dir_count", "total_bytes")


@_query("SELECT sha1(p_type) AS hash, bool_and(p_size > 25) AS is_external FROM part GROUP BY p_type")
def reference_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of an archive of the small parts with those that only another archive, of all parts, has."""
    rows = lambda part: part.select(F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.lit(False).alias("is_directory"), F.encode("p_type", "UTF-8").alias("content"))
    part = _table(spark, sf_dir, "part")
    own, other = (Archive.create(spark).add_image("x", rows(p)) for p in (part.where("p_size <= 25"), part))
    return own.reference([other]).contents.select("hash", "is_external")


@_query("SELECT '/' || p_brand || '/' || p_partkey AS path, p_type AS content FROM part WHERE p_partkey % 10 = 7")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_files(spark, sf_dir).extract("parts", ["*/*7"])
    return found.select("path", F.decode("content", "UTF-8").alias("content"))


@_query("SELECT count(*) AS n_streams, 0::BIGINT AS n_missing, 0::BIGINT AS n_corrupt FROM part")
def verify_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_files(spark, sf_dir).verify()


@_query("""
    SELECT * FROM (VALUES ('absent', 'FileNotFoundError'), ('below itself', 'ValueError'), ('file over directory', 'IsADirectoryError'), ('directory over file', 'NotADirectoryError'), ('not empty', 'OSError')) AS t(rule, error)""")
def rename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that must fail, on a tree of nations below their regions."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(False).alias("is_directory"))
    entries = combine.with_directories(nation)
    file = nation.agg(F.min("path")).first()[0]
    cases = (("absent", "/none", "/x"), ("below itself", "/0", "/0/1/2"), ("file over directory", file, "/1"), ("directory over file", "/1", file), ("not empty", "/1", "/2"))
    out = []
    for rule, old, new in cases:
        try:
            combine.rename_path(entries, old, new)
            out.append((rule, None))
        except (OSError, ValueError) as e:
            out.append((rule, type(e).__name__))
    return spark.createDataFrame(out, "rule string, error string")


@_query("SELECT 'c' || (c_custkey % 100) AS path, count(*) AS n_children FROM customer GROUP BY c_custkey % 100")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/c"), (F.col("c_custkey") % 100).cast("string"), F.lit("/"), "c_name").alias("path"))
    return combine.children_of(rows).select(F.substring("parent", 2, 100).alias("path"), "n_children")


@_query("""
    WITH a AS (SELECT c_custkey, c_custkey % 4 AS chunk_no, sha1(c_name) AS s FROM customer)
    SELECT c_custkey AS id, chunk_no, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE s END AS sha1, CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 100 END AS length, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS is_reused FROM a WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0)
    UNION ALL SELECT c_custkey, chunk_no, s, 10, false FROM a WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def refresh_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of full chunks are taken from the old table where it has them."""
    key = F.col("c_custkey")
    new = _table(spark, sf_dir, "customer").select(key.alias("id"), (key % 4).alias("chunk_no"), F.sha1("c_name").alias("sha1"), F.when(key % 3 == 0, 10).otherwise(100).alias("length"))
    old = new.where("id % 2 = 0").withColumn("sha1", F.lit("old"))
    return verify.refresh_integrity(new, old, 100)


@_query("SELECT 'Lodestack' AS name, 2::BIGINT << 10 AS number")
def version_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("Lodestack", errors.version_number())], "name string, number long")

