"""Imaging archives as bytes: header, blob table, contents, image metadata, XML and integrity table, uncompressed or XPRESS.

Files come through Spark's binary reader, so that they can be in any store; one row per file goes to a parser in
Python, which yields the rows of the table that is asked for. A whole file is in memory at a time (2 GB at most).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import filetime_of_parts
from . import codecs

#: Fixed values of the on-disk format.
MAGIC, PIPABLE_MAGIC, HEADER_SIZE = b"MSWIM\0\0\0", b"WLPWM\0\0\0", 208
VERSIONS, MOST_IMAGES, MOST_DEPTH = (0x10D00, 0xE00), 65535, 16384
FREE, METADATA, COMPRESSED, SPANNED, SOLID = 1, 2, 4, 8, 16
SOLID_MARK, NO_DESCRIPTOR = 0x100000000, 0xFFFFFFFF
INTEGRITY_CHUNK, DIRECTORY, REPARSE = 10485760, 0x10, 0x400
_HEADER = struct.Struct("<8sIIII16sHHI24s24s24sI24s60x")
_BLOB = struct.Struct("<24sHI20s")
_ENTRY = struct.Struct("<QIIQQQQQQ20sIQHHH")
_STREAM = struct.Struct("<QQ20sH")
_SOLID = struct.Struct("<QII")

HEADER = "version long, flags long, chunk_size long, guid string, part_number int, total_parts int, image_count int, boot_index int, is_pipable boolean"
BLOBS = "entry_no int, part_number int, refcnt long, hash binary, size long, offset long, size_in_archive long, flags int, resource_no int"
ENTRIES = (
    "image_index int, entry_no int, path string, name_key binary, short_name string, is_directory boolean, attributes long, security_id int, descriptor binary, "
    "created long, accessed long, written long, reparse_tag long, link_id long, extra map<long,binary>, streams array<struct<stream_id:int,name:string,hash:binary>>"
)
INTEGRITY = "chunk_no int, chunk_size long, sha1 binary, is_intact boolean"
XML = "xml string"
CONTENTS = "hash binary, size long, content binary, is_intact boolean"


class BadArchive(ValueError):
    pass


def resource(raw: bytes) -> tuple[int, int, int, int]:
    """flags, size in the archive, offset, full size of a resource header."""
    first, offset, size = struct.unpack("<QQQ", raw)
    return first >> 56, first & ((1 << 56) - 1), offset, size


def pack_resource(flags: int, stored: int, offset: int, size: int) -> bytes:
    return struct.pack("<QQQ", flags << 56 | stored, offset, size)


def parse_header(data: bytes) -> dict:
    """The header; that of a pipable archive is repeated at its end, where its offsets are known."""
    if data[:8] == PIPABLE_MAGIC:
        data = data[-HEADER_SIZE:]
    if len(data) < HEADER_SIZE or data[:8] not in (MAGIC, PIPABLE_MAGIC):
        raise BadArchive("not an archive")
    magic, size, version, flags, chunk, guid, part, parts, images, blobs, xml, boot, boot_index, integrity = _HEADER.unpack(data[:HEADER_SIZE])
    if size != HEADER_SIZE or version not in VERSIONS:
        raise BadArchive("unknown header size or version")
    if not 1 <= part <= parts or images > MOST_IMAGES:
        raise BadArchive("bad part number or image count")
    return {
        "version": version, "flags": flags, "chunk_size": chunk, "guid": guid.hex(), "part_number": part, "total_parts": parts, "image_count": images, "boot_index": boot_index if boot_index <= images else 0,
        "is_pipable": magic == PIPABLE_MAGIC, "blobs": resource(blobs), "xml": resource(xml), "boot": resource(boot), "integrity": resource(integrity),
    }


def compression_of(header: dict) -> int:
    """The header flag of the archive's compression type; 0 for none."""
    return next((f for f in (codecs.XPRESS_FLAG, codecs.LZX_FLAG, codecs.LZMS_FLAG) if header["flags"] & f), 0)


def stored_bytes(data: bytes, where: tuple[int, int, int, int], header: dict | None = None, first: int = 0, end: int | None = None) -> bytes:
    """Bytes ``first`` to ``end`` of a resource; a compressed one needs the header, which tells how. Of a compressed one only
    the chunks that the range needs are decoded."""
    flags, stored, offset, size = where
    if offset + stored > len(data):
        raise BadArchive("the resource lies outside the file")
    if flags & SOLID:
        raise BadArchive("a blob of a solid resource is read through the resource")
    if flags & COMPRESSED:
        if not header or not compression_of(header) or not header["chunk_size"]:
            raise BadArchive("the resource is compressed, but the archive isn't")
        if size > stored * 4096:
            raise BadArchive("the resource can't be that large")
        return codecs.read_chunked(data[offset : offset + stored], size, header["chunk_size"], compression_of(header), first, end)
    if stored != size:
        raise BadArchive("the sizes of the resource differ")
    return data[offset + first : offset + (size if end is None else min(end, size))]


def solid_bytes(data: bytes, at: int, stored: int, first: int = 0, end: int | None = None) -> bytes:
    """Bytes of a solid resource at ``at``: its own header tells full size, chunk size and compression type."""
    size, chunk, number = _SOLID.unpack_from(data, at)
    if at + stored > len(data) or not chunk:
        raise BadArchive("the resource lies outside the file")
    kinds = (0, codecs.XPRESS_FLAG, codecs.LZX_FLAG, codecs.LZMS_FLAG)
    if number >= len(kinds):
        raise BadArchive("unknown compression type")
    body = data[at + _SOLID.size : at + stored]
    return codecs.read_chunked(body, size, chunk, kinds[number], first, end, lengths_only=True) if number else body[first:end]


def blob_bytes(data: bytes, header: dict, row: tuple, first: int = 0, end: int | None = None) -> bytes:
    """Bytes ``first`` to ``end`` of the blob that a row of ``parse_blobs`` stands for."""
    _, _, _, _, size, offset, stored, flags, number = row
    if not flags & SOLID:
        return stored_bytes(data, (flags, stored, offset, size), header, first, end)
    if number < 0 or offset < 0:
        raise BadArchive("no solid resource has the blob")
    raw = _BLOB.unpack_from(stored_bytes(data, header["blobs"]), number * _BLOB.size)[0]
    _, whole, at, _ = resource(raw)
    return solid_bytes(data, at, whole, offset + first, offset + (size if end is None else min(end, size)))


def parse_blobs(data: bytes, header: dict) -> list[tuple]:
    """Entries of the blob table that count: of those with equal digests the first; without empty ones and those of other
    parts. Blobs of a solid run get the first of its resources whose end covers them, and their place in it."""
    table = stored_bytes(data, header["blobs"])
    rows, seen = [], set()
    solid: list[tuple[int, int, int]] = []  # end of the resource in the run's data, offset in the file, number
    in_run = False
    for n in range(len(table) // _BLOB.size):
        raw, part, refs, digest = _BLOB.unpack_from(table, n * _BLOB.size)
        flags, stored, offset, size = resource(raw)
        number = -1
        if flags & SOLID:
            if size == SOLID_MARK:
                if not in_run or rows and rows[-1][0] == n - 1 and rows[-1][7] & SOLID:
                    solid = []
                in_run = True
                full = struct.unpack_from("<Q", data, offset)[0]
                solid.append(((solid[-1][0] if solid else 0) + full, offset, n))
                continue
            found = next(((end, at, k) for end, at, k in solid if offset + stored <= end), None)
            if found:
                before = max((end for end, _, _ in solid if end < found[0]), default=0)
                offset, number, size = offset - before, found[2], stored
        else:
            in_run, solid = False, []
        if part != header["part_number"] or not any(digest) or not size:
            continue
        if flags & METADATA:
            if flags & SOLID or refs > 1:
                raise BadArchive("bad metadata entry")
            if not refs:
                continue
        elif digest in seen:
            continue
        else:
            seen.add(digest)
        rows.append((n, part, refs, digest, size, offset, stored, flags, number))
    return rows


def parse_metadata(data: bytes) -> list[dict]:
    """Entries of one image, from the top. Names that can't be, second ones of a name and children of files are left out."""
    length, count = struct.unpack_from("<II", data)
    if length > len(data) or 8 + 8 * count > max(8, length):
        raise BadArchive("bad security table")
    at, descriptors = 8 + 8 * count, []
    for size in struct.unpack_from(f"<{count}Q", data, 8):
        descriptors.append(data[at : at + size])
        at += size
    if at > max(8, length):
        raise BadArchive("bad security table")
    start = -(-max(8, length) // 8) * 8
    out: list[dict] = []
    root, _ = _read_entry(data, start, descriptors)
    if root is None:
        return out
    stack = [(root, "", 0)]
    while stack:
        entry, above, depth = stack.pop()
        entry["path"] = above or "/"
        out.append(entry)
        if depth >= MOST_DEPTH:
            raise BadArchive("the tree is too deep")
        if not entry["subdir"] or not entry["is_directory"]:
            continue
        position, children, names = entry["subdir"], [], set()
        while True:
            child, position = _read_entry(data, position, descriptors)
            if child is None:
                break
            name = child["name"]
            if not name or name in (".", "..") or "/" in name or "\0" in name or child["name_key"] in names:
                continue
            names.add(child["name_key"])
            children.append((child, f"{above}/{name}", depth + 1))
        stack += reversed(children)
    return out


def _read_entry(data: bytes, at: int, descriptors: list[bytes]) -> tuple[dict | None, int]:
    if at + 8 > len(data):
        raise BadArchive("the entry lies outside the metadata")
    size = struct.unpack_from("<Q", data, at)[0]
    if size == 0:
        return None, at + 8
    size = -(-size // 8) * 8
    if size < _ENTRY.size or at + size > len(data):
        raise BadArchive("bad entry size")
    _, attributes, security, subdir, _, _, created, accessed, written, digest, _, union, extra, short_bytes, name_bytes = _ENTRY.unpack_from(data, at)
    p, end = at + _ENTRY.size, at + size
    texts = []
    for n in (name_bytes, short_bytes):
        texts.append(data[p : p + n])
        p += n + 2 if n else 0
    if p > end:
        raise BadArchive("the names lie outside the entry")
    tags, p = {}, -(-p // 8) * 8
    while p + 8 <= end:
        tag, n = struct.unpack_from("<II", data, p)
        if p + 8 + n > end:
            break
        tags.setdefault(tag, data[p + 8 : p + 8 + n])
        p += 8 + -(-n // 8) * 8
    streams = [(0, None, digest if any(digest) else None)]
    for i in range(extra):
        length, _, other, n = _STREAM.unpack_from(data, end)
        if length < _STREAM.size or end + length > len(data):
            raise BadArchive("bad stream entry")
        name = data[end + _STREAM.size : end + _STREAM.size + n].decode("utf-16-le", "replace") if n else None
        streams.append((i + 1, name, other if any(other) else None))
        end += -(-length // 8) * 8
    reparse = bool(attributes & REPARSE)
    return {
        "name": texts[0].decode("utf-16-le", "replace"), "name_key": texts[0].decode("utf-16-le", "surrogatepass").encode("utf-16-be", "surrogatepass"), "short_name": texts[1].decode("utf-16-le", "replace") or None,
        "is_directory": bool(attributes & DIRECTORY) and not reparse, "attributes": attributes, "security_id": security if security < len(descriptors) else -1, "descriptor": descriptors[security] if security < len(descriptors) else None,
        "created": created, "accessed": accessed, "written": written, "reparse_tag": union & 0xFFFFFFFF if reparse else None, "link_id": 0 if reparse else union, "extra": tags, "streams": streams, "subdir": subdir,
    }, end


def parse_xml(data: bytes, header: dict) -> str:
    return stored_bytes(data, header["xml"]).decode("utf-16").lstrip("\ufeff")


def parse_integrity(data: bytes, header: dict) -> list[tuple]:
    """Stored digests of the chunks from the end of the header to the end of the blob table, and whether they hold."""
    if not header["integrity"][3]:
        return []
    table = stored_bytes(data, header["integrity"])
    size, n, chunk = struct.unpack_from("<III", table)
    if size != len(table) or size != 12 + 20 * n or not chunk:
        raise BadArchive("bad integrity table")
    end = header["blobs"][2] + header["blobs"][1]
    rows = []
    for i in range(n):
        digest = table[12 + 20 * i : 32 + 20 * i]
        part = data[HEADER_SIZE + i * chunk : min(end, HEADER_SIZE + (i + 1) * chunk)]
        rows.append((i, chunk, digest, hashlib.sha1(part).digest() == digest))
    return rows


def _entries(data: bytes, header: dict) -> Iterator[tuple]:
    image = 0
    for _, _, _, digest, size, offset, stored, flags, _ in parse_blobs(data, header):
        if not flags & METADATA:
            continue
        image += 1
        meta = stored_bytes(data, (flags, stored, offset, size), header)
        if hashlib.sha1(meta).digest() != digest:
            raise BadArchive(f"the metadata of image {image} is damaged")
        for i, e in enumerate(parse_metadata(meta)):
            streams = [{"stream_id": s, "name": n, "hash": h} for s, n, h in e["streams"]]
            yield (image, i, e["path"], e["name_key"], e["short_name"], e["is_directory"], e["attributes"], e["security_id"], e["descriptor"], e["created"], e["accessed"], e["written"], e["reparse_tag"], e["link_id"], e["extra"], streams)


def _contents(data: bytes, header: dict) -> Iterator[tuple]:
    for row in parse_blobs(data, header):
        if not row[7] & METADATA:
            content = blob_bytes(data, header, row)
            yield row[3], row[4], content, hashlib.sha1(content).digest() == row[3]


_TABLES: dict[str, tuple[str, Callable[[bytes, dict], object]]] = {
    "header": (HEADER, lambda d, h: [tuple(h[c.split()[0]] for c in HEADER.split(", "))]),
    "blobs": (BLOBS, parse_blobs),
    "entries": (ENTRIES, _entries),
    "contents": (CONTENTS, _contents),
    "integrity": (INTEGRITY, parse_integrity),
    "xml": (XML, lambda d, h: [(parse_xml(d, h),)]),
}


def columns_of(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += ch
    return out


def parse_archives(files: DataFrame, table: str) -> DataFrame:
    """A table of archives given as rows (path, content): header, blobs, contents, entries, integrity or xml, with the path
    as ``archive``."""
    schema, parse = _TABLES[table]
    names = ["archive", *columns_of(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *r) for r in parse(data, parse_header(data))]
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"reparse_tag": "Int64"}) if table == "entries" else frame

    return files.select("path", "content").mapInPandas(run, f"archive string, {schema}")


def read_archives(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table (see ``parse_archives``) of the archives at ``path``."""
    return parse_archives(spark.read.format("binaryFile").load(path), table)


def read_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bytes of blobs: for ranges (path, hash, first, end) of archives (path, content) the rows with ``bytes``; only the chunks
    that a range needs are decoded. Ranges of a blob that an archive lacks give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data, wanted in zip(batch["path"], batch["content"], batch["wanted"], strict=True):
                header = parse_header(data)
                rows = {r[3]: r for r in parse_blobs(data, header)}
                out += [(name, w["hash"], w["first"], w["end"], blob_bytes(data, header, rows[w["hash"]], w["first"], w["end"])) for w in wanted if w["hash"] in rows]
            yield pd.DataFrame(out, columns=["path", "hash", "first", "end", "bytes"])

    wanted = ranges.groupBy("path").agg(F.collect_list(F.struct("hash", "first", "end")).alias("wanted"))
    joined = files.select("path", "content").join(wanted, "path")
    return joined.mapInPandas(run, "path string, hash binary, first long, end long, bytes binary")


def image_properties(xml: DataFrame) -> DataFrame:
    """Images of an XML document (column xml): image_index, name, description, flags, counts, and times in ticks; an item that an
    image lacks is null."""
    each = xml.select("*", F.explode(F.regexp_extract_all("xml", F.lit("(?s)<IMAGE\\b.*?</IMAGE>"), 0)).alias("image"))
    item = lambda tag: F.nullif(F.xpath_string("image", F.lit(f"/IMAGE/{tag}")), F.lit(""))
    number = lambda tag: item(tag).cast("long")
    time = lambda tag: filetime_of_parts(item(f"{tag}/HIGHPART"), item(f"{tag}/LOWPART"))
    return each.select(
        *xml.columns,
        item("@INDEX").cast("int").alias("image_index"),
        item("NAME").alias("name"),
        item("DESCRIPTION").alias("description"),
        item("FLAGS").alias("flags"),
        number("DIRCOUNT").alias("dir_count"),
        number("FILECOUNT").alias("file_count"),
        number("TOTALBYTES").alias("total_bytes"),
        number("HARDLINKBYTES").alias("hard_link_bytes"),
        time("CREATIONTIME").alias("created"),
        time("LASTMODIFICATIONTIME").alias("modified"),
    )


# --- writing


def build_metadata(entries: list[dict], descriptors: list[bytes]) -> bytes:
    """Metadata of an image from entries (path and what ``parse_metadata`` gives), parents before children."""
    head = struct.pack("<II", 8 + 8 * len(descriptors) + sum(map(len, descriptors)), len(descriptors)) + struct.pack(f"<{len(descriptors)}Q", *map(len, descriptors)) + b"".join(descriptors)
    head += b"\0" * (-len(head) % 8)
    children: dict[str, list[dict]] = {}
    for e in entries:
        if e["path"] != "/":
            children.setdefault(e["path"].rsplit("/", 1)[0] or "/", []).append(e)
    order, todo = [], [next(e for e in entries if e["path"] == "/")]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [c for c in reversed(children.get(e["path"], [])) if c.get("attributes", 0) & DIRECTORY]
    raw = {id(e): _entry_bytes(e) for e in entries}
    at = len(head) + len(raw[id(order[0])]) + 8
    offsets = {}
    for d in order:
        if kids := children.get(d["path"]):
            offsets[id(d)] = at
            at += sum(len(raw[id(k)]) for k in kids) + 8
    patched = lambda e: raw[id(e)][:16] + struct.pack("<Q", offsets.get(id(e), 0)) + raw[id(e)][24:]
    out = [head, patched(order[0]), b"\0" * 8]
    for d in order:
        if id(d) in offsets:
            out += [*map(patched, children[d["path"]]), b"\0" * 8]
    return b"".join(out)


def _entry_bytes(e: dict) -> bytes:
    name = b"" if e["path"] == "/" else e["path"].rsplit("/", 1)[1].encode("utf-16-le")
    short = (e.get("short_name") or "").encode("utf-16-le")
    body = b"".join(t + b"\0\0" for t in (name, short) if t)
    tags = b"".join(struct.pack("<II", tag, len(v)) + v + b"\0" * (-len(v) % 8) for tag, v in e.get("extra", {}).items())
    pad = b"\0" * (-(_ENTRY.size + len(body)) % 8)
    streams = e.get("streams") or [(0, None, None)]
    digest = streams[0][2] or bytes(20)
    union = e["reparse_tag"] if e.get("reparse_tag") else e.get("link_id", 0)
    security = e.get("security_id", -1) & NO_DESCRIPTOR
    size = _ENTRY.size + len(body) + len(pad) + len(tags)
    fixed = _ENTRY.pack(size, e.get("attributes", 0), security, 0, 0, 0, e.get("created", 0), e.get("accessed", 0), e.get("written", 0), digest, 0, union, len(streams) - 1, len(short), len(name))
    more = []
    for _, stream_name, other in streams[1:]:
        text = (stream_name or "").encode("utf-16-le")
        one = _STREAM.pack(_STREAM.size + len(text) + 2, 0, other or bytes(20), len(text)) + text + b"\0\0"
        more.append(one + b"\0" * (-len(one) % 8))
    return fixed + body + pad + tags + b"".join(more)


def build_xml(images: list[dict], total_bytes: int | None = None) -> str:
    from xml.sax.saxutils import escape

    total = "" if total_bytes is None else f"<TOTALBYTES>{total_bytes}</TOTALBYTES>"
    inner = "".join(f'<IMAGE INDEX="{i}">' + "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in image.items()) + "</IMAGE>" for i, image in enumerate(images, 1))
    return f"<WIM>{total}{inner}</WIM>"


def build_archive(images: list[tuple[dict, list[dict], list[bytes]]], contents: list[bytes], chunk: int = INTEGRITY_CHUNK, guid: bytes | None = None, boot_index: int = 0, compress_chunk: int = 0, kind: int = codecs.XPRESS_FLAG, solid: bool = False) -> bytes:
    """An archive: images as (properties, entries, descriptors), and the files' contents, each stored once.

    With ``compress_chunk`` contents and metadata are compressed in chunks of that size where it makes them smaller, by the
    type that the header flag ``kind`` stands for. With ``solid`` all contents are one resource.
    """

    def packed(content: bytes) -> tuple[int, bytes]:
        small = codecs.write_chunked(content, compress_chunk, kind) if compress_chunk else content
        return (COMPRESSED, small) if len(small) < len(content) else (0, content)

    out, table = [bytes(HEADER_SIZE)], []
    at = HEADER_SIZE
    uses: dict[bytes, int] = {}
    for _, entries, _ in images:
        for e in entries:
            for _, _, digest in e.get("streams") or []:
                if digest:
                    uses[digest] = uses.get(digest, 0) + 1
    once = list(dict.fromkeys(c for c in contents if c))
    if solid and once:
        whole, inside = b"".join(once), 0
        body = codecs.write_chunked(whole, compress_chunk, kind, lengths_only=True) if compress_chunk else whole
        stored = _SOLID.pack(len(whole), compress_chunk or len(whole), (codecs.XPRESS_FLAG, codecs.LZX_FLAG).index(kind) + 1 if compress_chunk else 0) + body
        table.append(_BLOB.pack(pack_resource(SOLID, len(stored), at, SOLID_MARK), 1, 1, bytes(20)))
        out.append(stored)
        at += len(stored)
        for content in once:
            digest = hashlib.sha1(content).digest()
            table.append(_BLOB.pack(pack_resource(SOLID, len(content), inside, 0), 1, uses.get(digest, 0), digest))
            inside += len(content)
        once = []
    for content in once:
        digest = hashlib.sha1(content).digest()
        how, stored = packed(content)
        table.append(_BLOB.pack(pack_resource(how, len(stored), at, len(content)), 1, uses.get(digest, 0), digest))
        out.append(stored)
        at += len(stored)
    for _, entries, descriptors in images:
        meta = build_metadata(entries, descriptors)
        how, stored = packed(meta)
        table.append(_BLOB.pack(pack_resource(METADATA | how, len(stored), at, len(meta)), 1, 1, hashlib.sha1(meta).digest()))
        out.append(stored)
        at += len(stored)
    blobs = b"".join(table)
    where_blobs = pack_resource(0, len(blobs), at, len(blobs))
    out.append(blobs)
    at += len(blobs)
    body = b"".join(out)[HEADER_SIZE:]
    xml = b"\xff\xfe" + build_xml([p for p, _, _ in images], len(body)).encode("utf-16-le")
    where_xml = pack_resource(0, len(xml), at, len(xml))
    at += len(xml)
    sums = [hashlib.sha1(body[i : i + chunk]).digest() for i in range(0, len(body), chunk)]
    integrity = struct.pack("<III", 12 + 20 * len(sums), len(sums), chunk) + b"".join(sums)
    where_integrity = pack_resource(0, len(integrity), at, len(integrity))
    flags = codecs.COMPRESSED_FLAG | kind if compress_chunk else 0
    header = _HEADER.pack(MAGIC, HEADER_SIZE, VERSIONS[0], flags, compress_chunk, guid or uuid.uuid4().bytes, 1, 1, len(images), where_blobs, where_xml, bytes(24), boot_index, where_integrity)
    return header + body + xml + integrity


def build_archives(files: DataFrame, compress_chunk: int = 0, kind: int = codecs.XPRESS_FLAG, solid: bool = False, boot_index: int = 0) -> DataFrame:
    """Archives (path, content) of files (archive, image_index, image_name, path, content): one per ``archive``, with an image for
    each image_index, numbered anew from 1 in their order, and the directories that the paths imply.

    An archive is one file, so that one task makes it; all of its contents are in memory there.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        images = []
        for _, part in rows.sort_values(["image_index", "path"]).groupby("image_index", sort=True):
            entries = {"/": {"path": "/", "attributes": DIRECTORY}}
            for path, content in zip(part["path"], part["content"], strict=True):
                above = path.split("/")[1:-1]
                for n in range(1, len(above) + 1):
                    entries.setdefault("/" + "/".join(above[:n]), {"path": "/" + "/".join(above[:n]), "attributes": DIRECTORY})
                entries[path] = {"path": path, "attributes": 0x80, "streams": [(0, None, hashlib.sha1(content).digest() if content else None)]}
            n_dirs = sum(e["attributes"] & DIRECTORY > 0 for e in entries.values()) - 1
            images.append(({"NAME": part["image_name"].iloc[0], "DIRCOUNT": n_dirs, "FILECOUNT": len(part)}, list(entries.values()), []))
        made = build_archive(images, [bytes(c) for c in rows["content"]], compress_chunk=compress_chunk, kind=kind, solid=solid, boot_index=boot_index)
        return pd.DataFrame({"path": [rows["archive"].iloc[0]], "content": [made]})

    return files.select("archive", "image_index", "image_name", "path", "content").groupBy("archive").applyInPandas(build, "path string, content binary")


# --- programs


def machine_of(content: Column) -> Column:
    """Machine number in the header of an executable; null if the content is none."""
    le = lambda x, n: F.conv(_reversed_hex(x, n), 16, 10).cast("long")
    start = le(F.substring(content, 0x3D, 4), 4)
    mark = F.substring(content, start.cast("int") + 1, F.lit(4))
    good = (F.hex(F.substring(content, 1, 2)) == "4D5A") & (F.hex(mark) == "50450000")
    return F.when(good, le(F.substring(content, start.cast("int") + 5, F.lit(2)), 2))


def _reversed_hex(x: Column, n: int) -> Column:
    h = F.hex(x)
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))
