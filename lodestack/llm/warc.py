"""WARC archives and their capture index.

Every record is a gzip member of its own, so that an index entry's offset and length are all that reading it takes. A
member ends with the upper byte of its length, which is zero below 16 MB: the members, less this byte, are written by
Spark's own text writer with a zero byte as the line end, so that archives can live in any store that Spark reaches. A
longer record has several members. Archives are read back as binary files; each gives one run of captures sorted by URL
key, time and page id. The runs are merged externally: captures are dealt into key ranges of bounded size, and in each
range a loser tree merges the runs' slices, which gives globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import materialise, new_path
from .exact_dedup import digest_filter, filter_bits, in_filter

#: Payloads below this are never revisits. Bytes of an archive before compression, about; captures in a key range.
MIN_REVISIT, ARCHIVE_BYTES, RANGE_CAPTURES = 100, 32 << 20, 100_000
#: Time of the capture of page 0; each next page is a second later.
FIRST_CAPTURE = 1_700_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record in a gzip member, at most; below 16 MB.
MEMBER_BYTES = (1 << 24) - 1
#: Bytes of an archive that are looked at at once, compression level.
WINDOW, LEVEL = 1 << 16, 4
CAPTURE = "archive string, offset long, length long, page_id {kind}, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to {kind}, intact boolean"


def _uuid(key: Column) -> Column:
    h = F.md5(F.encode(key, "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), value) for name, value in pairs))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns ``path``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with the smallest page id is a response and the
    others are revisits of it. Null html is an empty payload. Control characters and blanks in a URL are escaped. Only
    pages whose digest is in a filter over the repeated ones are shuffled.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html")).withColumn("payload_digest", F.sha2("html", 256))
    narrow = materialise(rows.select("page_id", "payload_bytes", "payload_digest"), "warc-digests")
    first = narrow.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = narrow.join(first.select("payload_digest", "first_id"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("first_id").alias("refers_to")).distinct()
    total = narrow.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    each = max(1, min(100_000, archive_bytes * total[0] // max(1, total[1] or 1)))
    digests = materialise(revisits.select(F.col("r_digest").alias("digest")).distinct(), "warc-repeated")
    bits = filter_bits(digests.count())
    likely = in_filter(rows.withColumn("digest", F.col("payload_digest")), materialise(digest_filter(digests, bits), "warc-filter"), bits, "likely")
    found = likely.where("likely").join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    alone = likely.where("not likely").withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType))
    joined = found.select(*rows.columns, "refers_to").unionByName(alone.select(*rows.columns, "refers_to"))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), own)), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    captured = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = F.coalesce(F.col("refers_to").cast("string"), F.lit(""))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _lines(("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", _uuid(F.concat_ws(" ", own, "payload_digest"))), ("WARC-Date", captured), ("WARC-Target-URI", uri), ("WARC-Page-ID", own), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest"))),
        F.when(revisit, _lines(("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _uuid(F.concat_ws(" ", shown, "payload_digest"))), ("WARC-Refers-To-Page", shown))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))
    members = joined.select(_member(record).cast("string").alias("value"))
    members.write.options(lineSep="\0", maxRecordsPerFile=each).text(path)
    return path


def gzip_members(record: bytes) -> bytes:
    """A record as gzip members, of which the last has less than 16 MB and so ends with a zero byte."""
    out = []
    for at in range(0, len(record) or 1, MEMBER_BYTES):
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [packer.compress(record[at : at + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


@F.pandas_udf(BinaryType())
def _member(records: pd.Series) -> pd.Series:
    return records.map(lambda r: gzip_members(r.encode("utf-8"))[:-1])


def url_key(url: str) -> str:
    """Sort key of a URL: host parts from the last to the first, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{'?' + parts.query if parts.query else ''}"


def members_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Records of an archive: offset, length and the record; gzip members that start none belong to the one before.

    An archive that isn't compressed is one piece.
    """
    at, offset, parts = 0, 0, []
    view = memoryview(content)
    while at < len(content):
        if content[at : at + 2] != b"\x1f\x8b":
            part, end = content[at:], len(content)
        else:
            member, pieces, end = zlib.decompressobj(31), [], at
            while not member.eof and end < len(content):  # a window at a time, since what isn't used is copied
                pieces.append(member.decompress(view[end : end + WINDOW]))
                end = min(len(content), end + WINDOW)
            part, end = b"".join([*pieces, member.flush()]), end - len(member.unused_data)
        if parts and part.startswith(b"WARC/"):
            yield offset, at - offset, b"".join(parts)
            parts, offset = [], at
        parts.append(part)
        at = end
    if parts:
        yield offset, at - offset, b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of an uncompressed archive or piece: offset, length, header fields (lower-case names), block."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        body, size = end + 4, int(fields["content-length"])
        after = body + size + 4
        if data[body + size : after] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end as it should")
        yield at, after - at, fields, data[body : body + size]
        at = after


def archive_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of a stored archive: offset and length in it, header fields, block. Where a gzip member holds several records,
    they all have its offset and length."""
    for at, length, piece in members_of(content):
        packed = content[at : at + 2] == b"\x1f\x8b"
        for inner, size, fields, block in parse_records(piece):
            yield (at, length, fields, block) if packed else (at + inner, size, fields, block)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The captures in the archives below ``path``, sorted within each archive: one run per archive.

    ``intact`` is whether a response's payload has the digest and length that its record tells; for revisits it is null
    (see ``resolve_revisits``). Archives are read whole, each in one task, so they should stay below 2 GB.
    """
    number = id_type != "string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for at, length, fields, block in archive_records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    told = fields["warc-payload-digest"].removeprefix("sha256:")
                    full = fields["warc-type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if full else told
                    ids = [fields.get(k) or None for k in ("warc-page-id", "warc-refers-to-page")]
                    page_id, refers = (int(x) if x is not None and number else x for x in ids)
                    uri = fields["warc-target-uri"]
                    intact = digest == told and len(payload) == size if full else None
                    rows.append((name.rsplit("/", 1)[-1], at, length, page_id, uri, url_key(uri), fields["warc-date"], fields["warc-type"], len(payload) if full else size, digest, refers, intact))
                rows.sort(key=capture_order)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")]).astype({"intact": "object"})
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"}) if number else frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInPandas(run, CAPTURE.format(kind=id_type))


def read_payload(content: bytes, offset: int, length: int) -> bytes:
    """The payload of the record at ``offset`` of a stored archive, from its own bytes alone."""
    _, _, _, block = next(archive_records(content[offset : offset + length]))
    return block.partition(b"\r\n\r\n")[2]


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` with ``intact`` of the revisits: whether the archives hold an intact response of the page that one refers
    to, with the same digest and length."""
    asked = captures.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    there = captures.where("record_type = 'response' and intact").join(asked, ["page_id", "payload_digest", "payload_bytes"], "left_semi").select("page_id", "payload_digest", "payload_bytes").distinct()
    there = there.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes"))
    found = (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")) & (F.col("payload_bytes") == F.col("r_bytes"))
    revisits = captures.where("record_type = 'revisit'").join(there, found, "left").withColumn("intact", F.col("r_id").isNotNull()).select(*captures.columns)
    return captures.where("record_type <> 'revisit'").unionByName(revisits)


def capture_order(row: tuple) -> tuple:
    return row[5], row[6], row[3] is not None, row[3] if row[3] is not None else 0


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: Iterable[Iterable], key=lambda x: x):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * max(1, len(self.runs))
        for i in range(len(self.runs)):
            self._play(i, filling=True)

    def _next(self, i: int) -> tuple | None:
        for row in self.runs[i]:
            return self.key(row), i, row
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int, filling: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0 and filling:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and (head := self.heads[w := self.losers[0]]) is not None:
            yield head[2]
            self.heads[w] = self._next(w)
            self._play(w)


def merge_index(captures: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Capture histories in global order: the captures with range_no and place, which order them all.

    Ranges are cut over URL key, time and page id together, so that a URL with many captures spans several.
    """
    n = captures.count()
    ranges = max(1, -(-n // range_captures))
    schema = captures.schema
    names = schema.names

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                runs.setdefault(row[0], []).append(row)
        merged = list(LoserTree(runs.values(), capture_order))
        frame = pd.DataFrame(merged, columns=names)
        for c in ("page_id", "refers_to"):
            if schema[c].dataType.simpleString() != "string":
                frame[c] = frame[c].astype("Int64")
        yield frame.assign(range_no=TaskContext.get().partitionId(), place=range(len(frame)))

    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("archive", "url_key", "captured", "page_id")
    return dealt.mapInPandas(merge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", range_no int, place long")


def ranked(merged: DataFrame) -> DataFrame:
    """Adds ``position``, from 1, of every capture in the whole index; the ranges' sizes add up to it."""
    merged = materialise(merged, "warc-index")
    sizes = merged.groupBy("range_no").agg(F.count(F.lit(1)).alias("range_size"))
    below = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("range_no", F.coalesce(F.sum("range_size").over(below), F.lit(0)).alias("range_start"))
    return merged.join(F.broadcast(starts), "range_no").withColumn("position", F.col("range_start") + F.col("place") + 1).drop("range_start")


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` into archives, reads them back and merges their index; one capture per row of ``pages``, with its
    ``position`` in the order of URL key, time and page id.

    Null html is an empty payload, null url gets a URN of the page id, repeated rows are recorded as often as they
    occur, an empty table gives an empty result, other columns are ignored. A repeated page id whose payload is the
    response of its group is a response each time.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    where = write_archives(pages, path or new_path(spark, "warc"))
    runs = materialise(read_archives(spark, where, kind), "warc-runs")
    return ranked(merge_index(resolve_revisits(runs)))
