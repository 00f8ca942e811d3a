"""Queries of this subpackage and their SQL; every operator runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as _dedup
from . import html_extract as _html
from . import mixing as _mixing
from . import packing as _packing
from . import quality as _quality
from . import secret_scan as _secrets
from . import sharding as _sharding
from . import simhash as _simhash
from . import warc as _warc
from . import weighted_sampling as _cws


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cws.fingerprint(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return _secrets.scan_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in _secrets.KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract_pages(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "intact", "position")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.plan_mix(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weighted_sampling": op1_weighted_sampling,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_html_extract": op4_html_extract,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
}

_MAGLEV = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || i AS name FROM range({_sharding.SHARDS}) t(i)),
prefs AS (
  SELECT i, list_transform(range({_sharding.TABLE_SIZE}), lambda j: (o + j * s) % {_sharding.TABLE_SIZE}) AS pref FROM (
    SELECT i, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {_sharding.TABLE_SIZE} AS o,
           ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {_sharding.TABLE_SIZE - 1} + 1 AS s FROM names)),
claims AS (
  SELECT 0 AS turn, NULL::BIGINT AS slot, NULL::BIGINT AS shard, list_transform(range({_sharding.TABLE_SIZE}), lambda j: false) AS taken
  UNION ALL
  SELECT turn + 1, claimed, i,
         list_concat(list_slice(taken, 1, claimed), [true], list_slice(taken, claimed + 2, {_sharding.TABLE_SIZE}))
  FROM (SELECT c.turn, c.taken, p.i, list_extract(list_filter(p.pref, lambda s: NOT c.taken[s + 1]), 1) AS claimed
        FROM claims c JOIN prefs p ON p.i = c.turn % {_sharding.SHARDS} WHERE c.turn < {_sharding.TABLE_SIZE})),
keyed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {_sharding.TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, keyed.slot, shard::INTEGER AS shard FROM keyed JOIN claims ON claims.slot = keyed.slot
"""

ORACLES: dict[str, str] = {
    "op2_sharding": _MAGLEV,
    "op6_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p),
        u AS (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host,
                     regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM g),
        k AS (SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
               array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE lower(path) END
                 || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
               strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured, true AS intact
        FROM u)
        SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id) AS position FROM k""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
}
