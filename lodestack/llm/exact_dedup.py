"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Every task is a memtable: it takes up the digests of its rows and flushes them as one run, a Parquet file sorted by digest
with a Bloom filter in its footer; nothing is shuffled for that. A bitmap over all runs marks the places of the filter that
more than one entry falls on. Only entries on such places are merged: compaction keeps, for each digest, the smallest (or
largest) identifier and the number of documents. Digests with several documents are hits; a bitmap of the hits lets only
likely members send their text, which is then compared byte for byte with the text that stays. All other rows are alone
and are read from the runs as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Bits in one bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 32768
#: The broadcast hit filter never has more bits than this (32 MB).
MAX_FILTER_BITS = 1 << 28
#: Copies compared with one copy of the kept text in one task.
COPIES_PER_SALT = 512
#: Groups whose hits are broadcast (4 MB).
MOST_HEAVY = 1 << 16


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Level 0: doc_id, digest, run_id of every row, one file for each run, sorted by digest."""
    entries = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"), F.spark_partition_id().alias("run_id"))
    return materialise(entries.sortWithinPartitions("digest", "doc_id"), "lsm-runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"})


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` digests, eight for each and up to the next power of two, with an upper bound."""
    return min(MAX_FILTER_BITS, max(1 << 20, 1 << (8 * n).bit_length()))


def shared_places(runs: DataFrame, bits: int) -> DataFrame:
    """The filter (see ``digest_filter``) of the places that several entries of ``runs`` fall on."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return _bitmaps(runs.select(at.alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merges runs: one row per digest with the id that stays and the number of documents. A null id stays only alone."""
    chosen = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    return runs.groupBy("digest").agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _bitmaps(places: DataFrame) -> DataFrame:
    return places.groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("filter_part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bitmap"))


def digest_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the digests' hash positions, at most ``bits / 32768`` rows of 4 KB."""
    return _bitmaps(digests.select(F.pmod(F.xxhash64("digest"), F.lit(bits)).alias("at")))


def in_filter(rows: DataFrame, bitmaps: DataFrame, bits: int, name: str) -> DataFrame:
    """Adds whether the bit of a row's digest is set; ``bitmaps`` is broadcast, its size is bounded by ``bits``."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor((F.col("filter_at") % BITMAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("filter_at", at)
        .withColumn("filter_part", F.floor(F.col("filter_at") / BITMAP_BITS))
        .join(F.broadcast(bitmaps), "filter_part", "left")
        .withColumn(name, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(filter_at % 8 as int))")) != 0, F.lit(False)))
        .drop("filter_at", "filter_part", "bitmap")
    )


def with_hits(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """The entries with keep_id and group_size of their digest's hit, null without one.

    The largest groups, at most ``MOST_HEAVY``, are broadcast; any other has less than that share of all rows, so that no
    task of the join gets a hot group.
    """
    heavy = materialise(hits.where(F.col("group_size") > COPIES_PER_SALT).orderBy(F.desc("group_size"), "digest").limit(MOST_HEAVY), "lsm-heavy")
    tried = entries.join(F.broadcast(heavy), "digest", "left")
    rest = tried.where("group_size is null").select(*entries.columns).join(hits.hint("merge"), "digest", "left")
    return tried.where("group_size is not null").unionByName(rest)


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents with identical text.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``. Null text is empty text. Repeated
    rows with equal id and text are separate rows of a group, all with the same values. A null id is kept as a group's id
    only if no other id is there. Other columns are ignored. An empty table gives an empty result. ``keep`` is "smallest" or
    "largest".
    """
    runs = flush_runs(docs, id_col, text_col)
    bits = filter_bits(runs.count())
    merged = in_filter(runs, materialise(shared_places(runs, bits), "lsm-shared"), bits, "shared").where("shared")
    hits = materialise(compact(merged.select("doc_id", "digest"), keep).where("group_size > 1"), "lsm-hits")
    hit_bits = filter_bits(hits.count())
    bitmaps = materialise(digest_filter(hits, hit_bits), "lsm-hit-filter")
    entries = in_filter(runs.select("doc_id", "digest"), bitmaps, hit_bits, "likely")
    narrow = materialise(with_hits(entries.where("likely").select("doc_id", "digest").distinct(), hits), "lsm-members")
    salts = F.ceil(F.col("group_size") / COPIES_PER_SALT).cast("int")
    members = narrow.where("group_size is not null").withColumn("salts", salts).select(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"), "keep_id", "group_size", "salts")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = in_filter(texts, bitmaps, hit_bits, "likely").where("likely").join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")))
    texts = materialise(texts.select("doc_id", "digest", "text", "keep_id", "group_size", "salts"), "lsm-texts")
    kept = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("kept_text"), F.first("salts").alias("salts"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts")).cast("int"))
    same = F.col("text") == F.col("kept_text")
    verified = salted.join(kept, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", same.alias("same"), F.when(~same, F.col("text")).alias("other_text"))
    verified = materialise(verified, "lsm-verified")
    if not verified.where("not same").isEmpty():  # a digest collision: these texts form groups of their own
        other = verified.where("not same")
        groups = other.groupBy("digest", "other_text").agg((F.max if keep == "largest" else F.min)("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        lost = other.groupBy("digest").agg(F.count(F.lit(1)).alias("n_other"))
        verified = (
            verified.join(groups, ["digest", "other_text"], "left")
            .join(lost, "digest", "left")
            .withColumn("keep_id", F.when(F.col("same"), F.col("keep_id")).otherwise(F.col("own_keep")))
            .withColumn("group_size", F.when(F.col("same"), F.col("group_size") - F.coalesce("n_other", F.lit(0))).otherwise(F.col("own_size")))
        )
    single = entries.where("not likely").select("doc_id", "digest").unionByName(narrow.where("group_size is null").select("doc_id", "digest"))
    single = single.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = single.unionByName(verified.select("doc_id", "digest", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One document of each group of equal texts, with the columns of ``docs``; repeated rows come out once."""
    kept = exact_dedup(docs, keep).where("kept").select(F.col("doc_id").alias("__lodestack_id"), F.col("text_sha256").alias("__lodestack_sha"))
    digest = F.sha2(text_or_empty(), 256)
    rows = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["__lodestack_id"]) & (digest == kept["__lodestack_sha"]), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.withColumn("__lodestack_sha", digest).dropDuplicates(["doc_id", "__lodestack_sha"]).drop("__lodestack_sha")
