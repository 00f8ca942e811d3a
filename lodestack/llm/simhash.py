"""Near-duplicate detection by SimHash with pivot distance tables.

Each distinct fingerprint has a row in a table of its Hamming distances to reference fingerprints (pivots). Two
fingerprints within ``max_bits`` of each other differ by no more than that in any distance, so a pair whose largest
coordinate difference is above is discarded, and only survivors are compared bit by bit. Pairs come up for the test if
they agree on enough blocks of bits (of ``b`` blocks, ``max_bits`` differing bits leave ``b - max_bits`` untouched), which
loses none. Where many fingerprints agree on the same blocks their links are made through common neighbours instead
of pairs: a value one bit from x and two bits from y joins them, which holds for all pairs within three bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialise, scratch, text_or_empty
from .components import connected_components
from .shingle_join import distinct_sets, prefixes, similar_pairs
from .shingle_join import similar_links as shingle_links

#: Production parameters: words in a shingle, differing bits of a link, pivots, hash seed.
WORDS, MAX_BITS, PIVOTS, SEED = 3, 3, 16, 42
#: Fingerprints that agree on the same blocks are compared in pairs up to this many, beyond it through neighbours.
PAIRED = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8) * 256
#: Step, and shifts and factors of a public 64-bit mixing function.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def fingerprint(text: str, words: int = WORDS, seed: int = SEED, tables: int = 1) -> np.ndarray:
    """SimHash of the shingles of a text, A-Z lower-cased; zero for a text without words.

    Further tables use hashes mixed from the first.
    """
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(tables, np.int64)
    shingles = [b" ".join(found)] if len(found) < words else list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    first = hashed = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    out = []
    for i in range(tables):
        if i:
            hashed = first ^ _STEP * np.uint64(i)
            for shift, factor in _MIX:
                hashed = (hashed ^ hashed >> shift) * factor
            hashed ^= hashed >> np.uint64(31)
        lanes = hashed.astype(">u8").view(np.uint8).reshape(-1, 8) + _LANES
        ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        out.append(np.packbits(2 * ones > len(shingles)).view(">i8")[0])
    return np.array(out, np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tables: int = 1) -> DataFrame:
    """doc_id and fps (per table the fingerprint's 64 bits as a long) of every row; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "fps": [fingerprint(t, words, seed, tables) for t in batch["text"]]})

    found = id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id string, fps array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masks(blocks: int, keep: int) -> list[int]:
    """The bits of every choice of ``keep`` of ``blocks`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), keep)]


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks such that about eight of ``n`` evenly spread fingerprints agree on a choice of untouched blocks."""
    blocks = max_bits + 2
    while n / 2 ** (64 * (blocks - max_bits) / blocks) > 8 and blocks < 12:
        blocks += 1
    return blocks


def pivot_tables(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Distances to the pivots, eight in a long, a byte for each."""
    at = [_long(xxhash.xxh64_intdigest(f"pivot-{i}", 1)) for i in range(pivots)]
    lanes = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * (i % 8)) for i, p in enumerate(at)]
    packed = []
    for lo in range(0, pivots, 8):
        total = lanes[lo]
        for lane in lanes[lo + 1 : lo + 8]:
            total = total.bitwiseOR(lane)
        packed.append(total)
    return packed


def _within(left: str, right: str, tables: int, pivots: int, most: int) -> Column:
    """Whether no coordinate of the pivot tables differs by more than ``most``."""
    part = lambda side, i: F.shiftright(F.col(f"{side}.pivots{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127))
    return F.greatest(*(F.abs(part(left, i) - part(right, i)) for i in range(min(pivots, 8 * tables)))) <= most


def links(nodes: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``nodes`` (fp): enough of them to join all that are within
    ``max_bits`` (at most 3) of each other, and none between others."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    blocks = blocks or blocks_for(nodes.count(), max_bits)
    masks = _masks(blocks, blocks - max_bits)
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_long(m))) for m in masks))
    tables = pivot_tables(F.col("fp"), pivots)
    rows = nodes.select("fp", F.posexplode(keys).alias("choice", "block_key"))
    counts = rows.groupBy("choice", "block_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the exploded rows for as small as their table and would broadcast them.
    rows = materialise(rows.join(counts.hint("merge"), ["choice", "block_key"]), "simhash-blocks")
    few = rows.where(F.col("n") <= PAIRED).select("*", *(t.alias(f"pivots{i}") for i, t in enumerate(tables)))
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.block_key") == F.col("b.block_key")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, same & _within("a", "b", len(tables), pivots, max_bits)).where(F.bit_count(differ) <= max_bits).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = rows.where(F.col("n") > PAIRED)
    if many.isEmpty():
        return pairs.distinct()
    near, far = max_bits // 2, max_bits - max_bits // 2
    free = [[1 << i for i in range(64) if not m >> i & 1] for m in masks]
    flips = [[sum(c) for k in range(far + 1) for c in combinations(f, k)] for f in free]
    spark = nodes.sparkSession
    table = spark.createDataFrame([(i, _long(x), x.bit_count() <= near) for i, all_ in enumerate(flips) for x in all_], "choice int, flip long, is_near boolean")
    spots = many.select("fp", "choice").join(F.broadcast(table), "choice").select("choice", "fp", "is_near", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    hubs = spots.groupBy("choice", "spot").agg(F.min(F.when(F.col("is_near"), F.col("fp"))).alias("a"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("a is not null and low <> high")
    starred = spots.join(hubs.select("choice", "spot", "a"), ["choice", "spot"]).select("a", F.col("fp").alias("b")).where("a <> b")
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links), one row per row of ``docs``.

    Null text is empty; texts without words have fingerprint zero and link like any other. Rows without id get the
    component's smallest id too, null only if nobody there has one. Repeated rows come out as often as they went in.
    An empty table gives an empty result; other columns are ignored.
    """
    found = fingerprints(docs, words, SEED, id_col, text_col).select("doc_id", F.col("fps")[0].alias("fp"))
    found = materialise(found, "simhash-fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of ``found`` (fp, node): enough of them to join all whose fingerprints are within ``MAX_BITS``."""
    named = found.select("fp", "node").distinct()
    nodes = materialise(named.groupBy("fp").agg(F.min("node").alias("first")), "simhash-nodes")
    own = lambda side: nodes.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    between = links(nodes.select("fp")).join(own("a"), "a").join(own("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = named.join(nodes, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_groups(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, text_key (hash of the text), root (one for each group), one row per distinct id and text: groups hang together
    by pairs whose shingle sets have at least that Jaccard ``similarity``. Texts without words are one group.

    SimHash links that the whole sets confirm make the groups; the join by shingles adds pairs beyond a fingerprint's reach,
    between texts that no such link has joined.
    """
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    texts = rows.select("text_key", "text")
    found, drop = scratch(prefixes(texts, words, similarity, fingerprint), "shingle-prefixes")
    nodes, found = distinct_sets(found), materialise(found.select("text_key", "fp", "node").distinct(), "shingle-texts")
    drop()
    near = similar_pairs(texts, nodes, fingerprint_pairs(found), words, similarity)
    roots = connected_components(near.unionByName(shingle_links(texts, nodes, near, words, similarity)))
    named = found.join(roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "text_key").distinct().join(named, "text_key")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, with the columns of ``docs``.

    Groups hang together by pairs whose sets of shingles have at least that Jaccard ``similarity``, all of which are found.
    Of a group's different texts with that id one stays, of equal rows too; texts of other groups stay whatever their id.
    Rows without id stay if no row with an id is in their group.
    """
    groups = materialise(similar_groups(docs, words, similarity), "simhash-groups")
    first = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    kept = groups.join(first, "root", "left").where(F.col("first").isNull() | F.struct("doc_id", "text_key").eqNullSafe(F.col("first")))
    kept = materialise(kept.select(F.col("doc_id").alias("__lodestack_id"), F.col("text_key").alias("__lodestack_key")).distinct(), "simhash-kept")
    key = F.xxhash64(text_or_empty())
    rows = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["__lodestack_id"]) & (key == kept["__lodestack_key"]), "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id", key).count().where("count > 1").isEmpty():
        named = rows.where("doc_id is not null").withColumn("__lodestack_key", key)
        order = Window.partitionBy("doc_id", "__lodestack_key").orderBy("text")
        named = named.withColumn("__lodestack_row", F.row_number().over(order)).where("__lodestack_row = 1").drop("__lodestack_row", "__lodestack_key")
        rows = named.unionByName(rows.where("doc_id is null"))
    return rows
