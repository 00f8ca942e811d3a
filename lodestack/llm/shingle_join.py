"""All pairs of texts whose shingle sets have at least a given Jaccard similarity, but for those that known links join.

An exact join by prefixes: with all shingles in one order, two sets of similarity t or more share one among the first
``n - ceil(t n) + 1`` of each (n: shingles of the set). The order only decides how many pairs come up, never which are
found; shingles that are common in a sample of the texts come last. Pairs whose sizes or places in the order rule out
the similarity are discarded, and every other one is decided by its two whole sets.

Where many texts share a shingle, they are first compared with one of them, that with most such shingles. Texts that this
joins need no further pair; all pairs between texts not joined yet are compared, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .components import connected_components

#: Texts that share a shingle are compared in pairs at once up to this many.
PAIRED = 16
#: Rows of a shingle's texts that are compared in one task with the shingle's other texts.
PER_SALT = 1024
#: One text in so many is counted for the order, shingles in so many of these come last, at most so many (2 MB).
SAMPLE, COMMON, MOST_COMMON = 8, 4, 1 << 18
SEED = 42


def shingle_set(text: str, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, A-Z lower-cased, ascending; none for a text without words."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    shingles = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def _key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares at least with any that is as similar as that."""
    return math.ceil(similarity * n - 1e-9)


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles that are common in a sample of ``texts`` (text_key, text), rarest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield pd.DataFrame({"shingle": np.concatenate([shingle_set(t, words) for t in batch["text"][at : at + 256]])})

    sample = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    return np.array([r["shingle"] for r in reversed(found)], np.int64)


def prefixes(texts: DataFrame, words: int, similarity: float, fingerprint: Callable[[str], np.ndarray]) -> DataFrame:
    """text_key, fp (the first of its fingerprints), node (one for each distinct set), size and prefix (in order) of every
    row of ``texts`` (text_key, text)."""
    common = common_shingles(texts, words)
    place = np.argsort(common)
    ordered = common[place]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, nodes, sizes, firsts = [], [], [], []
            for text in batch["text"]:
                fps.append(int(fingerprint(text)[0]))
                own = shingle_set(text, words)
                at = np.full(len(own), -1)
                if len(ordered):
                    near = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                    at = np.where(ordered[near] == own, place[near], -1)
                keep = len(own) - least_shared(len(own), similarity) + 1 if len(own) else 0
                nodes.append(_key(own))
                sizes.append(len(own))
                firsts.append(own[np.argsort(at, kind="stable")[:keep]])
            yield pd.DataFrame({"text_key": batch["text_key"], "fp": fps, "node": nodes, "size": sizes, "prefix": firsts})

    return texts.mapInPandas(run, "text_key long, fp long, node long, size int, prefix array<long>")


def whole_sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its whole set, for ``nodes`` (node, text_key of one of its texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"node": [_key(s) for s in sets], "shingles": sets})

    keys = materialise(nodes.select("text_key"), "shingle-keys")
    wanted = texts.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    return wanted.select("text").mapInPandas(run, "node long, shingles array<long>")


def similar_pairs(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar by their whole sets."""
    pairs, drop_pairs = scratch(pairs.distinct(), "shingle-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets, drop_sets = scratch(whole_sets(texts, nodes.join(wanted, "node", "left_semi"), words), "shingle-sets")
    own = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = materialise(both.where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b"), "shingle-links")
    drop_pairs()
    drop_sets()
    return links


def _possible(x: str, y: str, similarity: float):
    """Whether sizes and places of a shared shingle leave the similarity possible (always at the first one shared)."""
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return left >= F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-6


def _pair(x: str = "x", y: str = "y") -> list:
    return [F.least(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("a"), F.greatest(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("b")]


def distinct_sets(found: DataFrame) -> DataFrame:
    """One row of ``found`` (see ``prefixes``) for each node."""
    return materialise(found.groupBy("node").agg(F.min(F.struct("text_key", "size", "prefix")).alias("s")).select("node", "s.*"), "shingle-nodes")


def similar_links(texts: DataFrame, nodes: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between ``nodes`` (see ``distinct_sets``): with those of ``known``, which are as similar as
    ``similarity``, enough of them to join all that are, and none between others. What ``known`` joins isn't compared again."""
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "shingle"))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(counts, "shingle").join(connected_components(known), "node", "left")
    rows = materialise(rows.withColumn("root", F.coalesce("root", "node")), "shingle-rows")
    few, many = rows.where(F.col("n") <= PAIRED), rows.where(F.col("n") > PAIRED)
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, apart & (F.col("x.node") < F.col("y.node")) & _possible("x", "y", similarity)).select(*_pair())
    weights = many.groupBy("node").agg(F.sum("n").alias("weight"))
    first = F.max(F.struct("weight", "node", "root", "size", "pos")).alias("first")
    centres = many.join(weights, "node").groupBy("shingle").agg(first).select("shingle", "first.*")
    x, y = many.alias("x"), centres.alias("y")
    centred = x.join(y, apart & _possible("x", "y", similarity)).select(*_pair())
    links = similar_pairs(texts, nodes, pairs.unionByName(centred), words, similarity)
    if many.isEmpty():
        return links
    rooted = many.drop("root").join(connected_components(links.unionByName(known)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "shingle-rooted")
    parts = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("part"))
    largest = parts.groupBy("shingle").agg(F.max(F.struct("part", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = rooted.join(largest, "shingle")
    salts = F.ceil(F.col("n") / PER_SALT)
    x = open_.where("root <> largest").withColumn("salt", F.pmod(F.xxhash64("node"), salts)).alias("x")
    y = open_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).alias("y")
    once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root"))
    rest = x.join(y, same & once & _possible("x", "y", similarity)).select(*_pair())
    return links.unionByName(similar_pairs(texts, nodes, rest, words, similarity))
