"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is whole passes over its documents plus a remaining budget of words. Documents are counted by exact
length; the remaining budget is first given out in proportion over all lengths, and what is then left, a few times the
longest document, is met by a bounded-knapsack dynamic programme over the unused counts. Where that misses the budget, more
is left to the programme, in the end all, so that the words taken are as near the budget as any choice can be. The counts
chosen by length are turned into documents by a seeded order within each length.
"""

from __future__ import annotations

from math import gcd
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import global_rank
from .common import materialise, spread_rank, text_or_empty

#: Weights given to the sources in code-point order, repeating; no document is taken more often than MAX_PASSES times.
WEIGHTS, MAX_PASSES, SEED = (1, 2, 3), 3, 17


def words_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets_of(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_PASSES) -> DataFrame:
    """source_size and target of each source (source_key, source, source_size): shares of all words by weight, stopped at
    ``most`` times the source's own words; what is cut off is shared again by weight among the others.

    Each round sends two sums to the driver, never the sources. A source that is full stays so, since the share of the
    others only grows; there are as many rounds as shares that grow past another source's end.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = materialise(ranked.withColumn("weight", weight).withColumn("end", F.col("source_size") * F.lit(float(most)) / weight), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, -1.0
    while share > before:
        full = F.col("end") < F.lit(share)
        sums = weighed.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, share = share, max(share, (total - most * (sums[0] or 0)) / sums[1]) if sums[1] else share
    capped = F.col("end") < F.lit(share)
    return weighed.select("source_key", "source_size", F.when(capped, F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def nearest_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded knapsack: how many to take of each length so that the sum is nearest ``budget`` (of two, the one below).

    Counts are split into batches that double. For each sum the programme keeps the first batch that reached it, which is
    never in the way to a sum before it; memory is a few bytes for each sum up to the budget and the longest document.
    """
    top = budget + max((n for n, c in zip(lengths, counts, strict=True) if c), default=0)
    via = np.full(top + 1, -1, np.int32)
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    batches: list[tuple[int, int]] = []
    for i, (n, free) in enumerate(zip(lengths, counts, strict=True)):
        free, batch = min(free, top // n) if n else 0, 1
        while free > 0 and not reach[budget]:
            batch = min(batch, free)
            new = reach[: top + 1 - batch * n] & ~reach[batch * n :]
            at = np.flatnonzero(new) + batch * n
            via[at] = len(batches)
            reach[at] = True
            batches.append((i, batch))
            free -= batch
            batch *= 2
    found = np.flatnonzero(reach)
    at = int(min(found, key=lambda x: (abs(int(x) - budget), x))) if len(found) < 1000 else int(found[np.lexsort((found, np.abs(found - budget)))[0]])
    taken = [0] * len(lengths)
    while at:
        i, batch = batches[via[at]]
        taken[i] += batch
        at -= batch * lengths[i]
    return taken


def fit_counts(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents to take of each length so that their words are as near ``budget`` as any choice can be.

    The programme first gets what rounding leaves of a proportional share. A sum as near as the lengths' common divisor
    allows ends the search; else it gets twice as much, until it has all.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if 2 * budget > total:  # then the documents left out are fitted
        return [c - x for c, x in zip(counts, fit_counts(lengths, counts, total - budget, seed), strict=True)]
    order = [i for i, n in enumerate(lengths) if n > 0 and counts[i]]
    Random(seed).shuffle(order)
    divisor = gcd(*(lengths[i] for i in order)) if order else 1
    nearest = min(budget % divisor, -budget % divisor)
    window = 4 * max(lengths, default=0)
    while True:
        given = max(0, budget - window)
        taken = [c * given // total for c in counts]
        left = budget - sum(n * x for n, x in zip(lengths, taken, strict=True))
        for i in order:  # the floors above lost less than one document of each length
            if left <= window:
                break
            if taken[i] < counts[i]:
                taken[i] += 1
                left -= lengths[i]
        more = nearest_sum([lengths[i] for i in order], [counts[i] - taken[i] for i in order], left)
        for i, x in zip(order, more, strict=True):
            taken[i] += x
        if abs(budget - sum(n * x for n, x in zip(lengths, taken, strict=True))) == nearest or not given:
            return taken
        window *= 2


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document.

    Returns doc_id, source, size, source_size, target, taken, copies; one row per row of ``docs``. Null text has size 0;
    null source is a source of its own, the last. Sources without words get nothing, as do empty documents. Equal rows
    are separate documents. A source's histogram of lengths, of as many rows as it has different ones, goes to one task.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"))
    sizes = materialise(named.withColumn("source_key", key), "mix-sizes")
    histogram = materialise(sizes.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    targets = targets_of(histogram.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)

    def fit(histogram: pd.DataFrame) -> pd.DataFrame:
        histogram = histogram.sort_values("size")
        own, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
        passes = min(MAX_PASSES, int(target // own)) if own else 0
        budget = round(target) - passes * own if passes < MAX_PASSES else 0
        chosen = fit_counts(histogram["size"].tolist(), histogram["n"].tolist(), max(0, budget), seed) if own else 0
        return histogram.assign(passes=passes, chosen=chosen)

    aimed = histogram.drop("source").join(targets, "source_key")
    plan = materialise(aimed.groupBy("source_key").applyInPandas(fit, "source_key string, size long, n long, source_size long, target double, passes long, chosen long"), "mix-plan")
    planned = materialise(sizes.join(plan, ["source_key", "size"]), "mix-planned")
    partial = (F.col("chosen") > 0) & (F.col("chosen") < F.col("n"))
    seeded = planned.where(partial).withColumn("seeded", F.xxhash64("doc_id", F.lit(seed)))
    ranked = spread_rank(seeded, ["source_key", "size"], "n", ["seeded", "doc_id"])
    copies = F.col("passes") + (F.col("rank") < F.col("chosen")).cast("long")
    some = ranked.withColumn("copies", copies).select(*planned.columns, "copies")
    whole = planned.where(~partial).withColumn("copies", F.col("passes") + (F.col("chosen") > 0).cast("long"))
    return some.unionByName(whole).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    plan = materialise(plan_mix(docs, weights, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_rows")), "mix-copies")
    plan = plan.where("__mix_copies > 0").select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), "__mix_copies", "__mix_rows")
    once, several = plan.where("__mix_rows = 1"), plan.where("__mix_rows > 1")
    rows = docs.withColumn("__mix_words", words_of())

    def joined(part: DataFrame) -> DataFrame:
        return rows.join(part.hint("merge"), rows["doc_id"].eqNullSafe(F.col("__mix_id")) & rows["source"].eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size")))

    out = joined(once).withColumn("__mix_times", F.col("__mix_copies"))
    if not several.isEmpty():  # rows with the same id: their copies are dealt out in turn
        turn = F.row_number().over(Window.partitionBy("__mix_id", "__mix_source", "__mix_size").orderBy("text"))
        times = F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + (turn <= F.col("__mix_copies") % F.col("__mix_rows")).cast("long")
        out = out.unionByName(joined(several).withColumn("__mix_times", times).where("__mix_times > 0"))
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*docs.columns)
