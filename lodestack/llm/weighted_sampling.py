"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words, weighted by their counts. For each of K samples every term draws, from a hash of term
and sample number, r and c from Gamma(2, 1) and b from U(0, 1), and with weight S has t = floor(ln S / r + b),
ln y = r (t - b), ln a = ln c - ln y - r. The sample is the (term, t) with the least a. Two documents have equal samples
with a probability that equals their generalised Jaccard similarity, so the share of equal samples estimates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, text_or_empty

#: Production parameters: samples in a signature, hash seed.
SAMPLES, SEED = 32, 11
#: Buckets of neighbouring ids: coarse ones, fine ones in each of them, sampled ids for each fine one at least.
COARSE, FINE, PER_BOUND = 64, 64, 8
#: Documents of a task, whose words are counted in memory, and most tasks; beyond them tasks grow, and spill.
PER_TASK, MOST_TASKS = 512, 1 << 14


def _unit(bits: Column) -> Column:
    """Whole numbers below 2^21 to (0, 1)."""
    return (bits.bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) * F.lit(2.0**-21)


def sample(term: Column, log_weight: Column, k: int, seed: int = SEED) -> Column:
    """The k-th draw of a term as one long that orders as a does: 43 bits of ln a, 20 bits of a hash of (term, t)."""
    one, two = F.xxhash64(term, F.lit(seed + 2 * k)), F.xxhash64(term, F.lit(seed + 2 * k + 1))
    r = -F.ln(_unit(one) * _unit(F.shiftrightunsigned(one, 21)))
    log_c = F.ln(-F.ln(_unit(two) * _unit(F.shiftrightunsigned(two, 21))))
    b = _unit(F.shiftrightunsigned(one, 42))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b + 1.0)
    place = F.least(F.greatest(F.floor((log_a + 512.0) * F.lit(float(1 << 32))), F.lit(0)), F.lit((1 << 43) - 1)).cast("long")
    return F.shiftleft(place, 20).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 20) - 1)))


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """keys, and in a column named after each of ``weights`` the signature by it (array of longs; null if nothing draws).

    ``terms`` has keys, term (long) and the weights (long); a null term and a weight of 0 draw nothing.
    """
    logs = (F.when(F.col("term").isNotNull() & (F.col(w) > 0), F.ln(F.col(w).cast("double"))).alias(w) for w in weights)
    least = lambda w, k: F.min(F.when(F.col(w).isNotNull(), sample(F.col("term"), F.col(w), k, seed)))
    found = terms.select(*keys, "term", *logs).groupBy(*keys).agg(*(least(w, k).alias(f"{w}{k}") for w in weights for k in range(samples)))
    return found.select(*keys, *(F.when(F.col(f"{w}0").isNotNull(), F.array(*(F.col(f"{w}{k}") for k in range(samples)))).alias(w) for w in weights))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples; 1 for two empty signatures, 0 where one is empty."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(equal / F.size(a))


def _hex(signature: str) -> Column:
    """A signature as text: eight hex digits for each sample, from all of its bits."""
    return F.coalesce(F.array_join(F.transform(signature, lambda s: F.lpad(F.lower(F.hex(F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def _buckets(rows: DataFrame, coarse: int, fine: int) -> DataFrame:
    """Adds ``bucket``: how many bounds are at or below ``at``. The bounds, at most ``coarse * fine``, part a sample evenly."""
    wanted = coarse * fine * PER_BOUND
    share = 2.0 * wanted / max(1, rows.count())
    sampled = rows.select("at").where(F.shiftrightunsigned(F.xxhash64("at", F.lit(3)), 11).cast("double") * 2.0**-53 < share)
    found = sampled.distinct().orderBy("at").limit(4 * wanted).collect()
    step = max(PER_BOUND, -(-len(found) // (coarse * fine)))
    bounds = [r["at"] for r in found[step - 1 :: step]]
    chunks = [bounds[i : i + fine] for i in range(0, len(bounds) + 1, fine)]
    kind = rows.schema["at"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(list(enumerate(chunks)), f"chunk int, bounds array<{kind}>")
    ends = F.array(*(F.struct(*(F.lit(x).alias(name) for name, x in c[-1].asDict().items())) for c in chunks if len(c) == fine)).cast(f"array<{kind}>")
    passed = lambda where: F.size(F.filter(where, lambda b: b <= F.col("at")))
    rows = rows.withColumn("chunk", passed(ends)).join(F.broadcast(table), "chunk")
    return rows.withColumn("bucket", (F.col("chunk") * fine + passed(F.col("bounds"))).cast("long")).drop("chunk", "bounds")


def with_next(docs: DataFrame, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """bucket, place, doc_id, text, text_key, next_text and is_head: every row of ``docs`` with the text of the next one by
    ascending doc_id, null ids first, and hash of the text (after the last row the first).

    Rows fall into buckets between ids of a sample, at most ``coarse * fine`` of them and one more, whatever the number of
    rows; where they are cut changes no result. The head of each bucket is also sent to the end of the bucket before
    (``is_head`` marks it), so that neighbours meet in a bucket, where ``place`` numbers them.
    """
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    own = _buckets(keyed.withColumn("at", F.struct("doc_id", "text_key")), coarse, fine)
    heads = own.groupBy("bucket").agg(F.min("at").alias("head"))
    order = Window.orderBy("bucket")  # one row for each bucket
    last = F.max("bucket").over(Window.partitionBy())
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(order), last).alias("before"))
    first = keyed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
    copies = first.select("doc_id", "text", "text_key", F.col("before").alias("bucket"), F.lit(True).alias("is_head"))
    rows = own.select("doc_id", "text", "text_key", "bucket", F.lit(False).alias("is_head")).unionByName(copies)
    rows = rows.repartition(max(1, min(MOST_TASKS, -(-docs.count() // PER_TASK))), "bucket")
    inside = Window.partitionBy("bucket").orderBy("is_head", "doc_id", "text_key")
    return rows.withColumn("place", F.row_number().over(inside)).withColumn("next_text", F.lead("text").over(inside))


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of
    ``docs``. Null text is empty; a text without words has the empty fingerprint, which is like itself only. Repeated rows
    are separate documents that follow each other; rows with the same id and different texts are ordered by a hash of the
    text. A single document is its own next. A null id comes first. Ids may be of any type that has an order. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    versions = with_next(rows).select("bucket", "place", "is_head", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(~F.col("is_head"), edited).alias("edited"))
    digested = versions.withColumn("edited_digest", F.unhex(F.sha2("edited", 256)))
    keys = ["bucket", "place", "is_head", "doc_id", "n_chars", "edited_digest"]
    both = digested.select(*keys, F.posexplode(F.array("text", "edited")).alias("version", "body"))
    words = both.select(*keys, "version", F.explode(F.split(F.coalesce("body", F.lit("")), WORD_SPLIT)).alias("word"))
    terms = words.select(*keys, "version", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    weighed = terms.groupBy(*keys, "term").agg(*(F.sum((F.col("version") == v).cast("long")).alias(name) for v, name in enumerate(("own", "changed"))))
    signed = signatures(weighed, keys, ["own", "changed"], samples, seed)
    out = signed.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("is_head"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_digest")).alias("edited_sha256"), _hex("own").alias("fingerprint"), _hex("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"))
