"""Packing documents into training sequences: shortest-pack-first over the histogram of lengths.

Documents are cut at every ``max_tokens`` ids; the pieces are counted by length. Lengths are placed longest first, each
into the packs that are filled least among those with room, and packs that look alike are one pattern with a count.
Patterns are then joined back to the pieces by their rank among the pieces of the same length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, spread_rank

#: Production parameters.
MAX_TOKENS, END_ID = 4096, 2
#: Words whose ids a worker remembers in each of two generations, and bytes of a word that is remembered (under 400 MB).
REMEMBERED, LONGEST_WORD = 400_000, 64
#: Signs that end a token of letters and are encoded by themselves.
TAIL = b".,!?;:*$%&#|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _is_letters(word: bytes) -> bool:
    """Whether a word, once normalised, is nothing but letters. Rare scripts count as no letters, which is never wrong."""
    if word.isascii():
        return word.isalpha()
    text = unicodedata.normalize("NFC", word.decode("utf-8")).lower()
    return text.isalpha() and max(text) < "\u0530"


class WordEncoder:
    """Ids of a text as little-endian 32-bit numbers.

    Tokens of this tokenizer are lower-cased and never span white space or the border from a letter to a sign, so that
    the ids of a text are those of its words. A worker remembers them in two generations: when the younger is full it
    replaces the older. Long words, such as texts without white space, aren't remembered. Words of letters become one
    stretch of tokens each, whose last one is marked, so that many of them are encoded at once. Texts that may hold a
    special token are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, which are encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._each(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of ``words``; short ones are remembered."""
        if len(self.young) + 2 * len(words) > REMEMBERED:
            self.young, self.old = {}, self.young
        found, letters, other, joined = {}, set(), set(), []
        for w in words:
            if (ids := self.old.get(w)) is not None:
                found[w] = ids
                continue
            core = w.rstrip(TAIL)
            if not core or not _is_letters(core):
                other.add(w)
                continue
            letters.add(core)
            if len(core) < len(w):
                tail = w[len(core) :]
                joined.append((w, core, tail))
                other.add(tail)
        for part, encode in ((letters, self._letters), (other, self._each)):
            new = [w for w in part if w not in self.young and w not in found]
            if new:
                found.update(zip(new, encode(new), strict=True))
        own = lambda w: found[w] if w in found else self.young[w]
        for w, core, tail in joined:
            found[w] = own(core) + own(tail)
        self.young.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST_WORD)
        return found

    def __call__(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        if b"<|" in raw:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = raw.lower().split()
        found = list(map(self.young.get, words))
        if None in found:
            learnt = self._learn({w for w, ids in zip(words, found, strict=True) if ids is None})
            found = [learnt[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


def tokenize(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: doc_id, start, length, ids_crc32, doc_tokens, ids (binary)."""
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = WordEncoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, max_tokens):
                    part = ids[4 * start : 4 * (start + max_tokens)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, part))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    found = id_and_text(docs, id_col, text_col).mapInPandas(pieces, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def pack_patterns(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, list[int]]]:
    """Packing patterns as (count, lengths in order); every length of the histogram is placed as often as it occurs."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        wanted = histogram[length]
        for room in range(max_tokens, length - 1, -1):  # the least filled first; packs that still have room come again
            packs = open_packs.pop(room, [])
            while packs:
                count, lengths = packs.pop()
                now = min(count, wanted)
                if now:
                    open_packs[room - length].append((now, (*lengths, length)))
                if count > now:
                    open_packs[room].append((count - now, lengths))
                wanted -= now
        full, rest = divmod(wanted, max_tokens // length)
        if full:
            each = max_tokens // length
            open_packs[max_tokens - each * length].append((full, (length,) * each))
        if rest:
            open_packs[max_tokens - rest * length].append((1, (length,) * rest))
    return [(count, list(lengths)) for room in sorted(open_packs) for count, lengths in open_packs[room]]


def pattern_slots(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Which ranks of each length go where: length, first_rank, last_rank (exclusive), repeats, first_sequence, first_offset."""
    used, rows, sequence = defaultdict(int), [], 0
    for count, lengths in patterns:
        offset, i = 0, 0
        while i < len(lengths):
            n = lengths[i]
            repeats = next((k for k in range(i, len(lengths)) if lengths[k] != n), len(lengths)) - i
            rows.append((n, used[n], used[n] + count * repeats, repeats, sequence, offset))
            used[n] += count * repeats
            offset += n * repeats
            i += repeats
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "last_rank", "repeats", "first_sequence", "first_offset"], dtype="int64")


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, start and length.

    The driver sees the histogram of lengths and the patterns over it, whose sizes ``max_tokens`` bounds.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = pieces.sparkSession
    slots = pattern_slots(pack_patterns(histogram, max_tokens))
    slots = spark.createDataFrame(slots, "length long, first_rank long, last_rank long, repeats long, first_sequence long, first_offset long")
    counts = spark.createDataFrame(sorted(histogram.items()), "length long, length_n long")
    ranked = spread_rank(pieces.join(F.broadcast(counts), "length"), ["length"], "length_n", ["doc_id", "start", "ids_crc32"])
    inside = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(inside / F.col("repeats")))
        .withColumn("offset", F.col("first_offset") + (inside % F.col("repeats")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Null or empty text is one piece with the end id alone. Repeated rows are packed as often as they occur. Long texts
    are cut into several pieces. An empty table gives an empty result; other columns are ignored.
    """
    tokens = tokenize(docs, tokenizer, max_tokens, end_id)
    return place(materialise(tokens if with_ids else tokens.drop("ids"), "pack-pieces"), max_tokens)
