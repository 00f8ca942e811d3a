"""Secret scans: fixed patterns, and password guess costs for values in a credential context.

A value that follows a credential word is segmented into words, dates, repeats, keyboard walks, sequences and brute-force
spans such that an attacker who tries such segments needs the fewest guesses; the dynamic programme runs over the
logarithms. Values that take many guesses are secrets, ``changeme123`` is a placeholder. Words are ranked: frequent password
words come first, then the words of a public vocabulary in its order. A value of nothing but words and signs between them
(``required``, ``process.env.TOKEN``) is a secret only from ``PHRASE_WORDS`` words on.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A credential word, a sign, and a value; the scan for guess costs.
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|client)[_-]?(?:key|secret|token))["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
MIN_HEX, MIN_ASSIGN, MIN_ACCESS = 32, 8, 16
#: A value is a secret from so many guesses on (decimal logarithm).
MIN_GUESSES = 8.0
#: Frequent password words, most frequent first.
WORDS = (
    "password pass admin root user login welcome letmein master secret token key test guest default change changeme "
    "me your here my example sample dummy placeholder none null true false hello dragon monkey shadow love sun "
    "princess football baseball iloveyou trust super hunter summer winter spring autumn monday friday january march "
    "april june july august october access server system data base database temp demo dev prod stage local host "
    "mail web site account public private insert replace fill todo value string text abc one two three the and"
).split()
#: Words of a vocabulary have so many letters; a value of words alone is a secret from so many words on.
SHORTEST, LONGEST, PHRASE_WORDS = 3, 16, 4
LEET = str.maketrans("@4301!5$7", "aaeolisst")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for lo, hi in zip(ROWS, ROWS[1:], strict=False) for i, a in enumerate(lo) for b in hi[max(0, i - 1) : i + 1]}
BESIDE |= {(b, a) for a, b in BESIDE}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_COST, YEAR_COST = math.log10(365 * 120), math.log10(120)


def _alphabet(ch: str) -> float:
    if ch.isdigit():
        return 1.0
    return math.log10(26) if ch.isascii() and ch.isalpha() else math.log10(33) if ch.isascii() else 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def ranked_words(path: str | None) -> dict[str, int]:
    """Rank from 1 of each word: ``WORDS``, then the tokens of a byte-level vocabulary that start a word, by their ids."""
    ranks = {w: i + 1 for i, w in enumerate(WORDS)}
    if path:
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        for token in sorted(vocabulary, key=vocabulary.get):
            word = token[1:].lower()
            if token[0] == "\u0120" and SHORTEST <= len(word) <= LONGEST and word.isascii() and word.isalpha():
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def segments(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[str, int, int]]]:
    """The cheapest segmentation of ``value``: the decimal logarithm of its guesses and its parts (kind, start, end), of
    kind word, date, walk, sequence, repeat or brute (one character each). Steps are linear in the length."""
    n, low = len(value), value.lower()
    plain = low if len(low) == n else value
    leet = plain.translate(LEET)
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    walk = turn = run = 0  # lengths so far of the walk, the sequence and the repeat that end here
    step, alike = 0, {2: 0, 3: 0, 4: 0}
    dates: dict[int, list[tuple[int, float]]] = {}
    for m in (m for i in range(n) if value[i].isdigit() and (m := DATE.match(value, i))):
        dates.setdefault(m.end(), []).append((m.start(), YEAR_COST if m.end() - m.start() == 4 else DATE_COST))
    for j in range(1, n + 1):
        ch = plain[j - 1]
        cost, via = best[j - 1] + _alphabet(value[j - 1]), ("brute", j - 1)
        if j > 1:
            before = plain[j - 2]
            walk = walk + 1 if (before, ch) in BESIDE else 0
            d = ord(ch) - ord(before)
            turn = turn + 1 if d in (1, -1) and d == step else int(d in (1, -1))
            run = run + 1 if ch == before else 0
            step = d
        for kind, length, base in (("walk", walk, math.log10(94)), ("sequence", turn, math.log10(26)), ("repeat", run, _alphabet(ch))):
            for k in ({length, 3} if length >= 3 else {2} if length == 2 and kind != "walk" else ()):
                if (price := best[j - 1 - k] + base + math.log10(k + 1)) < cost:
                    cost, via = price, (kind, j - 1 - k)
        for i in range(max(0, j - LONGEST), j - 1):
            rank = ranks.get(plain[i:j]) or (ranks.get(leet[i:j], 0) * 2)
            if rank:
                part = value[i:j]
                price = best[i] + math.log10(rank) + (0 if part.islower() else 0.3 if part.istitle() or part.isupper() else 1.0) + 0.3
                if price < cost:
                    cost, via = price, ("word", i)
        for i, price in dates.get(j, ()):
            if best[i] + price < cost:
                cost, via = best[i] + price, ("date", i)
        for unit in alike:  # a unit of several characters, repeated
            alike[unit] = alike[unit] + 1 if j > unit and plain[j - 1 - unit] == ch else 0
            k = alike[unit] // unit + 1
            if k > 1:
                first = j - k * unit
                price = best[first] + min(best[first + unit] - best[first], sum(map(_alphabet, value[j - unit : j]))) + math.log10(k)
                if price < cost:
                    cost, via = price, ("repeat", first)
        best[j], back[j] = cost, via
    parts, at = [], n
    while at:
        kind, start = back[at]
        parts.append((kind, start, at))
        at = start
    return best[n], parts[::-1]


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes."""
    return segments(value, ranked_words(default_vocabulary()) if ranks is None else ranks)[0]


def secret_cost(value: str, ranks: dict[str, int], min_guesses: float = MIN_GUESSES) -> float | None:
    """The guess cost of a value that is a secret, else nothing."""
    cost, parts = segments(value, ranks)
    if cost < min_guesses:
        return None
    words = sum(kind == "word" for kind, _, _ in parts)
    only_words = all(kind == "word" or not any(c.isalnum() for c in value[a:b]) for kind, a, b in parts)
    return None if only_words and words < PHRASE_WORDS else cost


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def hex_runs(text: str, least: int = MIN_HEX) -> list[tuple[int, int]]:
    """Runs of 0-9a-f of at least ``least`` characters, found between the characters that are none."""
    other = np.flatnonzero(~_HEX[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)])
    edges = np.concatenate(([-1], other, [len(text)]))
    at = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[i]) + 1, int(edges[i + 1])) for i in at]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_secrets(text: str, min_guesses: float = MIN_GUESSES, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, guesses) in code points, by start, then kind in the order of KINDS."""
    spans: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        spans += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if len(text) >= MIN_HEX:
        spans += [("hex", a, b, None) for a, b in hex_runs(text)]
    if hinted:
        ranks = ranked_words(default_vocabulary()) if ranks is None else ranks
        starts, ends = _merged([(a, b) for _, a, b, _ in spans])
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            before = bisect_right(starts, b - 1) - 1  # the last one that starts within or before the value
            if (before < 0 or ends[before] <= a) and (cost := secret_cost(m[1], ranks, min_guesses)) is not None:
                spans.append(("guess", a, b, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, min_guesses: float = MIN_GUESSES, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, guesses>> of every row.

    Null and empty text have no spans. Repeated rows come out as often as they went in; an empty table gives an empty
    result; other columns are ignored. ``guesses`` is null for the fixed patterns. ``vocabulary`` is the path, on every
    machine, of a byte-level tokenizer whose words are ranked.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = ranked_words(path)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "guesses": g} for k, a, b, g in find_secrets(t, min_guesses, ranks)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": found})

    found = id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id string, spans array<struct<kind: string, start: long, end: long, guesses: double>>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans are replaced together."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the fixed patterns' spans as kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "guess").encode()).hexdigest()
