"""XPRESS (LZ77 and Huffman codes over 512 symbols): one chunk in, one chunk out; and chunked resources.

The public description of the format is the Xpress compression algorithm's specification. Codes have at most 15 bits;
code lengths come first, in 256 bytes; the bits follow in 16-bit words, among which the bytes of long lengths lie.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter, defaultdict

SYMBOLS, LONGEST_CODE, LEAST_MATCH, TABLE_BYTES = 512, 15, 3, 256
#: Header flags of a compressed archive and of the compression types.
COMPRESSED_FLAG, XPRESS_FLAG, LZX_FLAG, LZMS_FLAG = 0x2, 0x20000, 0x40000, 0x80000


class BadData(ValueError):
    pass


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes by symbol: (code, bits)."""
    out, code, before = {}, 0, 0
    for bits, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= bits - before
        if code >> bits:
            raise BadData("too many codes")
        out[symbol] = (code, bits)
        code, before = code + 1, bits
    return out


def decompress(data: bytes, size: int) -> bytes:
    """The ``size`` bytes that a compressed chunk stands for."""
    if len(data) < TABLE_BYTES + 4:
        raise BadData("the chunk is too short")
    lengths = [n for b in data[:TABLE_BYTES] for n in (b & 15, b >> 4)]
    table: list[tuple[int, int] | None] = [None] * (1 << LONGEST_CODE)
    for symbol, (code, bits) in codes_of(lengths).items():
        first = code << LONGEST_CODE - bits
        table[first : first + (1 << LONGEST_CODE - bits)] = [(symbol, bits)] * (1 << LONGEST_CODE - bits)
    at = TABLE_BYTES
    out = bytearray()

    def word() -> int:
        nonlocal at
        at += 2
        return int.from_bytes(data[at - 2 : at], "little")  # zeroes beyond the end

    held, spare = word() << 16 | word(), 16

    def drop(n: int) -> None:
        nonlocal held, spare
        held, spare = held << n & 0xFFFFFFFF, spare - n
        if spare < 0:
            held |= word() << -spare
            spare += 16

    while len(out) < size:
        found = table[held >> 32 - LONGEST_CODE]
        if found is None:
            raise BadData("no such code")
        symbol, bits = found
        drop(bits)
        if symbol < 256:
            out.append(symbol)
            continue
        length, n = symbol & 15, symbol >> 4 & 15
        if length == 15:
            if at >= len(data):
                raise BadData("the chunk ends within a length")
            length, at = data[at] + 15, at + 1
            if length == 270:
                length = word()
                if not length:
                    length, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        length += LEAST_MATCH
        offset = (held >> 32 - n if n else 0) + (1 << n)
        drop(n)
        if offset > len(out) or len(out) + length > size:
            raise BadData("a match leads outside the chunk")
        start = len(out) - offset
        while length > 0:
            part = out[start : start + length]
            out += part
            length -= len(part)
            start += len(part)
    return bytes(out)


def code_lengths(counts: dict[int, int], symbols: int = SYMBOLS, longest: int = LONGEST_CODE) -> list[int]:
    """Lengths of a Huffman code of at most ``longest`` bits; counts are flattened until it fits."""
    counts = {s: n for s, n in counts.items() if n}
    for s in range(2):  # a code needs two symbols
        if len(counts) < 2:
            counts.setdefault(s, 1)
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        depth: Counter = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            depth.update(a[2] + b[2])
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= longest:
            return [depth.get(s, 0) for s in range(symbols)]
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def _items(data: bytes) -> list[tuple[int, int]]:
    """Literals (0, byte) and matches (length, offset), each match the longest of the latest places of its three bytes."""
    out, places, i = [], defaultdict(list), 0
    while i < len(data):
        best = (0, 0)
        for j in places[data[i : i + LEAST_MATCH]][-8:]:
            n = LEAST_MATCH
            while i + n < len(data) and n < 60_000 and data[j + n] == data[i + n]:
                n += 1
            if i + n <= len(data) and n > best[0] and i - j < 1 << 16:
                best = (n, i - j)
        step = best[0] if best[0] >= LEAST_MATCH and i + LEAST_MATCH <= len(data) else 1
        out.append(best if step > 1 else (0, data[i]))
        for k in range(i, min(i + step, len(data) - LEAST_MATCH + 1)):
            places[data[k : k + LEAST_MATCH]].append(k)
        i += step
    return out


def compress(data: bytes) -> bytes:
    """A chunk that ``decompress`` turns into ``data``; simple rather than small."""
    items = _items(data)
    symbol = lambda length, x: x if not length else 256 + (min(length - LEAST_MATCH, 15) | x.bit_length() - 1 << 4)
    lengths = code_lengths(Counter(symbol(*i) for i in items))
    codes = codes_of(lengths)
    out = bytearray(lengths[2 * i] | lengths[2 * i + 1] << 4 for i in range(TABLE_BYTES)) + bytearray(4)
    slots, held, free = [TABLE_BYTES, TABLE_BYTES + 2], 0, 16

    def put(n: int, value: int) -> None:
        nonlocal held, free
        if free >= n:
            held, free = held << n | value, free - n
            return
        struct.pack_into("<H", out, slots[0], (held << free | value >> n - free) & 0xFFFF)
        slots[:] = [slots[1], len(out)]
        out.extend(b"\0\0")
        free += 16 - n
        held = value & (1 << 16 - free) - 1

    for length, x in items:
        code, bits = codes[symbol(length, x)]
        put(bits, code)
        if length:
            if (more := length - LEAST_MATCH - 15) >= 0:
                out += bytes([more]) if more < 255 else b"\xff" + struct.pack("<H", length - LEAST_MATCH)
            n = x.bit_length() - 1
            put(n, x - (1 << n))
    struct.pack_into("<H", out, slots[0], held << free & 0xFFFF)
    return bytes(out)


def decompress_chunk(kind: int, data: bytes, size: int, chunk: int) -> bytes:
    """A chunk by the header flag of its compression type."""
    if kind == XPRESS_FLAG:
        return decompress(data, size)
    if kind == LZX_FLAG:
        from . import lzx

        return lzx.decompress(data, size, chunk)
    raise BadData("the chunk is compressed in a way that isn't read here")


def compress_chunk(kind: int, data: bytes, chunk: int) -> bytes:
    if kind == LZX_FLAG:
        from . import lzx

        return lzx.compress(data, chunk)
    return compress(data)


def _chunk_places(stored: bytes, size: int, chunk: int, lengths_only: bool) -> list[tuple[int, int]]:
    """Where in ``stored`` each chunk begins and ends. The table before the chunks tells where all but the first begin, or,
    in solid resources, how long each is."""
    n = -(-size // chunk)
    if lengths_only:
        ends, at = [], 4 * n
        for length in struct.unpack_from(f"<{n}I", stored):
            at += length
            ends.append(at)
        places = list(zip([4 * n, *ends], ends, strict=False))
    else:
        width, kind = (8, "Q") if size > 0xFFFFFFFF else (4, "I")
        head = width * (n - 1)
        starts = [head, *(head + x for x in struct.unpack_from(f"<{n - 1}{kind}", stored))]
        places = list(zip(starts, [*starts[1:], len(stored)], strict=True))
    if any(not 0 <= a <= b <= len(stored) for a, b in places):
        raise BadData("bad table of chunks")
    return places


def read_chunked(stored: bytes, size: int, chunk: int, kind: int = XPRESS_FLAG, first: int = 0, end: int | None = None, lengths_only: bool = False) -> bytes:
    """Bytes ``first`` to ``end`` (all by default) of a compressed resource; only the chunks that they lie in are decoded.

    A resource is a table of chunks and the chunks; one that didn't shrink is stored as it is.
    """
    end = size if end is None else min(end, size)
    if not 0 <= first <= end:
        raise BadData("the range lies outside the resource")
    if first == end:
        return b""
    places, out = _chunk_places(stored, size, chunk, lengths_only), []
    for i in range(first // chunk, (end - 1) // chunk + 1):
        a, b = places[i]
        full = min(chunk, size - i * chunk)
        out.append(stored[a:b] if b - a == full else decompress_chunk(kind, stored[a:b], full, chunk))
    skip = first // chunk * chunk
    return b"".join(out)[first - skip : end - skip]


def write_chunked(data: bytes, chunk: int, kind: int = XPRESS_FLAG, lengths_only: bool = False) -> bytes:
    """A compressed resource of ``data``; the inverse of ``read_chunked``."""
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    packed = [c if len(c := compress_chunk(kind, p, chunk)) < len(p) else p for p in parts]
    if lengths_only:
        return struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)
    starts, at = [], 0
    for p in packed[:-1]:
        at += len(p)
        starts.append(at)
    return struct.pack(f"<{len(starts)}{'Q' if len(data) > 0xFFFFFFFF else 'I'}", *starts) + b"".join(packed)
