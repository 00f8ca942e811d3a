"""LZX in the form that imaging archives use: one chunk in, one chunk out, every chunk by itself.

The public description of the format is that of delta compression by LZX. A chunk is a row of blocks, verbatim, with
aligned offsets, or uncompressed, over 16-bit words read from the upper bit. The window is as large as a chunk may be, the
three latest offsets and the code lengths start anew with each chunk, and call instructions of programs are always
translated, with a fixed size of the whole.
"""

from __future__ import annotations

import struct

from .codecs import BadData, code_lengths, codes_of

#: Block types, slots by the order of the window, symbols, code sizes, and the size that calls are translated by.
VERBATIM, ALIGNED, UNCOMPRESSED = 1, 2, 3
SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}
LITERALS, LENGTH_CODES, PRE_CODES, ALIGNED_CODES, LONGEST_CODE, LEAST_MATCH = 256, 249, 20, 8, 16, 2
DEFAULT_BLOCK, PROGRAM_SIZE, TRANSLATED_END = 32768, 12_000_000, 10

FOOTER_BITS = [0 if slot < 4 else min(17, slot // 2 - 1) for slot in range(50)]
BASES = [sum(1 << n for n in FOOTER_BITS[:slot]) for slot in range(50)]


def window_order(chunk: int) -> int:
    """The window's order: the least, 15 at least, that holds a chunk."""
    order = max(15, (chunk - 1).bit_length())
    if order not in SLOTS:
        raise BadData("no such window")
    return order


class _Bits:
    """Bits of 16-bit little-endian words, the upper ones first; zeroes beyond the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held = (self.held << 16) | int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at += 2
            self.n += 16
            if self.at > len(self.data) + 64:
                raise BadData("the chunk ends early")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, table: _Table) -> int:
        self.need(table.bits)
        found = table.found[self.held >> self.n - table.bits]
        if found is None:
            raise BadData("no such code")
        self.n -= found[1]
        self.held &= (1 << self.n) - 1
        return found[0]

    def align(self) -> None:
        """To the next word; one that is just begun is skipped too."""
        self.at -= 2 * (self.n // 16)
        if self.n % 16 == 0:
            self.at += 2
        self.held = self.n = 0

    def raw(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise BadData("the chunk ends early")
        self.at += n
        return part


class _Table:
    """Symbols by the next bits of the data."""

    def __init__(self, lengths: list[int]):
        self.bits = max(lengths, default=0) or 1
        self.found: list[tuple[int, int] | None] = [None] * (1 << self.bits)
        for symbol, (code, bits) in codes_of(lengths).items():
            first = code << self.bits - bits
            self.found[first : first + (1 << self.bits - bits)] = [(symbol, bits)] * (1 << self.bits - bits)


def _read_lengths(bits: _Bits, lengths: list[int], first: int, end: int) -> None:
    """Reads code lengths, which are told as differences to those of the block before, and in runs."""
    pre = _Table([bits.take(4) for _ in range(PRE_CODES)])
    at = first
    while at < end:
        symbol = bits.symbol(pre)
        if symbol < 17:
            run, value = 1, (lengths[at] - symbol) % 17
        elif symbol == 17:
            run, value = 4 + bits.take(4), 0
        elif symbol == 18:
            run, value = 20 + bits.take(5), 0
        else:
            run = 4 + bits.take(1)
            symbol = bits.symbol(pre)
            if symbol > 16:
                raise BadData("bad code length")
            value = (lengths[at] - symbol) % 17
        stop = min(end, at + run)
        lengths[at:stop] = [value] * (stop - at)
        at = stop


def decompress(data: bytes, size: int, chunk: int = DEFAULT_BLOCK) -> bytes:
    """The ``size`` bytes that a compressed chunk stands for; ``chunk`` is the archive's chunk size."""
    order = window_order(chunk)
    bits, out = _Bits(data), bytearray()
    main, length_codes = [0] * (LITERALS + 8 * SLOTS[order]), [0] * LENGTH_CODES
    latest = [1, 1, 1]
    while len(out) < size:
        kind = bits.take(3)
        block = DEFAULT_BLOCK if bits.take(1) else bits.take(16) if order < 16 else bits.take(24)
        if not block or len(out) + block > size:
            raise BadData("bad block size")
        if kind == UNCOMPRESSED:
            bits.align()
            latest = list(struct.unpack("<III", bits.raw(12)))
            out += bits.raw(block)
            if block % 2:
                bits.at += 1
            continue
        if kind not in (VERBATIM, ALIGNED):
            raise BadData("no such block")
        aligned = _Table([bits.take(3) for _ in range(ALIGNED_CODES)]) if kind == ALIGNED else None
        _read_lengths(bits, main, 0, LITERALS)
        _read_lengths(bits, main, LITERALS, len(main))
        _read_lengths(bits, length_codes, 0, LENGTH_CODES)
        symbols, lengths = _Table(main), _Table(length_codes)
        end = len(out) + block
        while len(out) < end:
            symbol = bits.symbol(symbols)
            if symbol < LITERALS:
                out.append(symbol)
                continue
            slot, length = (symbol - LITERALS) >> 3, (symbol - LITERALS) & 7
            if length == 7:
                length += bits.symbol(lengths)
            length += LEAST_MATCH
            if slot < 3:
                offset = latest[slot]
                latest[slot], latest[0] = latest[0], offset
            else:
                n = FOOTER_BITS[slot]
                if aligned and n >= 3:
                    footer = bits.take(n - 3) << 3
                    footer |= bits.symbol(aligned)
                else:
                    footer = bits.take(n)
                offset = BASES[slot] + footer - 2
                latest = [offset, latest[0], latest[1]]
            if not 0 < offset <= len(out) or len(out) + length > end:
                raise BadData("a match leads outside the block")
            start = len(out) - offset
            while length > 0:
                part = out[start : start + length]
                out += part
                length -= len(part)
                start += len(part)
    return bytes(translate_calls(out, back=True))


def translate_calls(data: bytes | bytearray, back: bool = False) -> bytearray:
    """Targets of call instructions from relative to absolute, or ``back``."""
    out, at = bytearray(data), 0
    end = len(out) - TRANSLATED_END
    while 0 <= (at := out.find(0xE8, at)) < end:
        value = struct.unpack_from("<i", out, at + 1)[0]
        if back:
            if -at <= value < PROGRAM_SIZE:
                struct.pack_into("<i", out, at + 1, value - at if value >= 0 else value + PROGRAM_SIZE)
        elif -at <= value < PROGRAM_SIZE:
            struct.pack_into("<i", out, at + 1, value + at if value < PROGRAM_SIZE - at else value - PROGRAM_SIZE)
        at += 5
    return out


# --- writing


class _Writer:
    def __init__(self) -> None:
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.held, self.n = self.held << n | value, self.n + n
        while self.n >= 16:
            self.n -= 16
            self.out += struct.pack("<H", self.held >> self.n)
            self.held &= (1 << self.n) - 1

    def align(self) -> None:
        self.put(0, 16 - self.n)


def _put_lengths(bits: _Writer, lengths: list[int], before: list[int]) -> None:
    """Writes code lengths as differences, without runs."""
    symbols = [(old - new) % 17 for old, new in zip(before, lengths, strict=True)]
    counts = {s: symbols.count(s) for s in set(symbols)}
    pre = code_lengths(counts, PRE_CODES)
    for n in pre:
        bits.put(n, 4)
    codes = codes_of(pre)
    for s in symbols:
        bits.put(*codes[s])


def compress(data: bytes, chunk: int = DEFAULT_BLOCK, kind: int = VERBATIM) -> bytes:
    """A chunk of one block that ``decompress`` turns into ``data``; simple rather than small."""
    order, bits, plain = window_order(chunk), _Writer(), data
    bits.put(kind, 3)
    bits.put(*((1, 1) if len(data) == DEFAULT_BLOCK else (len(data), 17 if order < 16 else 25)))
    if kind == UNCOMPRESSED:
        bits.align()
        return bytes(bits.out) + struct.pack("<III", 1, 1, 1) + bytes(translate_calls(plain)) + bytes(len(plain) % 2)
    items, latest = [], [1, 1, 1]
    for length, x in _items(bytes(translate_calls(plain))):
        if not length:
            items.append((x, None, 0, 0))
            continue
        if x in latest:
            slot, footer = latest.index(x), 0
            latest[slot], latest[0] = latest[0], x
        else:
            slot = max(s for s in range(3, SLOTS[order]) if BASES[s] <= x + 2)
            footer, latest = x + 2 - BASES[slot], [x, latest[0], latest[1]]
        head = min(7, length - LEAST_MATCH)
        items.append((LITERALS + 8 * slot + head, length - LEAST_MATCH - 7 if head == 7 else None, FOOTER_BITS[slot], footer))
    count = lambda symbols: {s: symbols.count(s) for s in set(symbols)}
    n_main = LITERALS + 8 * SLOTS[order]
    main = code_lengths(count([i[0] for i in items]), n_main)
    lengths = code_lengths(count([i[1] for i in items if i[1] is not None]), LENGTH_CODES)
    low = code_lengths(count([i[3] & 7 for i in items if i[2] >= 3]), ALIGNED_CODES, 7)
    if kind == ALIGNED:
        for n in low:
            bits.put(n, 3)
    _put_lengths(bits, main[:LITERALS], [0] * LITERALS)
    _put_lengths(bits, main[LITERALS:], [0] * (n_main - LITERALS))
    _put_lengths(bits, lengths, [0] * LENGTH_CODES)
    codes, length_codes, low_codes = codes_of(main), codes_of(lengths), codes_of(low)
    for symbol, length, n, footer in items:
        bits.put(*codes[symbol])
        if length is not None:
            bits.put(*length_codes[length])
        if kind == ALIGNED and n >= 3:
            bits.put(footer >> 3, n - 3)
            bits.put(*low_codes[footer & 7])
        elif n:
            bits.put(footer, n)
    bits.put(0, -bits.n % 16)
    return bytes(bits.out)


def _items(data: bytes) -> list[tuple[int, int]]:
    """Literals (0, byte) and matches (length, offset), each the latest place of its three bytes."""
    out, places, i = [], {}, 0
    while i < len(data):
        j, n = places.get(data[i : i + 3], -1), 0
        if j >= 0 and i + 3 <= len(data):
            n = 3
            while i + n < len(data) and n < 257 and data[j + n] == data[i + n]:
                n += 1
        out.append((n, i - j) if n else (0, data[i]))
        for k in range(i, i + max(1, n)):
            places[data[k : k + 3]] = k
        i += max(1, n)
    return out
