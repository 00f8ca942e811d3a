"""Registry hives as tables: keys and values of a binary file, for facts about an installed system."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Where the cells begin, value types, and the most levels that are followed.
FIRST_CELL, TEXT_TYPES, NUMBER_TYPES, MOST_DEPTH = 4096, (1, 2), {4: "<I", 11: "<Q"}, 64
SCHEMA = "key string, value_name string, value_type long, text string, number long, data binary"


class BadHive(ValueError):
    pass


class Hive:
    """Read access to a hive. Offsets that lead outside it are errors, never reads beyond its end."""

    def __init__(self, data: bytes):
        if data[:4] != b"regf" or len(data) < FIRST_CELL + 32:
            raise BadHive("not a hive")
        self.data = data
        self.root = struct.unpack_from("<I", data, 36)[0]

    def cell(self, offset: int) -> bytes:
        at = FIRST_CELL + offset
        if offset == 0xFFFFFFFF or at + 4 > len(self.data):
            raise BadHive("a cell lies outside the hive")
        size = abs(struct.unpack_from("<i", self.data, at)[0])
        if size < 4 or at + size > len(self.data):
            raise BadHive("bad cell size")
        return self.data[at + 4 : at + size]

    def key(self, offset: int) -> dict:
        raw = self.cell(offset)
        if raw[:2] != b"nk" or len(raw) < 76:
            raise BadHive("a key is expected")
        flags, = struct.unpack_from("<H", raw, 2)
        n_sub, = struct.unpack_from("<I", raw, 20)
        subkeys, = struct.unpack_from("<I", raw, 28)
        n_values, values = struct.unpack_from("<II", raw, 36)
        n_name, = struct.unpack_from("<H", raw, 72)
        name = raw[76 : 76 + n_name].decode("latin-1" if flags & 0x20 else "utf-16-le", "replace")
        return {"name": name, "subkeys": subkeys if n_sub else None, "values": values if n_values else None, "n_values": n_values}

    def children(self, offset: int, depth: int = 0) -> Iterator[int]:
        raw = self.cell(offset)
        kind, n = raw[:2], struct.unpack_from("<H", raw, 2)[0]
        step = {b"lf": 8, b"lh": 8, b"li": 4, b"ri": 4}.get(kind)
        if step is None or 4 + step * n > len(raw) or depth > 8:
            raise BadHive("bad list of keys")
        for i in range(n):
            at = struct.unpack_from("<I", raw, 4 + step * i)[0]
            if kind == b"ri":
                yield from self.children(at, depth + 1)
            else:
                yield at

    def values(self, key: dict) -> Iterator[tuple[str, int, bytes]]:
        if key["values"] is None:
            return
        table = self.cell(key["values"])
        for i in range(key["n_values"]):
            raw = self.cell(struct.unpack_from("<I", table, 4 * i)[0])
            if raw[:2] != b"vk" or len(raw) < 20:
                raise BadHive("a value is expected")
            n_name, size, at, kind, flags = struct.unpack_from("<HIIIH", raw, 2)
            name = raw[20 : 20 + n_name].decode("latin-1" if flags & 1 else "utf-16-le", "replace")
            data = raw[8:12][: size & 0x7FFFFFFF] if size >> 31 else self.cell(at)[:size]
            yield name, kind, data

    def walk(self) -> Iterator[tuple]:
        stack = [(self.root, "", 0)]
        while stack:
            offset, above, depth = stack.pop()
            key = self.key(offset)
            path = f"{above}\\{key['name']}" if depth else ""
            yield (path, None, None, None, None, None)
            for name, kind, data in self.values(key):
                text = data.decode("utf-16-le", "replace").split("\0")[0] if kind in TEXT_TYPES else None
                number = struct.unpack(NUMBER_TYPES[kind], data)[0] if kind in NUMBER_TYPES and len(data) == struct.calcsize(NUMBER_TYPES[kind]) else None
                yield (path, name, kind, text, number, data)
            if key["subkeys"] is not None and depth < MOST_DEPTH:
                stack += [(c, path, depth + 1) for c in reversed(list(self.children(key["subkeys"])))]


def read_hives(files: DataFrame) -> DataFrame:
    """Keys (a row without value) and values of hives given as rows (path, content): file, then the columns of SCHEMA."""
    names = ["file", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                frame = pd.DataFrame([(name, *r) for r in Hive(content).walk()], columns=names)
                yield frame.astype({"value_type": "Int64", "number": "Int64"})

    return files.select("path", "content").mapInPandas(run, f"file string, {SCHEMA}")
