"""Little-endian records in binary columns: tagged items, UNIX data, reparse points, extended attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import UNIX_DATA_TAG

#: Tags of an object id, of extended attributes and of their old form.
OBJECT_ID_TAG, XATTR_TAG, OLD_XATTR_TAG = 1, 2, 0x337DD874
#: Reparse tags of a symbolic link and a mount point.
SYMLINK, MOUNT_POINT = 0xA000000C, 0xA0000003


def le(data: Column, at: Column | int, n: int) -> Column:
    """Unsigned little-endian number of ``n`` (at most 7) bytes from byte ``at``; null beyond the end."""
    start = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substring(data, (start + 1).cast("int"), F.lit(n)))
    swapped = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.when(F.length(h) == 2 * n, F.conv(swapped, 16, 10).cast("long"))


def tagged_item(extra: Column, tag: int, at_least: int = 0) -> Column:
    """Data of a tagged item in a map; null if it isn't there or too short."""
    found = F.try_element_at(extra, F.lit(tag).cast("long"))
    return F.when(F.octet_length(found) >= at_least, found)


def with_tagged_item(extra: Column, tag: int, data: Column) -> Column:
    """The map with an item replaced."""
    rest = F.map_filter(extra, lambda k, _: k != tag)
    return F.map_concat(rest, F.create_map(F.lit(tag).cast("long"), data))


def unix_data(extra: Column) -> Column:
    """struct<uid, gid, mode, rdev> of an entry, null without any (or with mode 0, which stands for none)."""
    item = tagged_item(extra, UNIX_DATA_TAG, 16)
    names = ("uid", "gid", "mode", "rdev")
    return F.when(le(item, 8, 4) != 0, F.struct(*(le(item, 4 * i, 4).alias(n) for i, n in enumerate(names))))


def unix_bytes(uid: Column, gid: Column, mode: Column, rdev: Column) -> Column:
    """The inverse of ``unix_data``: 16 bytes."""
    word = lambda c: F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), 7 - 2 * i, 2) for i in range(4)))
    return F.unhex(F.concat(*map(word, (uid, gid, mode, rdev))))


def reparse_link(tag: Column, data: Column) -> Column:
    """struct<substitute, print, is_relative> of the data behind a symbolic link's or mount point's reparse header.

    Texts that aren't valid UTF-16 make the action fail; other tags give null.
    """
    symlink = tag == SYMLINK
    base = F.when(symlink, 12).otherwise(8)
    text = lambda offset, size: F.decode(F.substring(data, (base + le(data, offset, 2) + 1).cast("int"), le(data, size, 2).cast("int")), "UTF-16LE")
    return F.when(tag.isin(SYMLINK, MOUNT_POINT), F.struct(text(0, 2).alias("substitute"), text(4, 6).alias("print"), F.coalesce(symlink & (le(data, 8, 4).bitwiseAND(F.lit(1)) != 0), F.lit(False)).alias("is_relative")))


def make_reparse_link(substitute: Column, shown: Column, is_relative: Column) -> Column:
    """Data of a symbolic link: the inverse of ``reparse_link``."""
    half = lambda n: F.unhex(F.concat(F.substring(F.lpad(F.hex(n), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(n), 4, "0"), 1, 2)))
    a, b = F.encode(substitute, "UTF-16LE"), F.encode(shown, "UTF-16LE")
    flags = F.when(is_relative, F.unhex(F.lit("01000000"))).otherwise(F.unhex(F.lit("00000000")))
    return F.concat(half(F.lit(0).cast("long")), half(F.octet_length(a).cast("long")), half(F.octet_length(a).cast("long")), half(F.octet_length(b).cast("long")), flags, a, b)


def xml_escaped(text: Column) -> Column:
    """Text for an XML document; characters that none can hold are dropped."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        clean = F.replace(clean, F.lit(ch), F.lit(name))
    return clean
