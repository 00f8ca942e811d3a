"""Paths and names inside an archive. Separators are ``/`` and, on input, the backslash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_path(path: Cols) -> Column:
    """Separators become ``/``, runs of them one, a leading one is added, trailing ones go. Null and empty: the root."""
    joined = F.concat(F.lit("/"), F.regexp_replace(F.coalesce(_c(path), F.lit("")), r"[/\\]+", "/"))
    trimmed = F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "/$", "")
    return F.when(trimmed == "", "/").otherwise(trimmed)


def basename(path: Cols) -> Column:
    """Last component, trailing separators ignored."""
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def stream_suffix(path: Cols) -> Column:
    """What follows the first colon of the last component; null if nothing does."""
    found = F.regexp_extract(basename(path), r"^[^:]*:(.+)$", 1)
    return F.when(found != "", found)


def parent_path(path: Cols) -> Column:
    cut = F.regexp_replace(_c(path), "/+[^/]*/*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def depth(path: Cols) -> Column:
    """Number of ancestors of a canonical path; 0 for the root."""
    p = _c(path)
    return F.when(p == "/", 0).otherwise(F.size(F.split(p, "/")) - 1)


def extension(name: Cols) -> Column:
    """Text after the last dot of the last component; null without a dot, empty after a final one."""
    base = basename(name)
    return F.when(base.contains("."), F.substring_index(base, ".", -1))


def ancestors(path: Cols, own: bool = False) -> Column:
    """Paths of all proper ancestors but the root, from the top; with ``own`` the path itself as well."""
    parts = F.split(F.substring(_c(path), F.lit(2), F.length(_c(path))), "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def under(path: Cols, top: Cols) -> Column:
    """Whether ``path`` is ``top`` or below it."""
    p, t = _c(path), _c(top)
    return (t == "/") | (p == t) | p.startswith(F.concat(t, F.lit("/")))


def fold(name: Cols) -> Column:
    """Key for comparison without regard to case: every 16-bit character as its capital, if that is one such character."""
    n = _c(name)
    plain = F.translate(n, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    single = lambda c: F.octet_length(F.encode(c, "UTF-16BE")) == 2
    each = F.transform(F.split(n, ""), lambda c: F.when(single(c) & single(F.upper(c)), F.upper(c)).otherwise(c))
    return F.when(n.rlike("[^\\x00-\\x7F]"), F.array_join(each, "")).otherwise(plain)


def order_key(name: Cols) -> Column:
    """Orders by 16-bit code units."""
    return F.encode(_c(name), "UTF-16BE")


def valid_name(name: Cols) -> Column:
    """Not empty, not ``.`` or ``..``, without NUL or separator."""
    n = _c(name)
    return n.isNotNull() & (n != "") & ~n.isin(".", "..") & ~n.rlike(r"[/\x00]")


def fixed_name(name: Cols, number: Cols, replacement: str = "_") -> Column:
    """A name that can be made on disk: bad characters replaced, and a numbered suffix where any was."""
    n = _c(name)
    return F.when(n.rlike(r"[/\x00]"), F.concat(F.regexp_replace(n, r"[/\x00]", replacement), F.lit(" (invalid filename #"), _c(number).cast("string"), F.lit(")"))).otherwise(n)


def image_directory(name: Cols, index: Cols) -> Column:
    """Directory for an image: its name if that can be one and has at most 128 characters, else its number."""
    n = _c(name)
    good = valid_name(n) & ~n.contains("\\") & (F.length(n) <= 128)
    return F.when(good, n).otherwise(_c(index).cast("string"))


def link_target(target: Cols, prefix: Cols | None = None) -> Column:
    """Symbolic-link target as a path: the device prefix goes, the separators are swapped; absolute ones get ``prefix``."""
    t = F.regexp_replace(_c(target), r"^\\\?\?\\(?:[A-Za-z]:)?", "")
    swapped = F.translate(t, "\\/", "/\\")
    out = F.when(swapped == "", "/").otherwise(swapped)
    return out if prefix is None else F.when(out.startswith("/"), F.concat(_c(prefix), out)).otherwise(out)
