"""Glob patterns over paths: ``*`` and ``?`` stay within a component."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ancestors, basename


def glob_regex(pattern: str, ignore_case: bool = False) -> str:
    """Regular expression for one pattern, without anchors."""
    body = "".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in pattern)
    return f"(?i:{body})" if ignore_case else body


def path_matches(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    """A pattern with a leading separator matches whole paths, any other one last components."""
    regex = f"^{glob_regex(pattern, ignore_case)}$"
    return path.rlike(regex) if pattern.startswith("/") else basename(path).rlike(regex)


def matches_any(path: Column, patterns: list[str], ignore_case: bool = False, below: bool = False, above: bool = False) -> Column:
    """Whether any pattern matches; with ``below`` also what is under a match, with ``above`` also its ancestors.

    Anchored patterns are joined to one expression, those for last components to another.
    """
    if not patterns:
        return F.lit(False)
    anchored = [glob_regex(p, ignore_case) for p in patterns if p.startswith("/")]
    names = [glob_regex(p, ignore_case) for p in patterns if not p.startswith("/")]
    tests = []
    if anchored:
        tests.append(path.rlike(f"^(?:{'|'.join(anchored)}){'(?:/.*)?' if below else ''}$"))
    if names:
        one = f"^.*/(?:{'|'.join(names)}){'(?:/.*)?' if below else ''}$"
        tests.append(path.rlike(one))
    if above:
        heads = ["/".join(glob_regex(p, ignore_case) for p in parts[: k + 1]) for q in patterns if q.startswith("/") for parts in [q.split("/")] for k in range(1, len(parts) - 1)]
        if heads:
            tests.append(path.rlike(f"^(?:{'|'.join(heads)})$"))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def excluded(path: Column, exclude: list[str], exceptions: list[str], ignore_case: bool = False) -> Column:
    """Whether a scan leaves ``path`` out: it or one of its ancestors is excluded and not excepted.

    Ancestors count since a scan doesn't descend into an excluded directory; an ancestor of an exception is entered.
    """
    one = lambda p: matches_any(p, exclude, ignore_case, below=True) & ~matches_any(p, exceptions, ignore_case, below=True, above=True)
    return F.exists(ancestors(path, own=True), one)
