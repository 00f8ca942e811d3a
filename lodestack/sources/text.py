"""Text lists: sections with comments, source lists, update commands."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decode_text(raw: bytes) -> str:
    """UTF-16LE with a mark or by its zero bytes, else UTF-8 with or without a mark."""
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le")
    if len(raw) % 2 == 0 and len(raw) >= 2 and raw[1::2].count(0) > len(raw) // 4 > raw[0::2].count(0):
        return raw.decode("utf-16-le")
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines of section files: file, line_no, section (null before the first), line. Comments and blanks are left out.

    A file is one short list; its lines are numbered within the file's single row.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).select("file", "line_no", F.trim("line").alias("line"))
    named = lines.withColumn("section", F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = named.withColumn("in_section", F.last("section", ignorenulls=True).over(w))
    kept = filled.where("section is null and line <> '' and not startswith(line, ';') and not startswith(line, '#')")
    return kept.select("file", "line_no", F.col("in_section").alias("section"), F.regexp_replace("line", "^([\"'])(.*)\\1$", "$2").alias("line"))


def tokens(line: str) -> list[str]:
    """Words of a command line, quoted ones whole; none for a comment."""
    split = shlex.shlex(line.strip(), posix=True)
    split.whitespace_split, split.commenters, split.escape = True, "", ""
    return [] if line.strip().startswith("#") else list(split)


def source_list(text: str) -> list[tuple[str, str]]:
    """Lines ``source [target]`` as pairs; a lone source is its own target."""
    out = []
    for line in text.splitlines():
        if not (words := tokens(line)):
            continue
        if len(words) > 2:
            raise ValueError(f"a source and a target are expected: {line!r}")
        out.append((words[0], words[-1]))
    return out


def update_commands(text: str) -> list[dict]:
    """Lines ``add source target``, ``delete path``, ``rename old new``, each with --options, as commands."""
    arity = {"add": ("source", "at"), "delete": ("path",), "rename": ("old", "new")}
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if not (words := tokens(line)):
            continue
        op, options = words[0].lower(), [w[2:].replace("-", "_") for w in words[1:] if w.startswith("--")]
        rest = [w for w in words[1:] if not w.startswith("--")]
        if op not in arity or len(rest) != len(arity[op]):
            raise ValueError(f"line {number}: {line!r}")
        out.append({"op": op, **dict(zip(arity[op], rest, strict=True)), **dict.fromkeys(options, True)})
    return out
