"""Trees of a mounted UNIX file system: links, modes, owners, times to 100 ns, extended attributes, empty directories.

The folder must be mounted alike on all machines; for other stores see ``tree``. Directories are listed level by level, each
level's over all tasks, so that no single process walks the whole.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import excluded
from ..functions.values import ATTRIBUTES, EPOCH_SECONDS
from ..plans.durable import materialise
from .tree import relative_target

KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "directory", stat.S_IFLNK: "symlink", stat.S_IFIFO: "fifo", stat.S_IFSOCK: "socket", stat.S_IFCHR: "device", stat.S_IFBLK: "device"}
NODES = "path string, kind string, mode long, uid long, gid long, rdev long, size long, written long, accessed long, device long, number long, nlink long, target string, xattrs map<string,binary>"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]
#: Directories that one task lists.
PER_TASK = 256


def _ticks(nanoseconds: int) -> int:
    return nanoseconds // 100 + EPOCH_SECONDS * 10_000_000


def _node(root: str, path: str, with_xattrs: bool) -> tuple:
    """One entry as it is, links not followed."""
    full = os.path.join(root, path.lstrip("/"))
    s = os.lstat(full)
    kind = KINDS.get(stat.S_IFMT(s.st_mode), "other")
    target = relative_target(os.readlink(full), path, root) if kind == "symlink" else None
    xattrs = {}
    if with_xattrs:
        try:
            xattrs = {n: os.getxattr(full, n, follow_symlinks=False) for n in os.listxattr(full, follow_symlinks=False)}
        except OSError:  # the file system has none
            xattrs = {}
    return path, kind, s.st_mode, s.st_uid, s.st_gid, s.st_rdev, s.st_size if kind == "file" else 0, _ticks(s.st_mtime_ns), _ticks(s.st_atime_ns), s.st_dev, s.st_ino, s.st_nlink, target, xattrs


def list_unix(spark: SparkSession, root: str, with_xattrs: bool = True, same_device: bool = False) -> DataFrame:
    """All entries below ``root``, itself as ``/``: see ``NODES``. Sockets are left out. With ``same_device`` mounts of other file
    systems are listed, but not entered."""
    root = os.path.abspath(root)
    own_device = os.lstat(root).st_dev

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                names = sorted(os.listdir(os.path.join(root, path.lstrip("/"))))
                rows = [_node(root, f"{path.rstrip('/')}/{n}", with_xattrs) for n in names]
                yield pd.DataFrame([r for r in rows if r[1] != "socket"], columns=COLUMNS)

    first = spark.createDataFrame([_node(root, "/", with_xattrs)], NODES)
    levels = [materialise(first, "unix")]
    while True:
        open_ = levels[-1].where("kind = 'directory'")
        open_ = open_.where(F.col("device") == own_device) if same_device else open_
        n = open_.count()
        if not n:
            break
        levels.append(materialise(open_.select("path").repartition(-(-n // PER_TASK)).mapInPandas(children, NODES), "unix"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scan_unix(spark: SparkSession, root: str, exclude: list[str] | None = None, exceptions: list[str] | None = None, with_xattrs: bool = True) -> DataFrame:
    """Entries for an image: what ``list_unix`` gives, is_directory, attributes, link_id (the inode's number where it has several
    names, else 0), and hash and content of files; what the exclusion list leaves out isn't read."""
    root = os.path.abspath(root)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(os.path.join(root, path.lstrip("/")), "rb") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    nodes = list_unix(spark, root, with_xattrs).where(~excluded(F.col("path"), exclude or [], exceptions or []))
    read = nodes.where("kind = 'file' and size > 0").select("path").mapInPandas(contents, "path string, content binary")
    bit = F.when(F.col("kind") == "directory", ATTRIBUTES["directory"]).when(F.col("kind") == "symlink", ATTRIBUTES["reparse_point"]).otherwise(ATTRIBUTES["normal"])
    link = F.when((F.col("nlink") > 1) & (F.col("kind") != "directory"), F.col("number")).otherwise(0)
    joined = nodes.join(read, "path", "left")
    return joined.select(*COLUMNS, (F.col("kind") == "directory").alias("is_directory"), bit.cast("long").alias("attributes"), link.alias("link_id"), F.when(F.col("content").isNotNull(), F.sha1("content")).alias("hash"), "content")


def write_unix(entries: DataFrame, root: str, with_owner: bool = False) -> None:
    """Makes entries (see ``scan_unix``) below ``root``: directories, files, links, then modes and times, those of directories last.

    Files are written under another name and renamed, links are replaced, so that a task that runs again does no harm.
    Names of one inode become hard links to the first of them. Owners need the right to set them.
    """
    at = lambda path: os.path.join(root, path.lstrip("/"))

    def facts(r, full: str) -> None:
        link = r["kind"] == "symlink"
        if with_owner:
            os.chown(full, r["uid"], r["gid"], follow_symlinks=False)
        if not link:
            os.chmod(full, stat.S_IMODE(r["mode"]))
        for name, value in (r["xattrs"] or {}).items():
            os.setxattr(full, name, bytes(value), follow_symlinks=False)
        back = lambda ticks: (ticks - EPOCH_SECONDS * 10_000_000) * 100
        os.utime(full, ns=(back(r["accessed"]), back(r["written"])), follow_symlinks=False)

    def directories(rows) -> None:
        for r in rows:
            os.makedirs(at(r["path"]), exist_ok=True)

    def files(rows) -> None:
        for r in rows:
            full = at(r["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.part{os.getpid()}"
            if r["kind"] == "symlink":
                os.symlink(r["target"], part)
            elif r["kind"] == "fifo":
                os.mkfifo(part)
            else:
                with open(part, "wb") as f:
                    f.write(bytes(r["content"] or b""))
            facts(r, part)
            os.replace(part, full)

    def links(rows) -> None:
        for r in rows:
            full, part = at(r["path"]), f"{at(r['path'])}.part{os.getpid()}"
            os.link(at(r["first"]), part, follow_symlinks=False)
            os.replace(part, full)

    def directory_facts(rows) -> None:
        for r in rows:
            facts(r, at(r["path"]))

    entries.where("is_directory").select("path").foreachPartition(directories)
    linked = entries.where("link_id > 0").groupBy("device", "link_id").agg(F.min("path").alias("first"))
    named = entries.where("not is_directory").join(linked, ["device", "link_id"], "left")
    named.where("first is null or first = path").foreachPartition(files)
    named.where("first <> path").select("path", "first").foreachPartition(links)
    entries.where("is_directory").drop("content").foreachPartition(directory_facts)
