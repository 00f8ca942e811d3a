"""Selecting entries: images, subtrees, globs, exclusions, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import excluded, matches_any
from ..functions.paths import ancestors, fold, order_key, parent_path, under


def resolve_images(images: DataFrame, wanted: str) -> DataFrame:
    """Rows of ``images`` (image_index, name) that a text selects: ``all`` or ``*``, a number, or else an exact name.

    A number that is an existing index wins over a name that looks like one.
    """
    if wanted.lower() == "all" or wanted == "*":
        return images
    by_name = images.where((F.col("name") == wanted) & (F.col("name") != ""))
    if not wanted.isdigit() or int(wanted) == 0:
        return by_name
    by_number = images.where(F.col("image_index") == int(wanted))
    return by_number.unionByName(by_name.join(by_number.select(F.lit(1).alias("found")).limit(1), F.col("found") == 1, "left_anti"))


def resolve_each(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """For every text in ``wanted`` (wanted) the image_index it stands for, or null; number before name, least index first."""
    number = F.when(F.col("wanted").rlike("^[1-9][0-9]{0,8}$"), F.col("wanted").cast("int"))
    numbers = images.select(F.col("image_index").alias("by_number"))
    names = images.where("name <> ''").groupBy("name").agg(F.min("image_index").alias("by_name"))
    joined = wanted.withColumn("wanted_number", number).join(numbers, F.col("wanted_number") == F.col("by_number"), "left").join(names, F.col("wanted") == F.col("name"), "left")
    return joined.select("wanted", F.coalesce("by_number", "by_name").alias("image_index"))


def list_subtree(entries: DataFrame, top: str = "/", children_only: bool = False) -> DataFrame:
    """Entries (path) at or below ``top``; with ``children_only`` the direct children without ``top`` itself."""
    path = F.col("path")
    chosen = entries.where(under(path, F.lit(top)))
    return chosen.where((parent_path(path) == top) & (path != top)) if children_only else chosen


def tree_order(path: Column) -> list[Column]:
    """Sort keys for a walk from the top: folded component by component, then exact."""
    return [F.transform(F.split(path, "/"), lambda c: order_key(fold(c))), F.transform(F.split(path, "/"), lambda c: order_key(c))]


def select_globs(entries: DataFrame, patterns: list[str], ignore_case: bool = False) -> DataFrame:
    """Entries that a glob from the root selects; a pattern without a leading separator starts at the root as well."""
    anchored = ["/" + p.strip("/") for p in patterns]
    return entries.where(matches_any(F.col("path"), anchored, ignore_case))


def drop_excluded(entries: DataFrame, exclude: list[str], exceptions: list[str], ignore_case: bool = False) -> DataFrame:
    return entries.where(~excluded(F.col("path"), exclude, exceptions, ignore_case))


def lookup_paths(entries: DataFrame, wanted: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Entries for the paths in ``wanted`` (wanted): the exact one if there is, else one that differs only in case."""
    exact = wanted.join(entries, F.col("wanted") == F.col("path"))
    if not ignore_case:
        return exact
    rest = wanted.join(exact.select("wanted").distinct(), "wanted", "left_anti")
    loose = rest.join(entries, fold("wanted") == fold("path"))
    first = loose.groupBy("wanted").agg(F.min("path").alias("path"))
    return exact.unionByName(first.join(entries, "path").select(*exact.columns))


def case_conflicts(entries: DataFrame) -> DataFrame:
    """Names that meet another one in their directory (parent, name) when case is ignored; n_alike counts them."""
    keyed = entries.select("*", fold("name").alias("folded"))
    several = keyed.select("parent", "folded", "name").distinct().groupBy("parent", "folded").agg(F.count(F.lit(1)).alias("n_alike")).where("n_alike > 1")
    return keyed.join(several, ["parent", "folded"]).drop("folded")


def fill_ancestors(paths: DataFrame) -> DataFrame:
    """The paths and all their ancestors, each once: path, is_added."""
    own = paths.select("path").distinct()
    every = own.select(F.explode(ancestors("path")).alias("path")).unionByName(own).distinct()
    return every.join(own.withColumn("given", F.lit(True)), "path", "left").select("path", F.col("given").isNull().alias("is_added"))


def topmost(paths: DataFrame) -> DataFrame:
    """Selected paths that lie under no other selected path."""
    own = paths.select("path").distinct()
    above = own.select("path", F.explode(ancestors("path")).alias("above"))
    return own.join(above.join(own.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct(), "path", "left_anti")


def first_by_path(entries: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of entries with the same path the first in scan order stays."""
    first = entries.groupBy("path").agg(F.min(ordinal).alias("first_ordinal"))
    return entries.join(first, "path").where(F.col(ordinal) == F.col("first_ordinal")).drop("first_ordinal")


def materialise_paths(nodes: DataFrame, most_depth: int = 16384) -> DataFrame:
    """Full paths and depths of a tree given as id, parent_id (null: top), name; a cycle or a lost parent gives no row.

    Every round doubles the stretch of ancestors that each node's path covers, so that there are as many rounds as the
    depth has bits. A deeper tree than ``most_depth`` is an error.
    """
    from ..plans.durable import materialise

    now = materialise(nodes.select("id", F.col("parent_id").alias("above"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")), "paths")
    for _ in range(most_depth.bit_length() + 1):
        open_ = now.where("above is not null")
        if open_.isEmpty():
            break
        upper = now.select(F.col("id").alias("u_id"), F.col("above").alias("u_above"), F.col("path").alias("u_path"), F.col("depth").alias("u_depth"))
        joined = open_.join(upper, F.col("above") == F.col("u_id")).select("id", F.col("u_above").alias("above"), F.concat("u_path", "path").alias("path"), (F.col("depth") + F.col("u_depth")).alias("depth"))
        now = materialise(now.where("above is null").unionByName(joined.where(F.col("above").isNull() | (F.col("depth") <= 2 * most_depth))), "paths")
    whole = now.where("above is null").drop("above")
    if not whole.where(F.col("depth") > most_depth).isEmpty():
        raise ValueError("the tree is deeper than allowed")
    return whole


def system_roots(paths: DataFrame, marks: list[str], default: str = "windows") -> DataFrame:
    """Per image the top-level directory with most of the marked descendants (image, root, score).

    Marks are relative paths, compared without regard to case. The default name wins ties, then the first in order.
    """
    parts = F.split(F.col("path"), "/")
    top = F.element_at(parts, 2)
    inner = fold(F.array_join(F.slice(parts, 3, 1 << 20), "/"))
    scored = paths.select("image", top.alias("root"), *(F.coalesce(inner == m.upper(), F.lit(False)).cast("int").alias(f"m{i}") for i, m in enumerate(marks))).groupBy("image", "root")
    scored = scored.agg(*(F.max(f"m{i}").alias(f"m{i}") for i in range(len(marks))))
    score = sum((F.col(f"m{i}") for i in range(1, len(marks))), F.col("m0"))
    return best_of(scored.select("image", "root", score.alias("score")), "image", "root", "score", default)


def best_of(scored: DataFrame, group: str, name: str, score: str, default: str | None = None) -> DataFrame:
    """The best-scored row of each group; the default name wins ties, then names in folded order."""
    best = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(name).eqNullSafe(F.lit(default)).desc(), order_key(fold(name)), order_key(name))
    return scored.where(F.col(score) > 0).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


