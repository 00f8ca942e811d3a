"""Registered queries: each applies an operator to the driver's tables, beside SQL that gives the same rows.

Documents stand for files (image = language, path = /source/id.txt, content = text), pages for a tree of paths, orders
and line items for resources and extents, nations for images, conversations for inodes with several streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs, paths, values
from ..operators import combine, dedup, layout, select, verify
from .durable import global_rank

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: image, source, path, hash, size, id."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("image"), "source", path.alias("path"), F.sha1(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))


_FILES = "(SELECT doc_id AS id, lang AS image, source, '/' || source || '/' || doc_id || '.txt' AS path, sha1(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)"
_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+:/', '')"
_PAGES = f"(SELECT page_id, CASE WHEN {_PATH} LIKE '%/' THEN left({_PATH}, length({_PATH}) - 1) ELSE {_PATH} END AS path FROM pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as paths: page_id, path (/host/directories)."""
    plain = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+:/", "")
    return _table(spark, sf_dir, "pages").select("page_id", paths.canonical_path(plain).alias("path"))


@_query(f"""
    WITH f AS {_FILES}, i AS (SELECT image, hash, max(size) AS size, count(*) AS nlink FROM f GROUP BY image, hash)
    SELECT image, dir_count, sum(nlink)::BIGINT AS file_count, sum(size * nlink)::BIGINT AS total_bytes, sum(size * (nlink - 1))::BIGINT AS hard_link_bytes
    FROM i JOIN (SELECT image, count(DISTINCT source) AS dir_count FROM f GROUP BY image) USING (image) GROUP BY image, dir_count""")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return dedup.image_stats(dedup.link_groups(files, ["image", "hash"]), files.select("image", F.col("source").alias("path")))


@_query(f"SELECT hash, min(size) AS size, count(*) AS refcnt, min(size) <> max(size) AS is_collision FROM {_FILES} GROUP BY hash")
def dedup_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_blobs(_files(spark, sf_dir))


@_query(f"""
    SELECT source, sum(t)::BIGINT AS total_bytes, sum(s)::BIGINT AS stored_bytes, sum(t - s)::BIGINT AS saved_bytes
    FROM (SELECT source, hash, sum(size) AS t, max(size) AS s FROM {_FILES} GROUP BY source, hash) GROUP BY source""")
def dup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.savings(_files(spark, sf_dir), "source")


@_query("SELECT doc_id, n_chars AS size, count(*) OVER (PARTITION BY n_chars) = 1 AS is_unique_size FROM documents")
def unique_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_sizes(_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size")))


@_query("SELECT doc_id AS id, sha1(coalesce(text, '')) AS hash FROM documents WHERE sha1(coalesce(text, '')) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)")
def missing_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return dedup.missing(files.select("id", "hash"), files.where("id % 3 = 0")).select("id", "hash")


@_query(f"""
    WITH f AS {_FILES}, d AS (SELECT DISTINCT hash, size FROM f WHERE image = 'en'), s AS (SELECT DISTINCT hash, size FROM f WHERE image IN ('de', 'fr', 'es'))
    SELECT hash, size, false AS is_external FROM d UNION ALL SELECT hash, size, true FROM s WHERE hash NOT IN (SELECT hash FROM d)""")
def reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    part = lambda lang: files.where(F.col("image") == lang).select("hash", "size").distinct()
    return combine.reference(part("en"), [part("de"), part("fr"), part("es")])


@_query(f"""
    WITH f AS {_FILES}, d AS (SELECT hash, min(size) AS size, count(*) AS refcnt FROM f WHERE source <> 'src0' GROUP BY hash),
    n AS (SELECT hash, min(size) AS size, count(*) AS refs FROM f WHERE source = 'src0' GROUP BY hash)
    SELECT hash, coalesce(d.size, n.size) AS size, coalesce(refcnt, 0) + coalesce(refs, 0) AS refcnt, refcnt IS NULL AS is_added FROM d FULL JOIN n USING (hash)""")
def export_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    dest = dedup.dedup_blobs(files.where("source <> 'src0'")).select("hash", "size", "refcnt")
    return combine.export_image(files.where("source = 'src0'").withColumn("nlink", F.lit(1)), dest)


@_query(f"""
    WITH b AS (SELECT hash, count(*) AS refcnt FROM {_FILES} GROUP BY hash), c AS (SELECT hash, count(*) * -2 AS delta FROM {_FILES} WHERE id % 2 = 0 GROUP BY hash)
    SELECT hash, greatest(refcnt + coalesce(delta, 0), 0)::BIGINT AS refcnt FROM b LEFT JOIN c USING (hash)""")
def refcount_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return dedup.adjust_refcounts(dedup.dedup_blobs(files).select("hash", "refcnt"), files.where("id % 2 = 0").select("hash", F.lit(-2).alias("delta")))


@_query("""
    WITH s AS (SELECT conv_id, turn, role, length(text) AS size, sha1(text) AS hash FROM conversations),
    n AS (SELECT conv_id AS path, turn AS stream_type, role AS stream_name, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN size + 1 ELSE size END AS size FROM s WHERE conv_id % 2 = 0 OR turn < 2),
    j AS (SELECT n.*, s.hash, coalesce(n.size = s.size AND path % 7 <> 3, false) AS fits FROM n LEFT JOIN s ON path = conv_id AND stream_type = turn AND stream_name = role)
    SELECT path, stream_type, stream_name, size, hash FROM j WHERE path IN (SELECT path FROM j GROUP BY path HAVING bool_and(fits))""")
def template_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("stream_type"), F.col("role").alias("stream_name"), F.length("text").cast("long").alias("size"), F.sha1("text").alias("hash"))
    timed = streams.select("*", F.lit(1).alias("created"), F.lit(2).alias("written"), F.lit(5).alias("accessed"))
    grown = F.when((F.col("path") % 5 == 0) & (F.col("stream_type") == 1), F.col("size") + 1).otherwise(F.col("size"))
    new = timed.where("path % 2 = 0 or stream_type < 2").withColumn("size", grown).withColumn("accessed", F.when(F.col("path") % 7 == 3, 4).otherwise(6)).drop("hash")
    return dedup.template_reuse(new, timed)


@_query("""
    WITH e AS (SELECT l_orderkey % 400 AS link_id, l_returnflag AS hash, l_linestatus = 'O' AS is_directory, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS entry_id FROM lineitem)
    SELECT entry_id, link_id, CASE WHEN is_directory OR link_id = 0 THEN entry_id ELSE min(entry_id) OVER (PARTITION BY link_id, hash, is_directory) END AS inode,
           CASE WHEN is_directory OR link_id = 0 THEN 1 ELSE count(*) OVER (PARTITION BY link_id, hash, is_directory) END AS nlink FROM e""")
def hardlink_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")
    entries = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("link_id"), F.col("l_returnflag").alias("hash"), (F.col("l_linestatus") == "O").alias("is_directory"), entry.alias("entry_id"))
    return dedup.hard_links(entries).select("entry_id", "link_id", "inode", "nlink")


@_query(f"SELECT hash, count(*) AS n_targets, min(path) AS first_target FROM {_FILES} GROUP BY hash")
def extraction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.targets(_files(spark, sf_dir))


@_query("""
    WITH d AS (SELECT o_orderstatus AS image, o_orderpriority AS descriptor, min(o_orderkey) AS first_seen FROM orders GROUP BY ALL)
    SELECT image, descriptor, row_number() OVER (PARTITION BY image ORDER BY first_seen) - 1 AS security_id FROM d""")
def security_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.descriptors(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("image"), F.col("o_orderpriority").alias("descriptor"), F.col("o_orderkey").alias("ordinal"))).withColumn("security_id", F.col("security_id").cast("long"))


@_query("""
    SELECT s_suppkey, CASE WHEN n_nationkey IS NULL OR s_suppkey % 4 = 0 THEN -1 ELSE n_nationkey END AS security_id, CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS descriptor
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def security_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    inodes = _table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("image"), F.when(F.col("s_suppkey") % 4 == 0, 999).otherwise(F.col("s_nationkey")).alias("security_id"))
    table = _table(spark, sf_dir, "nation").select(F.lit(1).alias("image"), F.col("n_nationkey").alias("security_id"), F.col("n_name").alias("descriptor"))
    return dedup.with_descriptor(inodes, table).drop("image")


@_query("""
    WITH s AS (SELECT l_orderkey AS inode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS stream_id,
                      CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS name, CASE WHEN l_quantity > 10 THEN 1 END AS hash, l_orderkey % 3 = 0 AS rp, l_orderkey % 5 = 0 AS enc FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY inode, name IS NULL ORDER BY CASE WHEN enc AND hash IS NULL THEN 1 ELSE 0 END, stream_id) AS place FROM s)
    SELECT inode, stream_id, CASE WHEN name IS NOT NULL THEN 'named' WHEN enc THEN CASE WHEN place = 1 THEN 'encrypted' ELSE 'unused' END
      WHEN rp THEN CASE place WHEN 1 THEN 'reparse_point' WHEN 2 THEN 'data' ELSE 'unused' END ELSE CASE WHEN place = 1 THEN 'data' ELSE 'unused' END END AS role FROM r""")
def stream_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    streams = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("inode"), F.row_number().over(order).cast("long").alias("stream_id"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("name"),
        F.when(F.col("l_quantity") > 10, 1).alias("hash"), (F.col("l_orderkey") % 3 == 0).alias("is_reparse"), (F.col("l_orderkey") % 5 == 0).alias("is_encrypted"),
    )
    return dedup.stream_roles(streams).select("inode", "stream_id", "role")


@_query(f"SELECT page_id, path FROM {_PAGES} WHERE regexp_matches(path, '^/blog\\.[^/]*/en/[^/]*$')")
def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_globs(_pages(spark, sf_dir), ["blog.*/en/*"])


@_query(f"""
    WITH p AS (SELECT page_id, path, string_split(path, '/') AS x FROM {_PAGES}),
    e AS (SELECT page_id, path, list_transform(range(2, len(x) + 1), lambda i: array_to_string(list_slice(x, 1, i), '/')) AS heads FROM p)
    SELECT page_id, path FROM e WHERE len(list_filter(heads, lambda h: regexp_matches(h, '^(?:/blog\\.[^/]*(?:/.*)?|.*/[^/]*7(?:/.*)?)$')
      AND NOT regexp_matches(h, '^.*/[^/]*77(?:/.*)?$'))) = 0""")
def exclude_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.drop_excluded(_pages(spark, sf_dir), ["/blog.*", "*7"], ["*77"])


@_query("SELECT p_partkey, regexp_matches(p_name, '^[^/]*a[^/][^/]*$') AS is_match, regexp_matches(upper(p_name), '^P[^/]*1$') AS is_match_ci FROM part")
def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/"), "p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", globs.path_matches(name, "*a?*").alias("is_match"), globs.path_matches(name, "p*1", ignore_case=True).alias("is_match_ci"))


@_query(f"""
    WITH p AS (SELECT DISTINCT path FROM {_PAGES}), t AS (SELECT min(regexp_extract(path, '^/[^/]*', 0)) AS top FROM p)
    SELECT path, length(path) - length(replace(path, '/', '')) AS depth FROM p, t WHERE path = top OR starts_with(path, top || '/')""")
def subtree_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir).select("path").distinct()
    top = own.agg(F.min(F.regexp_extract("path", "^/[^/]*", 0))).first()[0] or "/"
    return select.list_subtree(own, top).select("path", paths.depth("path").cast("long").alias("depth"))


@_query(f"""
    WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
    t AS (SELECT id, '/' || name AS path, 1 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.path || '/' || n.name, t.depth + 1 FROM n JOIN t ON n.parent_id = t.id)
    SELECT id, path, depth FROM t""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda table, mark, key, parent, name: _table(spark, sf_dir, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.alias("parent_id"), F.col(name).alias("name"))
    up = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    nodes = node("region", "r", "r_regionkey", F.lit(None).cast("string"), "r_name").unionByName(node("nation", "n", "n_nationkey", up("r", "n_regionkey"), "n_name"))
    return select.materialise_paths(nodes.unionByName(node("customer", "c", "c_custkey", up("n", "c_nationkey"), "c_name")))


@_query(f"""
    WITH p AS (SELECT DISTINCT path FROM {_PAGES}), s AS (SELECT path, string_split(path, '/') AS x FROM p),
    e AS (SELECT DISTINCT array_to_string(list_slice(x, 1, i), '/') AS path FROM s, unnest(range(2, len(x) + 1)) AS u(i))
    SELECT path, path NOT IN (SELECT path FROM p) AS is_added FROM e""")
def ancestor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.fill_ancestors(_pages(spark, sf_dir))


@_query(f"""
    WITH p AS (SELECT DISTINCT path FROM {_PAGES} UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]*/[^/]*)', 1) FROM {_PAGES} WHERE page_id % 10 = 0)
    SELECT path FROM p WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.path <> '' AND starts_with(p.path, q.path || '/'))""")
def contained_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir)
    tops = own.where("page_id % 10 = 0").select(F.regexp_extract("path", "^(/[^/]*/[^/]*)", 1).alias("path")).where("path <> ''")
    return select.topmost(own.select("path").unionByName(tops))


@_query("""
    WITH n AS (SELECT p_partkey, p_brand AS parent, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS name FROM part),
    g AS (SELECT parent, upper(name) AS folded, count(DISTINCT name) AS n_alike FROM n GROUP BY parent, upper(name) HAVING count(DISTINCT name) > 1)
    SELECT p_partkey, n.parent, name, n_alike FROM n JOIN g ON n.parent = g.parent AND upper(name) = folded""")
def case_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    return select.case_conflicts(_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("parent"), name.alias("name")))


@_query("""
    SELECT 'x' || p_partkey AS wanted, 'X' || p_partkey AS path FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'x' || p_partkey, 'x' || p_partkey FROM part WHERE p_partkey % 3 = 0""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    named = lambda mark: F.concat(F.lit(mark), F.col("p_partkey").cast("string"))
    entries = part.select(named("X").alias("path")).unionByName(part.where("p_partkey % 3 = 0").select(named("x").alias("path")))
    return select.lookup_paths(entries, part.select(named("x").alias("wanted")))


@_query("""
    WITH w AS (SELECT n_name AS wanted FROM nation UNION ALL SELECT n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'nobody')
    SELECT wanted, coalesce(a.n_nationkey, b.n_nationkey, -1) AS image_index FROM w
    LEFT JOIN nation a ON regexp_matches(wanted, '^[1-9][0-9]*$') AND a.n_nationkey::VARCHAR = wanted LEFT JOIN nation b ON b.n_name = wanted""")
def image_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_name").alias("wanted")).unionByName(nation.select(F.col("n_nationkey").cast("string").alias("wanted"))).unionByName(spark.range(1).select(F.lit("nobody").alias("wanted")))
    return select.resolve_each(wanted, nation.select(F.col("n_nationkey").alias("image_index"), F.col("n_name").alias("name"))).fillna(-1, ["image_index"])


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) AS image_index, n_name FROM nation WHERE n_nationkey NOT IN (3, 7)")
def renumber_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_index"), "n_name")
    return combine.delete_images(images, [3, 7])[0].withColumn("image_index", F.col("image_index").cast("long"))


@_query("""
    WITH n AS (SELECT s_nationkey AS image, s_name AS root, CAST(floor(s_acctbal / 1000) AS BIGINT) AS score FROM supplier WHERE s_acctbal >= 1000)
    SELECT image, root, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, root) AS place FROM n) WHERE place = 1""")
def systemroot_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image"), F.col("s_name").alias("root"), F.floor(F.col("s_acctbal") / 1000).alias("score"))
    return select.best_of(scored, "image", "root", "score")


_EXTENTS = "(SELECT l_orderkey AS res, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS size, l_discount FROM lineitem)"


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("res"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"), "l_discount")


_UNIQUE = ["l_linenumber", "l_partkey", "l_suppkey"]


@_query(f"""
    WITH e AS (SELECT *, l_linenumber * 40 AS start FROM {_EXTENTS}), o AS (SELECT *, max(start + size) OVER (PARTITION BY res ORDER BY start, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_end FROM e)
    SELECT res, start, size, l_partkey, l_suppkey, before_end FROM o WHERE start < before_end""")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = _extents(spark, sf_dir).withColumn("start", (F.col("l_linenumber") * 40).cast("long"))
    return layout.overlaps(extents, "res", ["start", "l_partkey", "l_suppkey"]).select("res", "start", "size", "l_partkey", "l_suppkey", "before_end")


@_query(f"""
    SELECT res, l_linenumber, l_partkey, l_suppkey, size,
           coalesce(sum(size) OVER (PARTITION BY res ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_in_res FROM {_EXTENTS}""")
def solid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.solid_offsets(_extents(spark, sf_dir).drop("l_discount"), "res", _UNIQUE)


@_query(f"""
    WITH r AS (SELECT res % 100 AS run, res AS resource_no, sum(size) AS usize FROM {_EXTENTS} GROUP BY res),
    c AS (SELECT *, sum(usize) OVER (PARTITION BY run ORDER BY resource_no) AS res_end FROM r),
    b AS (SELECT DISTINCT run, (resource_no * 13) % 900 AS off, 5 AS size FROM r)
    SELECT b.run, off AS "offset", b.size, resource_no, (off - (res_end - usize))::BIGINT AS offset_in_res FROM b JOIN c ON b.run = c.run AND off + b.size <= res_end AND off + b.size > res_end - usize""")
def solid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = _extents(spark, sf_dir).groupBy((F.col("res") % 100).alias("run"), F.col("res").alias("resource_no")).agg(F.sum("size").alias("usize"))
    blobs = resources.select("run", (F.col("resource_no") * 13 % 900).alias("offset"), F.lit(5).alias("size")).distinct()
    return layout.assign_resources(blobs, resources, "run")


@_query(f"""
    SELECT res, sum(CASE WHEN l_discount > 0.05 THEN size ELSE 0 END)::BIGINT AS wanted_bytes, sum(size)::BIGINT AS all_bytes,
           sum(CASE WHEN l_discount > 0.05 THEN size ELSE 0 END) * 3 > sum(size) * 2 AS is_raw_copy FROM {_EXTENTS} GROUP BY res""")
def raw_copy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.raw_copies(_extents(spark, sf_dir), "res", F.col("l_discount") > 0.05)


@_query(f"""
    WITH n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)/*$', 1) AS name FROM {_PAGES}), x AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$', 0) END AS ext FROM n)
    SELECT page_id, row_number() OVER (ORDER BY name <> '', ext IS NOT NULL, translate(coalesce(ext, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), page_id) AS rank FROM x""")
def solid_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(_pages(spark, sf_dir), [*layout.solid_order(F.col("path")), F.col("page_id")]).select("page_id", "rank")


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_linestatus, l_returnflag <> 'R', l_suppkey, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem""")
def sequential_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("location"), (F.col("l_returnflag") == "R").alias("is_compacted"), F.col("l_suppkey").alias("guid"))
    rows = rows.withColumn("part_number", F.col("l_orderkey")).withColumn("res_offset", F.col("l_linenumber")).withColumn("offset_in_res", F.col("l_partkey"))
    return global_rank(rows, layout.sequential_order(rows.columns)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@_query(f"""
    WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY id) AS i, id, size, id % 50 = 0 AS meta FROM {_FILES}),
    p AS (SELECT i, id, 1 AS part_number, size AS filled FROM f WHERE i = 1
      UNION ALL SELECT f.i, f.id, CASE WHEN filled > 0 AND filled + size >= 65536 AND NOT meta THEN part_number + 1 ELSE part_number END,
                       CASE WHEN filled > 0 AND filled + size >= 65536 AND NOT meta THEN size ELSE filled + size END FROM p JOIN f ON f.i = p.i + 1)
    SELECT id AS ordinal, part_number FROM p""")
def split_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _files(spark, sf_dir).select(F.col("id").alias("ordinal"), "size", (F.col("id") % 50 == 0).alias("is_metadata"))
    return combine.split_parts(blobs, 65536).select("ordinal", "part_number")


@_query("""
    WITH b AS (SELECT '/p/' || p_partkey AS path, p_partkey % 10 = 0 AS is_directory, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
    t AS (SELECT '/p/' || p_partkey AS path, p_partkey % 10 = 0 AS is_directory, p_size + 100 AS size FROM part WHERE p_partkey % 3 <> 1)
    SELECT path, coalesce(t.is_directory, b.is_directory) AS is_directory, coalesce(t.size, b.size) AS size,
           CASE WHEN b.path IS NOT NULL AND t.path IS NOT NULL THEN 'both' WHEN t.path IS NOT NULL THEN 'top' ELSE 'base' END AS origin FROM b FULL JOIN t USING (path)""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 10 == 0).alias("is_directory"), F.col("p_size").alias("size"), "p_partkey")
    return combine.overlay(part.where("p_partkey % 3 <> 0").drop("p_partkey"), part.where("p_partkey % 3 <> 1").drop("p_partkey").withColumn("size", F.col("size") + 100))


_TOP = f"(SELECT min(regexp_extract(path, '^/[^/]*', 0)) FROM {_PAGES})"


def _top(pages: DataFrame) -> str:
    return pages.agg(F.min(F.regexp_extract("path", "^/[^/]*", 0))).first()[0] or "/"


@_query(f"SELECT page_id, CASE WHEN path = {_TOP} OR starts_with(path, {_TOP} || '/') THEN '/moved/here' || substr(path, length({_TOP}) + 1) ELSE path END AS path FROM {_PAGES}")
def rename_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir)
    return combine.move_subtree(own, _top(own), "/moved/here")


@_query(f"SELECT page_id, path FROM {_PAGES} WHERE NOT (path = {_TOP} OR starts_with(path, {_TOP} || '/'))")
def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir).withColumn("is_directory", F.lit(True))
    top = own.limit(0).select("page_id", F.lit("").alias("path"), "is_directory").unionByName(own.agg(F.lit(-1).cast("long").alias("page_id"), F.min(F.regexp_extract("path", "^/[^/]*", 0)).alias("path")).withColumn("is_directory", F.lit(True)))
    return combine.delete_path(own.unionByName(top), _top(own), recursive=True).drop("is_directory")


@_query("""
    SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 AS filetime, epoch_us(ts) AS micros, strftime(ts, '%a %b %d %H:%M:%S %Y UTC') AS shown FROM events""")
def filetime_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = values.filetime_of(F.col("ts"))
    return _table(spark, sf_dir, "events").select("event_id", ticks.alias("filetime"), values.micros_of(ticks).alias("micros"), values.shown_time(ticks).alias("shown"))


@_query("""
    WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_linenumber * 16 + l_orderkey % 8 + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END)::BIGINT AS attributes FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, attributes, (attributes & 16) <> 0 AND (attributes & 1024) = 0 AS is_directory, (attributes & 1024) <> 0 AND l_partkey % 2 = 0 AS is_symlink,
      array_to_string(list_filter([CASE WHEN attributes & 1 <> 0 THEN 'readonly' END, CASE WHEN attributes & 2 <> 0 THEN 'hidden' END, CASE WHEN attributes & 4 <> 0 THEN 'system' END,
        CASE WHEN attributes & 16 <> 0 THEN 'directory' END, CASE WHEN attributes & 32 <> 0 THEN 'archive' END, CASE WHEN attributes & 64 <> 0 THEN 'device' END,
        CASE WHEN attributes & 1024 <> 0 THEN 'reparse_point' END], lambda x: x IS NOT NULL), ',') AS names FROM a""")
def attribute_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = (F.col("l_linenumber") * 16 + F.col("l_orderkey") % 8 + F.when(F.col("l_returnflag") == "R", 1024).otherwise(0)).cast("long").alias("attributes")
    tag = F.when(F.col("l_partkey") % 2 == 0, F.lit(values.SYMLINK_TAGS[0]))
    a = F.col("attributes")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", bits).select("*", values.is_directory(a).alias("is_directory"), values.is_symlink(a, tag).alias("is_symlink"), F.array_join(values.attribute_names(a), ",").alias("names"))


@_query("SELECT count(*) FILTER (l_returnflag = 'R') AS reparse, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_quantity > 40) AS large FROM lineitem")
def feature_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.feature_tally(_table(spark, sf_dir, "lineitem"), {"reparse": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "large": F.col("l_quantity") > 40})


@_query("""
    SELECT doc_id AS id, i AS chunk_no, sha1(substr(text, i * 4096 + 1, 4096)) AS sha1, length(substr(text, i * 4096 + 1, 4096)) AS length
    FROM documents, unnest(range(0, (length(text) + 4095) // 4096)) AS u(i)""")
def integrity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.integrity_chunks(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 4096)


@_query("""
    WITH c AS (SELECT doc_id AS id, i, substr(text, i * 4096 + 1, 4096) AS x FROM documents, unnest(range(0, (length(text) + 4095) // 4096)) AS u(i))
    SELECT id, count(*) AS n_chunks, count(*) FILTER (id % 7 = 0 AND i = 0) AS n_bad, NOT bool_or(id % 7 = 0 AND i = 0) AS is_intact FROM c GROUP BY id""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify.integrity_chunks(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 4096)
    stored = found.withColumn("sha1", F.when((F.col("id") % 7 == 0) & (F.col("chunk_no") == 0), "spoilt").otherwise(F.col("sha1")))
    return verify.check_integrity(found, stored)


@_query(f"""
    WITH f AS {_FILES}, a AS (SELECT path, hash, size FROM f WHERE id % 3 <> 0), b AS (SELECT path, CASE WHEN id % 7 = 0 THEN 'other' ELSE hash END AS hash, CASE WHEN id % 11 = 0 THEN 0 ELSE size END AS size FROM f WHERE id % 3 <> 1)
    SELECT path, d AS difference FROM (SELECT path, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' WHEN a.hash <> b.hash THEN 'hash' WHEN a.size <> b.size THEN 'size' END AS d FROM a FULL JOIN b USING (path)) WHERE d IS NOT NULL""")
def compare_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    second = files.where("id % 3 <> 1").withColumn("hash", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("hash"))).withColumn("size", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("size")))
    return verify.compare_trees(files.where("id % 3 <> 0"), second, ["hash", "size"])


@_query("""
    SELECT count(*) AS n_streams, count(*) FILTER (sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 4 <> 0)) AS n_missing,
           (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 9 = 1) AS n_corrupt FROM documents""")
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 4 <> 0").select(F.sha1("text").alias("hash"), F.when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return verify.verify_archive(docs.select(F.sha1("text").alias("hash")), stored)


@_query("""
    WITH e AS (SELECT c_nationkey AS parent, 'c' || (c_custkey % 40) AS name, c_custkey % 5 = 0 AS is_directory, c_custkey % 7 = 0 AS is_reparse, c_custkey % 3 AS nlink FROM customer)
    SELECT * FROM (SELECT 'linked directory' AS rule, count(*) FILTER (is_directory AND nlink > 1) AS n FROM e UNION ALL SELECT 'linked reparse point', count(*) FILTER (is_reparse AND nlink > 1) FROM e
      UNION ALL SELECT 'double name', (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM e GROUP BY parent, name)) UNION ALL SELECT 'empty blob', count(*) FILTER (p_size <= 10) FROM part) WHERE n > 0""")
def invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    entries = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), F.concat(F.lit("c"), (key % 40).cast("string")).alias("name"), (key % 5 == 0).alias("is_directory"), (key % 7 == 0).alias("is_reparse"), (key % 3).alias("nlink"))
    return verify.invariants(entries, _table(spark, sf_dir, "part").select((F.col("p_size") - 10).alias("size")))


@_query(f"""
    SELECT page_id, regexp_extract(path, '([^/]*)/*$', 1) AS base, CASE WHEN regexp_replace(path, '/+[^/]*/*$', '') = '' THEN '/' ELSE regexp_replace(path, '/+[^/]*/*$', '') END AS parent,
           length(path) - length(replace(path, '/', '')) AS depth, CASE WHEN contains(regexp_extract(path, '([^/]*)/*$', 1), '.') THEN regexp_extract(path, '[^.]*$', 0) END AS ext FROM {_PAGES}""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", paths.basename("path").alias("base"), paths.parent_path("path").alias("parent"), paths.depth("path").cast("long").alias("depth"), paths.extension("path").alias("ext"))


@_query("""
    SELECT p_partkey, CASE WHEN x >= 10737418240 THEN (x >> 30) || ' GiB' WHEN x >= 10485760 THEN (x >> 20) || ' MiB' WHEN x >= 10240 THEN (x >> 10) || ' KiB' ELSE x || ' bytes' END AS shown,
           CASE p_size % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'XPRESS' WHEN 2 THEN 'LZX' WHEN 3 THEN 'LZMS' ELSE 'Unknown' END AS compression
    FROM (SELECT *, (p_partkey * p_partkey * p_partkey * p_size)::BIGINT AS x FROM part)""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("decimal(20,0)")  # products go beyond 64 bits from about 600,000 parts on
    size = key * key * key * F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", values.shown_size(size).alias("shown"), values.compression_name(F.col("p_size") % 5).alias("compression"))


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c AS chunk_no, greatest(o - c * 16, 0) AS from_byte, least(o + s - c * 16, 16) - greatest(o - c * 16, 0) AS n_bytes
    FROM (SELECT *, l_linenumber * 30 AS o, CAST(l_quantity AS BIGINT) AS s FROM lineitem), unnest(range(o // 16, (o + s - 1) // 16 + 1)) AS u(c)""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ranges = _table(spark, sf_dir, "lineitem").select(key.alias("id"), (F.col("l_linenumber") * 30).cast("long").alias("offset"), F.col("l_quantity").cast("long").alias("size"))
    return layout.chunk_ranges(ranges, 16).select("id.*", "chunk_no", "from_byte", "n_bytes")


@_query("""
    WITH b AS (SELECT c_custkey AS id, c_custkey % 4 AS ordinal, 'p' || (c_custkey % 97) AS path FROM customer)
    SELECT path, min(ordinal) AS ordinal, count(*) FILTER (ordinal = m) AS n FROM (SELECT *, min(ordinal) OVER (PARTITION BY path) AS m FROM b) GROUP BY path""")
def first_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("ordinal"), F.concat(F.lit("p"), (F.col("c_custkey") % 97).cast("string")).alias("path"))
    return select.first_by_path(entries).groupBy("path").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("n"))


@_query("SELECT count(*) AS n_images, (SELECT count(*) FROM documents) AS n_entries, (SELECT count(DISTINCT sha1(text)) FROM documents) AS n_blobs, (SELECT sum(octet_length(encode(text)))::BIGINT FROM documents) AS all_bytes FROM (SELECT DISTINCT lang FROM documents)")
def archive_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).agg(F.count_distinct("image").alias("n_images"), F.count(F.lit(1)).alias("n_entries"), F.count_distinct("hash").alias("n_blobs"), F.sum("size").alias("all_bytes"))


@_query()
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events; those of even ids are needed."""
    from ..streaming.extract import extract_stream, extracted
    from .durable import new_path

    events = _table(spark, sf_dir, "events")
    needed = events.where("event_id % 2 = 0").select("event_id")
    folder = new_path(spark, "stream")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    extract_stream(stream, needed, "event_id", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return extracted(spark, f"{folder}/out", needed, "event_id").select("event_id", "user_id", "event_type")



from . import archive_queries  # noqa: E402, F401 - registers its queries
