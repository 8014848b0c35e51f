"""The entry tree: paths, lookups, listings, subtree totals, copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..model import is_dir, is_live
from ..sources.storage import written

#: Deepest level that is followed; beyond it the parent links are taken to be a cycle.
MAX_DEPTH = 4096
ROOT = 0


def _levels(start: DataFrame, children: DataFrame, step: Column, carried: list[str], max_depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The rows reachable from ``start`` that have children themselves, by level, and the others.

    The narrow children are written once.  Only those that are parents are walked level by level, and each level is written, so
    plans stay small however deep the tree is; all other children, by far the most, follow in one join."""
    kids = written(children.where("id <> parentId").select(F.col("id").alias("_id"), F.col("parentId").alias("_parent"), F.col("name").alias("_c")), "children")
    parents = kids.select(F.col("_parent").alias("_q")).distinct()
    inner = written(kids.join(parents, F.col("_id") == F.col("_q"), "left_semi"), "parents")
    leaves = kids.join(parents, F.col("_id") == F.col("_q"), "left_anti")

    def below(level: DataFrame, of: DataFrame) -> DataFrame:
        met = of.join(level, F.col("_parent") == F.col("id")).withColumn("_p", F.col(carried[0]))
        return met.select(F.col("_id").alias("id"), step.alias(carried[0]), *(F.col(c) for c in carried[1:]))

    found = [written(start.select("id", *carried), "level")]
    while not (level := written(below(found[-1], inner), "level")).isEmpty():
        if len(found) > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth} levels or its parent links have a cycle")
        found.append(level)
    return found, below(reduce(DataFrame.unionByName, found), leaves)


def descend(start: DataFrame, children: DataFrame, step: Column, carried: list[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """All rows reachable from ``start`` (id, carried columns) over ``children`` (id, parentId, ...).

    ``step`` makes the first carried column of a child from ``_c`` (the child's name) and ``_p`` (its parent's value);
    the others pass down."""
    found, rest = _levels(start, children, step, carried, max_depth)
    return reduce(DataFrame.unionByName, [*found, rest])


def paths(entries: DataFrame, broken: bool = False) -> DataFrame:
    """Live entries that have only live ancestors, with ``path``; directories end with a slash, the root is ``/``.
    With ``broken`` also those below a parent that is missing or deleted; their paths begin with ``[not found]/``."""
    live = entries.where(is_live())
    start = live.where(F.col("id") == ROOT).select("id", F.lit("/").alias("path"))
    if broken:
        there = live.select(F.col("id").alias("_q"))
        lost = live.where(F.col("id") != ROOT).join(there, F.col("parentId") == F.col("_q"), "left_anti")
        start = start.unionByName(lost.select("id", F.concat(F.lit("[not found]/"), "name", F.lit("/")).alias("path")))
    found = descend(start, live, F.concat("_p", "_c", F.lit("/")), ["path"])
    named = found.withColumnRenamed("id", "_id").join(live, F.col("_id") == F.col("id")).drop("_id")
    return named.withColumn("path", F.when(is_dir(), F.col("path")).otherwise(F.expr("substring(path, 1, length(path) - 1)")))


def ancestors(entries: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of live entries: each below every directory above it, itself at depth 0."""
    live = entries.where(is_live())
    start = live.select("id", F.lit(0).alias("depth"), F.col("id").alias("ancestor"))
    dirs = start.join(live.where(is_dir()).select(F.col("id").alias("_d")), F.col("id") == F.col("_d"), "left_semi")
    return descend(dirs, live, F.col("_p") + 1, ["depth", "ancestor"])


def entry(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live entries with the ids of ``wanted``."""
    return entries.where(is_live()).join(wanted.select("id").distinct(), "id", "left_semi")


def child(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live entries with the (parentId, name) of ``wanted``."""
    return entries.where(is_live()).join(wanted.select("parentId", "name").distinct(), ["parentId", "name"], "left_semi")


def children(entries: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Live children, without the root as its own child."""
    kids = entries.where(is_live() & (F.col("name") != ""))
    return kids if parents is None else kids.join(parents.select(F.col("id").alias("parentId")).distinct(), "parentId", "left_semi")


def resolve(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) with the id of the entry it leads to, null if none; slashes may repeat or end the path."""
    norm = F.concat(F.lit("/"), F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/"))
    known = paths(entries).select(F.when(F.col("id") == ROOT, F.lit("/")).otherwise(F.regexp_replace("path", "/$", "")).alias("_norm"), F.col("id"))
    return wanted.withColumn("_want", norm).join(known, F.col("_want") == F.col("_norm"), "left").drop("_want", "_norm")


def entries_for_content(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live entries that refer to the contents of ``wanted`` (id)."""
    asked = wanted.select(F.col("id").alias("_d")).distinct()
    return entries.where(is_live()).join(asked, F.col("dataId") == F.col("_d"), "left_semi")


def logical_sizes(contents: DataFrame) -> DataFrame:
    """(dataId, size): the length kept on the first part."""
    return contents.where("seq = 1").select(F.col("id").alias("dataId"), F.coalesce("length", F.lit(0)).cast("long").alias("size"))


def with_sizes(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """``entries`` with ``size``: the content's logical size, 0 without content, null for directories."""
    sized = entries.join(logical_sizes(contents), "dataId", "left")
    return sized.withColumn("size", F.when(~is_dir(), F.coalesce("size", F.lit(0))).cast("long"))


def listing(entries: DataFrame, contents: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Children with size and ``place``, from 1: directories first, then files, each by name."""
    rows = with_sizes(children(entries, parents), contents).withColumn("is_dir", is_dir())
    order = Window.partitionBy("parentId").orderBy(F.desc("is_dir"), "name", "id")
    return rows.withColumn("place", F.row_number().over(order))


def page(listed: DataFrame, offset: int, count: int) -> DataFrame:
    """One page of each directory's listing; the entries ``.`` and ``..`` come first."""
    dots = listed.select("parentId").distinct().select("parentId", F.explode(F.array(F.struct(F.lit(".").alias("name"), F.lit(1).alias("at")), F.struct(F.lit("..").alias("name"), F.lit(2).alias("at")))).alias("d"))
    rows = listed.select("parentId", "name", (F.col("place") + 2).alias("at")).unionByName(dots.select("parentId", "d.name", "d.at"))
    return rows.where((F.col("at") > offset) & (F.col("at") <= offset + count))


def subtree_stats(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """For every live directory: files, dirs (itself not counted) and bytes below it.  Files that share a content
    count it each.

    Files are summed by directory; the sums then go up from the deepest level, one row a directory."""
    live = entries.where(is_live())
    sums = ("files", "dirs", "bytes")
    sized = with_sizes(live.where(~is_dir()), contents)
    own = sized.groupBy(F.col("parentId").alias("_up")).agg(F.count("*").alias("_files"), F.sum("size").cast("long").alias("_bytes"))
    dirs = live.where(is_dir()).select("id", "parentId", "name")
    known = dirs.select(F.col("id").alias("_d"))
    # The root, and directories below what is not a live directory, are tops.
    top = (F.col("id") == F.col("parentId")) | F.col("_d").isNull()
    tops = dirs.join(known, F.col("parentId") == F.col("_d"), "left").where(top).select("id", F.lit(0).alias("depth"))
    placed = descend(tops, dirs, F.col("_p") + 1, ["depth"]).join(dirs.select(F.col("id").alias("_i"), "parentId"), F.col("id") == F.col("_i")).drop("_i")
    own_sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c[1:]) for c in ("_files", "_bytes")]
    nodes = written(placed.join(own, F.col("id") == F.col("_up"), "left").select("id", "parentId", "depth", own_sums[0], F.lit(0).cast("long").alias("dirs"), own_sums[1]), "nodes")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("n")).first()["n"]
    done: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if done:
            up = done[-1].groupBy(F.col("parentId").alias("_up")).agg(
                F.sum("files").alias("_files"), (F.sum("dirs") + F.count("*")).alias("_dirs"), F.sum("bytes").alias("_bytes")
            )
            level = level.join(up, F.col("id") == F.col("_up"), "left").select(
                "id", "parentId", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in sums)
            )
        done.append(written(level.select("id", "parentId", *sums), "level"))
    return reduce(DataFrame.unionByName, done).select("id", *sums)


def subtree(entries: DataFrame, tops: DataFrame) -> DataFrame:
    """(id, top, depth): the live entries at and below the ids of ``tops``."""
    live = entries.where(is_live())
    start = live.join(tops.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("depth"), F.col("id").alias("top"))
    return descend(start, live, F.col("_p") + 1, ["depth", "top"])


def copy_subtree(entries: DataFrame, top: int, target: int, name: str, first_id: int) -> DataFrame:
    """The new entries of a copy of ``top`` under ``target``: ids from ``first_id`` in the order of the originals,
    contents shared."""
    from .extents import prefix_axis

    below = subtree(entries, entries.where(F.col("id") == top))
    one = below.select("id").withColumn("one", F.lit(1).cast("long"))
    ids = prefix_axis(one, "id", "one", "rank", "_to").select("id", (F.col("rank") + first_id).alias("new_id"))
    rows = entries.join(ids, "id")
    parents = ids.select(F.col("id").alias("_p"), F.col("new_id").alias("_new_parent"))
    moved = rows.join(parents, F.col("parentId") == F.col("_p"), "left")
    is_top = F.col("id") == top
    return moved.select(
        F.col("new_id").alias("id"),
        F.when(is_top, F.lit(target)).otherwise(F.col("_new_parent")).cast("long").alias("parentId"),
        F.when(is_top, F.lit(name)).otherwise(F.col("name")).alias("name"),
        "time",
        "deleted",
        "dataId",
    )


def find(entries: DataFrame, name_pattern: Column, path_pattern: Column | None = None) -> DataFrame:
    """Live entries whose name, and whose path if a pattern is given, match; (id, path)."""
    found = paths(entries).where(name_pattern)
    return (found if path_pattern is None else found.where(path_pattern)).select("id", "path")


def cycles(entries: DataFrame) -> DataFrame:
    """Ids of entries from which the root cannot be reached over parent links."""
    start = entries.where(F.col("id") == ROOT).select("id", F.lit(0).alias("depth"))
    found = descend(start, entries, F.col("_p") + 1, ["depth"])
    return entries.select("id").join(found.select("id"), "id", "left_anti")
