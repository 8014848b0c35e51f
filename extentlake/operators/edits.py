"""Batched changes of the tree as copy-on-write rewrites, with an outcome for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import is_dir, is_live, valid_name
from ..sources.storage import written
from .extents import prefix_axis
from .tree import ROOT


def _judged(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``requests`` (parentId, name, request) with ``outcome``: of equal names the first request wins."""
    dirs = entries.where(is_live() & is_dir()).select(F.col("id").alias("_p"))
    others = entries.where(is_live() & ~is_dir()).select(F.col("id").alias("_f"))
    taken = entries.where(is_live()).select(F.col("parentId").alias("_tp"), F.col("name").alias("_tn"), F.lit(True).alias("_taken")).distinct()
    turn = F.row_number().over(Window.partitionBy("parentId", "name").orderBy("request"))
    return (
        requests.withColumn("_turn", turn)
        .join(dirs, F.col("parentId") == F.col("_p"), "left")
        .join(others, F.col("parentId") == F.col("_f"), "left")
        .join(taken, (F.col("parentId") == F.col("_tp")) & (F.col("name") == F.col("_tn")), "left")
        .withColumn(
            "outcome",
            F.when(~valid_name(F.col("name")), "EINVAL")
            .when(F.col("_f").isNotNull(), "ENOTDIR")
            .when(F.col("_p").isNull(), "ENOENT")
            .when(F.col("_taken").isNotNull() | (F.col("_turn") > 1), "EEXIST")
            .otherwise("OK"),
        )
        .drop("_turn", "_p", "_f", "_tp", "_tn", "_taken")
    )


def make(entries: DataFrame, requests: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Entries after creating ``requests`` (request, parentId, name, time, dataId; null for directories), and the requests with outcome and id."""
    judged = _judged(requests, entries)
    good = judged.where("outcome = 'OK'").withColumn("one", F.lit(1).cast("long"))
    ids = prefix_axis(good, "request", "one", "_n", "_to").select(F.col("request").alias("_r"), (F.col("_n") + first_id).alias("id"))
    answered = judged.join(ids, F.col("request") == F.col("_r"), "left").drop("_r")
    new = answered.where("outcome = 'OK'").select("id", "parentId", "name", "time", F.lit(0).cast("long").alias("deleted"), "dataId")
    return entries.unionByName(new), answered.select("request", "outcome", "id")


def rename(entries: DataFrame, requests: DataFrame, now_ms: int = 1, copy: bool = False, first_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries after moving ``requests`` (request, id, parentId, name), and the requests with outcome.

    A request is judged against the tree as it is: unknown or deleted ids, the root and unknown parents are ENOENT, parents that are
    files ENOTDIR, bad names and moving a directory below itself EINVAL.  What has the name already is replaced, that is, marked
    deleted at ``now_ms``: but a file does not replace a directory (EISDIR), nor anything a directory with children (ENOTEMPTY).  Moving to
    the own place changes nothing.  Of equal targets the first request wins, the others are EEXIST.  With ``copy``, what would move to
    another parent is copied with all below it, contents shared, under ids from ``first_id``."""
    from .tree import subtree

    live = entries.where(is_live())
    origin = live.where(F.col("id") != ROOT).select(F.col("id").alias("_id"), F.col("parentId").alias("_op"), F.col("name").alias("_on"), is_dir().alias("_od"))
    parents = live.select(F.col("id").alias("_p"), is_dir().alias("_pd"))
    used = live.where("id <> parentId").select(F.col("parentId").alias("_u")).distinct()
    before = (
        live.where(F.col("id") != ROOT)
        .join(used, F.col("id") == F.col("_u"), "left")
        .select(F.col("parentId").alias("_tp"), F.col("name").alias("_tn"), F.col("id").alias("_ti"), is_dir().alias("_td"), F.col("_u").isNotNull().alias("_full"))
    )
    # Only the directories that are to be moved are walked.
    below = subtree(entries, requests.select("id")).select(F.col("id").alias("_new"), F.col("top").alias("_above"))
    judged = (
        requests.withColumn("_turn", F.row_number().over(Window.partitionBy("parentId", "name").orderBy("request")))
        .join(origin, F.col("id") == F.col("_id"), "left")
        .join(parents, F.col("parentId") == F.col("_p"), "left")
        .join(before, (F.col("parentId") == F.col("_tp")) & (F.col("name") == F.col("_tn")), "left")
        .join(below, (F.col("parentId") == F.col("_new")) & (F.col("id") == F.col("_above")), "left")
    )
    own = (F.col("_op") == F.col("parentId")) & (F.col("_on") == F.col("name"))
    outcome = (
        F.when(F.col("_id").isNull() | F.col("_p").isNull(), "ENOENT")
        .when(~F.col("_pd"), "ENOTDIR")
        .when(F.col("_above").isNotNull() | ~valid_name(F.col("name")), "EINVAL")
        .when(own, "OK")
        .when(~F.col("_od") & F.coalesce("_td", F.lit(False)), "EISDIR")
        .when(F.coalesce("_full", F.lit(False)), "ENOTEMPTY")
        .when(F.col("_turn") > 1, "EEXIST")
        .otherwise("OK")
    )
    judged = written(judged.select("request", "id", "parentId", "name", own.alias("_own"), "_op", "_ti", outcome.alias("outcome")), "judged")
    good = judged.where("outcome = 'OK' AND NOT _own")
    copied = good.where("_op <> parentId") if copy else good.limit(0)
    moved = good.where("_op = parentId") if copy else good
    moves = moved.select(F.col("id").alias("_id"), F.col("parentId").alias("_np"), F.col("name").alias("_nn"))
    replaced = good.where("_ti IS NOT NULL").select(F.col("_ti").alias("_rid")).distinct()
    after = entries.join(moves, F.col("id") == F.col("_id"), "left").join(replaced, F.col("id") == F.col("_rid"), "left")
    gone = F.col("_rid").isNotNull() & F.col("_id").isNull()
    after = (
        after.withColumn("deleted", F.when(gone, F.lit(now_ms)).otherwise(F.col("deleted")).cast("long"))
        .withColumn("parentId", F.coalesce("_np", "parentId"))
        .withColumn("name", F.coalesce("_nn", "name"))
        .drop("_id", "_np", "_nn", "_rid")
    )
    if copy:
        if first_id is None:
            raise ValueError("copies need a first id")
        tops = copied.select("request", F.col("id").alias("_top"), F.col("parentId").alias("_target"), F.col("name").alias("_name"))
        inside = subtree(entries, copied.select("id")).select(F.col("id").alias("_old"), F.col("top").alias("_t"))
        numbered = written(tops.join(inside, F.col("_top") == F.col("_t")).withColumn("_order", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "copies")
        ids = written(prefix_axis(numbered, "_order", "one", "_n", "_to").select("request", "_top", "_target", "_name", "_old", (F.col("_n") + first_id).alias("_new")), "ids")
        up = ids.select(F.col("request").alias("_r"), F.col("_old").alias("_up"), F.col("_new").alias("_new_up"))
        rows = ids.join(entries, F.col("_old") == F.col("id")).join(up, (F.col("request") == F.col("_r")) & (F.col("parentId") == F.col("_up")), "left")
        top = F.col("_old") == F.col("_top")
        new = rows.select(
            F.col("_new").alias("id"),
            F.when(top, F.col("_target")).otherwise(F.col("_new_up")).alias("parentId"),
            F.when(top, F.col("_name")).otherwise(F.col("name")).alias("name"),
            "time",
            "deleted",
            "dataId",
        )
        after = after.unionByName(new)
    return after, judged.select("request", "outcome")


def update(entries: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Entries with ``column`` (time or dataId) set from ``changes`` (id, column).  An id must not repeat, and must be an entry's."""
    wrong = changes.groupBy("id").count().where("count > 1").head(1)
    if wrong:
        raise ValueError(f"entry {wrong[0]['id']} is changed more than once")
    missing = changes.select(F.col("id").alias("_id")).join(entries, F.col("id") == F.col("_id"), "left_anti").head(1)
    if missing:
        raise ValueError(f"there is no entry {missing[0]['_id']}")
    news = changes.select(F.col("id").alias("_id"), F.col(column).alias("_v"))
    return entries.join(news, F.col("id") == F.col("_id"), "left").withColumn(column, F.coalesce("_v", column)).drop("_id", "_v")


def exactly_one_each(wanted: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``found`` if each row of ``wanted`` has just one row with equal ``on`` there; an error otherwise."""
    counted = wanted.select(*on).distinct().join(found.groupBy(*on).agg(F.count("*").alias("_n")), on, "left")
    wrong = counted.where("_n IS NULL OR _n > 1").head(1)
    if wrong:
        raise ValueError(f"{'no row' if wrong[0]['_n'] is None else 'more than one row'} for {wrong[0].asDict()}")
    return found


def insert_parts(contents: DataFrame, parts: DataFrame) -> DataFrame:
    """Contents with new parts (id, seq, length, start, stop, hash); length and hash stay with the first part only."""
    first = F.col("seq") == 1
    return contents.unionByName(parts.withColumn("length", F.when(first, F.col("length"))).withColumn("hash", F.when(first, F.col("hash"))))
