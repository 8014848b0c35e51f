"""Statistics, deletion, reclaiming, blacklisting and integrity of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import is_dir, is_live, non_zero
from ..sources.storage import written
from .extents import with_reach
from .tree import MAX_DEPTH, ROOT, descend, paths, subtree

DAY_MILLIS = 24 * 60 * 60 * 1000


def stats(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """One row: files and directories, live and deleted (the root counts as live), contents, the end of the storage and
    the bytes in use."""
    d = is_dir()
    tree = entries.agg(
        F.count(F.when(~d & is_live(), 1)).alias("files"),
        F.count(F.when(~d & ~is_live(), 1)).alias("deleted_files"),
        F.count(F.when(d & is_live(), 1)).alias("dirs"),
        F.count(F.when(d & ~is_live(), 1)).alias("deleted_dirs"),
    )
    data = contents.agg(
        F.count(F.when(F.col("seq") == 1, 1)).alias("contents"),
        F.coalesce(F.max("stop"), F.lit(0)).cast("long").alias("storage_end"),
        F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).cast("long").alias("live_bytes"),
    )
    one = F.lit(1).alias("_one")
    return tree.select("*", one).join(data.select("*", one), "_one").drop("_one")


def report(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """``stats`` with the number and the bytes of the gaps before the end of the storage."""
    free = with_reach(contents).where("start > reach")
    totals = free.agg(F.count("*").alias("gaps"), F.coalesce(F.sum(F.col("start") - F.col("reach")), F.lit(0)).cast("long").alias("free_bytes"))
    one = F.lit(1).alias("_one")
    return stats(entries, contents).select("*", one).join(totals.select("*", one), "_one").drop("_one")


def deletable(entries: DataFrame) -> DataFrame:
    """Ids of live entries, but the root, without live children."""
    live = entries.where(is_live())
    parents = live.where("id <> parentId").select(F.col("parentId").alias("_p")).distinct()
    return live.where(F.col("id") != ROOT).join(parents, F.col("id") == F.col("_p"), "left_anti").select("id")


def mark_deleted(entries: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    """``entries`` with those of ``gone`` (id) marked deleted, if they are live."""
    marks = gone.select(F.col("id").alias("_id")).distinct()
    hit = F.col("_id").isNotNull() & is_live()
    return entries.join(marks, F.col("id") == F.col("_id"), "left").withColumn("deleted", F.when(hit, non_zero(F.lit(now_ms))).otherwise(F.col("deleted"))).drop("_id")


def delete_recursively(entries: DataFrame, tops: DataFrame, now_ms: int) -> DataFrame:
    """``entries`` with the live entries at and below ``tops`` marked deleted; the root itself stays."""
    return mark_deleted(entries, subtree(entries, tops).where(F.col("id") != ROOT), now_ms)


def purged(entries: DataFrame, keep_days: int, now_ms: int) -> DataFrame:
    """Ids that reclaiming removes: entries deleted at least ``keep_days`` ago and, whatever their own state,
    everything below them.  The root is never among them."""
    cut = now_ms - keep_days * DAY_MILLIS
    expired = entries.where(~is_live() & (F.col("deleted") <= cut) & (F.col("id") != ROOT))
    below = descend(expired.select("id", F.lit(0).alias("depth")).distinct(), entries, F.col("_p") + 1, ["depth"], MAX_DEPTH)
    return below.where(F.col("id") != ROOT).select("id").distinct()


def orphan_contents(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Ids of stored contents that no entry, live or deleted, refers to."""
    used = entries.where("dataId >= 0").select(F.col("dataId").alias("_d")).distinct()
    return contents.select("id").distinct().join(used, F.col("id") == F.col("_d"), "left_anti")


def orphan_references(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Content ids that entries refer to and that are not stored."""
    held = contents.select(F.col("id").alias("_d")).distinct()
    return entries.where("dataId >= 0").select("dataId").distinct().join(held, F.col("dataId") == F.col("_d"), "left_anti")


def reclaim(entries: DataFrame, contents: DataFrame, keep_days: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Entries and contents after reclaiming: purged entries go, and with them all parts of contents nobody refers to."""
    gone = purged(entries, keep_days, now_ms).select(F.col("id").alias("_gone"))
    kept = written(entries.join(gone, F.col("id") == F.col("_gone"), "left_anti"), "entries")
    orphans = orphan_contents(kept, contents).select(F.col("id").alias("_orphan"))
    return kept, contents.join(orphans, F.col("id") == F.col("_orphan"), "left_anti")


def without_storage(contents: DataFrame, dropped: DataFrame) -> DataFrame:
    """``contents`` after the storage of ``dropped`` (id) is given up: one part at (0, 0) stays of each."""
    marks = dropped.select(F.col("id").alias("_id")).distinct()
    joined = contents.join(marks, F.col("id") == F.col("_id"), "left").where("_id IS NULL OR seq = 1")
    zero = F.when(F.col("_id").isNotNull(), F.lit(0))
    return joined.withColumn("start", zero.otherwise(F.col("start")).cast("long")).withColumn("stop", zero.otherwise(F.col("stop")).cast("long")).drop("_id")


def blacklist(entries: DataFrame, contents: DataFrame, folder: int, delete_copies: bool, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Entries and contents after the files below the directory ``folder`` are blacklisted: their storage is given up, and
    live copies elsewhere are marked deleted if asked for."""
    inside = subtree(entries, entries.where(F.col("id") == folder)).select(F.col("id").alias("_in"))
    listed = entries.where(is_live() & ~is_dir()).join(inside, F.col("id") == F.col("_in"), "left_semi")
    banned = listed.where("dataId >= 0").select(F.col("dataId").alias("id")).distinct()
    after = without_storage(contents, banned)
    if not delete_copies:
        return entries, after
    copies = entries.where(is_live()).join(banned.select(F.col("id").alias("_b")), F.col("dataId") == F.col("_b"), "left_semi")
    elsewhere = copies.join(inside, F.col("id") == F.col("_in"), "left_anti").select("id")
    return mark_deleted(entries, elsewhere, now_ms), after


def add_to_blacklist(files: DataFrame, known: DataFrame, first_id: int) -> DataFrame:
    """External files (file, hash, length) as contents without storage: (id, seq, length, start, stop, hash) of those that are new."""
    from .content import deduplicated

    fresh = deduplicated(files, known, first_id).where("action <> 'link'")
    rows = fresh.join(known.select(F.col("id").alias("_k")), F.col("dataId") == F.col("_k"), "left_anti")
    zero = F.lit(0).cast("long")
    return rows.select(F.col("dataId").alias("id"), F.lit(1).alias("seq"), "length", zero.alias("start"), zero.alias("stop"), "hash")


def storage_sizes(contents: DataFrame) -> DataFrame:
    """(id, logical, stored, hash) of every content."""
    first = F.col("seq") == 1
    return contents.groupBy("id").agg(
        F.coalesce(F.max(F.when(first, F.col("length"))), F.lit(0)).cast("long").alias("logical"),
        F.sum(F.col("stop") - F.col("start")).cast("long").alias("stored"),
        F.max(F.when(first, F.col("hash"))).alias("hash"),
    )


def check(contents: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, verdict) of every content, given the digests (id, actual_hash) of what the store holds."""
    joined = storage_sizes(contents).join(actual, "id", "left")
    verdict = (
        F.when((F.col("logical") == 0) & (F.col("stored") == 0), "OK")
        .when(F.col("stored") == 0, "BLACKLISTED")
        .when(F.col("logical") != F.col("stored"), "BAD SIZE")
        .when(F.col("hash").isNull(), "NO HASH")
        .when(F.col("actual_hash").isNull(), "UNREADABLE")
        .when(F.col("hash") != F.col("actual_hash"), "BAD HASH")
        .otherwise("OK")
    )
    return joined.select("id", verdict.alias("verdict"))


def duplicate_contents(contents: DataFrame) -> DataFrame:
    """(hash, length) stored under more than one id."""
    return contents.where("seq = 1").groupBy("hash", "length").agg(F.count("*").alias("ids"), F.min("id").alias("first_id")).where("ids > 1")


def deleted_paths(entries: DataFrame) -> DataFrame:
    """Live entries below a deleted one: they have no live path."""
    reachable = paths(entries).select(F.col("id").alias("_id"))
    return entries.where(is_live()).join(reachable, F.col("id") == F.col("_id"), "left_anti")
