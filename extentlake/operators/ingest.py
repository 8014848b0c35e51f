"""Ingest planning: matching against a reference, the action for each file, references and ignore files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_to_regex
from ..model import is_dir, is_live
from .tree import ROOT


def ingest_plan(source: DataFrame, target: DataFrame, reference: DataFrame) -> DataFrame:
    """``source`` files (path, time, size) with ``action`` and the reference's ``dataId`` where it is used.

    A reference file (path, id, time, size, dataId) of the same path, time and size stands for the source, whose bytes then need
    not be read.  ``target`` (path, id, is_dir) says what is at the path now."""
    ref = reference.select(*(F.col(c).alias(f"_r_{c}") for c in ("path", "id", "time", "size", "dataId")))
    there = target.select(F.col("path").alias("_t_path"), F.col("id").alias("_t_id"), F.col("is_dir").alias("_t_dir"))
    same = F.coalesce((F.col("time") == F.col("_r_time")) & (F.col("size") == F.col("_r_size")), F.lit(False))
    joined = source.join(ref, F.col("path") == F.col("_r_path"), "left").join(there, F.col("path") == F.col("_t_path"), "left")
    new = F.when(same, "COPY REFERENCE").otherwise("CREATE")
    action = (
        F.when(F.col("_t_id").isNull(), new)
        .when(F.col("_t_dir"), F.concat(F.lit("REPLACE DIRECTORY, "), new))
        .when(same & (F.col("_t_id") == F.col("_r_id")), "KEEP")
        .when(same, "REPLACE BY REFERENCE")
        .otherwise("UPDATE")
    )
    return joined.select(*source.columns, action.alias("action"), F.when(same, F.col("_r_dataId")).alias("dataId"))


def similarity(source: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: the distinct names (name) of both listings, how many are in both, and whether the reference is close enough:
    the larger listing has at most 1.6 times the common names plus 1."""
    marked = source.select("name", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(reference.select("name", F.lit(0).alias("s"), F.lit(1).alias("r")))
    names = marked.groupBy("name").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    counted = names.agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("source_names"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("reference_names"),
        F.count(F.when((F.col("s") == 1) & (F.col("r") == 1), 1)).alias("common"),
    )
    # In tenths, so that no rounding decides.
    return counted.withColumn("accepted", F.greatest("source_names", "reference_names") * 10 <= F.col("common") * 16 + 10)


def latest_reference(entries: DataFrame, globs: list[str]) -> DataFrame:
    """The directory that a reference pattern leads to: on each level the last by name of those that match; (id, name) or none."""
    dirs = entries.where(is_live() & is_dir() & (F.col("name") != ""))
    at = entries.where(is_live() & (F.col("id") == ROOT)).select("id", "name")
    for glob in globs:
        below = dirs.join(at.select(F.col("id").alias("_up")), F.col("parentId") == F.col("_up")).where(F.col("name").rlike(glob_to_regex(glob)))
        at = below.agg(F.max(F.struct("name", "id")).alias("m")).where("m IS NOT NULL").select("m.id", "m.name")
    return at


def latest_per_parent(entries: DataFrame, glob: str) -> DataFrame:
    """For every directory its last child directory by name that matches: (parentId, id, name)."""
    dirs = entries.where(is_live() & is_dir() & (F.col("name") != "") & F.col("name").rlike(glob_to_regex(glob)))
    order = Window.partitionBy("parentId").orderBy(F.desc("name"), F.desc("id"))
    return dirs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("parentId", "id", "name")


def unread(plan: DataFrame) -> DataFrame:
    """The planned files whose bytes must be read: those that no reference stands for."""
    return plan.where("dataId IS NULL")
