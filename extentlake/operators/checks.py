"""Constraints and invariants as queries of violations: each must return no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FORBIDDEN_IN_NAMES, NAME_LIMIT, is_dir, is_live
from .extents import overlapping_pairs
from .tree import ROOT


def _named(rule: str, rows: DataFrame, key: F.Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _repeated(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).count().where("count > 1")


def tree_violations(entries: DataFrame) -> DataFrame:
    """(rule, key) for ids, sibling names, parents, names and liveness."""
    parents = entries.select(F.col("id").alias("_p"), is_dir().alias("_dir"), is_live().alias("_live")).dropDuplicates(["_p"])
    linked = entries.join(parents, F.col("parentId") == F.col("_p"), "left")
    bad_name = ~((F.col("name") != "") & ~F.col("name").rlike(FORBIDDEN_IN_NAMES) & (F.length("name") <= NAME_LIMIT))
    found = [
        _named("unique id", _repeated(entries, ["id"]), F.col("id")),
        _named("unique sibling name", _repeated(entries, ["parentId", "name", "deleted"]), F.concat_ws("/", "parentId", "name", "deleted")),
        _named("parent exists", linked.where("_p IS NULL"), F.col("id")),
        _named("parent is a directory", linked.where(~F.col("_dir")), F.col("id")),
        _named("live below live", linked.where(is_live() & ~F.col("_live")), F.col("id")),
        _named("valid name", entries.where((F.col("id") != ROOT) & bad_name), F.col("id")),
        _named("only the root is its own parent", entries.where((F.col("id") == F.col("parentId")) & (F.col("id") != ROOT)), F.col("id")),
    ]
    return reduce(DataFrame.unionByName, found)


def data_violations(contents: DataFrame) -> DataFrame:
    """(rule, key) for parts, their bounds, sizes and overlaps."""
    sums = contents.groupBy("id").agg(
        F.max("length").alias("length"), F.sum(F.col("stop") - F.col("start")).alias("stored"), F.count("*").alias("parts"), F.max("seq").alias("last")
    )
    length, digest = F.col("length").isNotNull(), F.col("hash").isNotNull()
    misplaced = F.when(F.col("seq") == 1, ~(length & digest)).otherwise(length | digest)
    pairs = overlapping_pairs(contents)
    found = [
        _named("unique part", _repeated(contents, ["id", "seq"]), F.concat_ws("/", "id", "seq")),
        _named("part bounds", contents.where("start < 0 OR stop < start"), F.concat_ws("/", "id", "seq")),
        _named("length and hash with the first part only", contents.where(misplaced), F.concat_ws("/", "id", "seq")),
        _named("stored size", sums.where("stored > 0 AND stored <> length"), F.col("id")),
        _named("parts without gaps in their numbers", sums.where("parts <> last"), F.col("id")),
        _named("no overlap", pairs, F.concat_ws("/", "a.id", "a.seq", "b.id", "b.seq")),
    ]
    return reduce(DataFrame.unionByName, found)


def ensure(violations: DataFrame, suppressed: set[str] = frozenset(), shown: int = 100) -> None:
    """Raise if there are violations of rules that are not suppressed, and name the first ones."""
    rows = violations.where(~F.col("rule").isin(*suppressed)) if suppressed else violations
    first = rows.limit(shown).collect()
    if first:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in first))
