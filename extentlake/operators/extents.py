"""Interval algebra over half-open extents [start, stop): overlap joins, gaps, allocation, cutting and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..model import MAX_POSITION
from ..sources.storage import written

#: Quantiles of an ordering key that bound the ranges in which prefix sums are computed, and parts of equal width of each.
QUANTILES, PARTS = 128, 32
#: Interval lengths of one level of an overlap join are up to 2^LEVEL_BITS apart.
LEVEL_BITS = 4


def _ranged(df: DataFrame, order: str, quantiles: int = QUANTILES) -> DataFrame:
    """``df`` with ``_range``, which rises with the integer column ``order``: quantiles of it, so that an outlier does not put
    all rows into one range, each cut into parts of equal width."""
    shares = [i / quantiles for i in range(quantiles + 1)]
    bounds = df.agg(F.coalesce(F.percentile_approx(order, shares, 100 * quantiles), F.array()).alias("q")).scalar()
    placed = df.withColumn("_b", F.array_distinct(bounds.cast("array<bigint>")))
    # The optimizer may compute this for rows that a join drops later, so it must not fail outside the bounds.
    at = F.size(F.filter("_b", lambda x: x <= F.col(order)))
    low, high = F.get("_b", at - 1), F.get("_b", at)
    part = F.coalesce(F.expr(f"try_divide(try_subtract(cast({order} as decimal(38,0)), _low) * {PARTS}, try_subtract(cast(_high as decimal(38,0)), _low))"), F.lit(0))
    numbered = placed.withColumn("_at", at).withColumn("_low", low).withColumn("_high", high)
    inside = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(part))).cast("long")
    return numbered.withColumn("_range", F.coalesce(F.col("_at") * PARTS + inside, F.lit(0).cast("long"))).drop("_b", "_at", "_low", "_high")


def prefix_axis(df: DataFrame, order: str, size: str, begin: str = "axis_from", end: str = "axis_to", quantiles: int = QUANTILES) -> DataFrame:
    """``df`` with the running sum of ``size`` in the order of the unique integer column ``order``: each
    row covers [begin, end) of one axis.

    Rows are summed inside ranges of ``order``; only the ranges' totals, a bounded number, meet in one task."""
    placed = _ranged(df, order, quantiles)
    totals = placed.groupBy("_range").agg(F.sum(size).alias("_total"))
    before = totals.select(
        F.col("_range").alias("_r"),
        (F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_before"),
    )
    inside = F.sum(size).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(before), F.col("_range") == F.col("_r"))
        .withColumn(end, (F.col("_before") + F.col("_inside")).cast("long"))
        .withColumn(begin, (F.col(end) - F.col(size)).cast("long"))
        .drop("_range", "_r", "_before", "_inside")
    )


def overlap_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows with equal ``on`` columns whose [l_start, l_stop) and [r_start, r_stop) overlap.

    An interval has a level by its length, at which it lies in two bins at most.  A pair meets at the higher of both levels, in the
    first bin that both are in there.  So an interval is laid into few bins however long it is: those of its own level, and
    those of the higher levels that the other side has."""

    def levelled(df: DataFrame, s: str) -> DataFrame:
        rows = df.where(F.col(f"{s}_stop") > F.col(f"{s}_start"))
        length = F.col(f"{s}_stop") - F.col(f"{s}_start")
        # The lowest level that the length fits into.
        level = F.when(length <= 1, F.lit(0))
        for at in range(LEVEL_BITS, 60, LEVEL_BITS):
            level = level.when(length <= F.lit(1 << at), F.lit(at))
        return rows.withColumn("_level", level.otherwise(F.lit(60)))

    def binned(df: DataFrame, s: str, others: DataFrame) -> tuple[DataFrame, DataFrame]:
        first, last = (F.call_function("shiftright", c, F.col("_at")) for c in (F.col(f"{s}_start"), F.col(f"{s}_stop") - 1))

        def laid(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn(f"_{s}_first", first)
            return rows.withColumn("_bin", F.explode(F.sequence(F.col(f"_{s}_first"), last))).drop("_level")

        there = others.agg(F.collect_set("_level").alias("v")).scalar()
        higher = F.explode(F.filter("_there", lambda x: x > F.col("_level")))
        return laid(df.withColumn("_at", F.col("_level"))), laid(df.withColumn("_there", there).withColumn("_at", higher).drop("_there"))

    # Both are read several times below.
    l, r = written(levelled(left, "l"), "left"), written(levelled(right, "r"), "right")
    l_home, l_visit = binned(l, "l", r)
    r_home, r_visit = binned(r, "r", l)
    met = (F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop"))
    once = F.col("_bin") == F.greatest("_l_first", "_r_first")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [*on, "_at", "_bin"]).where(met & once).drop("_at", "_bin", "_l_first", "_r_first")

    same_or_longer = joined(l_home, r_home.unionByName(r_visit))
    return same_or_longer.unionByName(joined(l_visit, r_home).select(*same_or_longer.columns))


def stored(extents: DataFrame) -> DataFrame:
    """Extents that take up storage: blacklisted contents are (0, 0)."""
    return extents.where("stop > start").select("start", "stop")


def area_starts(extents: DataFrame) -> DataFrame:
    """Starts of contiguous areas: those where no extent stops."""
    e = stored(extents)
    return e.select("start").join(e.select(F.col("stop").alias("_stop")), F.col("start") == F.col("_stop"), "left_anti").distinct()


def area_stops(extents: DataFrame) -> DataFrame:
    """Stops of contiguous areas: those where no extent starts."""
    e = stored(extents)
    return e.select("stop").join(e.select(F.col("start").alias("_start")), F.col("stop") == F.col("_start"), "left_anti").distinct()


def with_reach(extents: DataFrame) -> DataFrame:
    """``extents`` that take up storage with ``reach``: the highest stop of those before in the order of start and stop, 0 for the first.

    Running maxima are made inside ranges of the starts; only the ranges' own maxima meet in one task."""
    placed = _ranged(extents.where("stop > start"), "start")
    tops = placed.groupBy("_range").agg(F.max("stop").alias("_top"))
    before = tops.select(F.col("_range").alias("_r"), F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rest = [c for c in ("id", "seq") if c in extents.columns]
    inside = F.max("stop").over(Window.partitionBy("_range").orderBy("start", "stop", *rest).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("_inside", inside).join(F.broadcast(before), F.col("_range") == F.col("_r"))
    # The greatest of what is not null.
    return joined.withColumn("reach", F.coalesce(F.greatest("_inside", "_before"), F.lit(0)).cast("long")).drop("_range", "_r", "_before", "_inside")


def gaps(extents: DataFrame, checked: bool = True) -> DataFrame:
    """The gaps (start, stop) before and between extents: an extent that starts behind all before it ends a gap.

    Extents must not overlap.  If they do, it is an error when ``checked``; otherwise no used space counts as free."""
    reached = with_reach(extents)
    if checked:
        wrong = reached.where("start < reach").select("start", "stop", "reach").head(1)
        if wrong:
            raise ValueError(f"the extent [{wrong[0]['start']}, {wrong[0]['stop']}) overlaps one that ends at {wrong[0]['reach']}")
    return reached.where("start > reach").select(F.col("reach").alias("start"), F.col("start").alias("stop"))


def end_of_storage(extents: DataFrame) -> DataFrame:
    """One row: the highest stop, 0 without extents."""
    return extents.agg(F.coalesce(F.max("stop"), F.lit(0)).cast("long").alias("stop"))


def free_areas(extents: DataFrame, checked: bool = True) -> DataFrame:
    """The gaps and the open area behind all extents."""
    tail = end_of_storage(extents).select(F.col("stop").alias("start"), F.lit(MAX_POSITION).alias("stop"))
    return gaps(extents, checked).unionByName(tail)


def overlapping(extents: DataFrame) -> DataFrame:
    """Extents (id, seq, start, stop) that begin before an earlier one ends, with how far those reach."""
    return with_reach(extents).where("start < reach").select("id", "seq", "start", "stop", "reach")


def overlapping_pairs(extents: DataFrame) -> DataFrame:
    """Pairs (a, b) of extents that overlap."""
    e = extents.where("stop > start").withColumn("k", F.struct("id", "seq"))
    l = e.select(F.col("k").alias("a"), F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    r = e.select(F.col("k").alias("b"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return overlap_join(l, r, []).where("a < b")


def duplicate_starts(extents: DataFrame) -> DataFrame:
    """Starts of more than one extent, and of how many."""
    return stored(extents).groupBy("start").agg(F.count("*").alias("extents")).where("extents > 1")


def allocate(requests: DataFrame, free: DataFrame, order: str = "id") -> DataFrame:
    """First-fit allocation of all requests (id, size) in the order of ``order`` from the free areas (start, stop):
    (id, seq, start, stop).

    Serving requests one after the other always takes a prefix of the free list, so both sides are laid on one axis of
    running sums and joined by overlap.  The open tail is cut to what is asked for at most; requests of
    size 0 or less get nothing."""
    asked = prefix_axis(requests.where("size > 0"), order, "size", "l_start", "l_stop")
    total = requests.where("size > 0").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).scalar()
    cut = free.withColumn("size", F.least(F.col("stop") - F.col("start"), total)).drop("stop")
    given = prefix_axis(cut.where("size > 0"), "start", "size", "r_start", "r_stop").drop("size").withColumnRenamed("start", "area")
    met = overlap_join(asked, given, [])
    begin = F.col("area") + F.greatest("l_start", "r_start") - F.col("r_start")
    end = F.col("area") + F.least("l_stop", "r_stop") - F.col("r_start")
    parts = met.select("id", begin.alias("start"), end.alias("stop"))
    return parts.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("start"))).select("id", "seq", "start", "stop")


def unmet_bytes(requests: DataFrame, free: DataFrame) -> DataFrame:
    """One row: the bytes that the free areas cannot give."""
    asked = requests.where("size > 0").agg(F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0)).alias("asked"))
    given = free.agg(F.coalesce(F.sum((F.col("stop") - F.col("start")).cast("decimal(38,0)")), F.lit(0))).scalar()
    return asked.select(F.greatest(F.col("asked") - given, F.lit(0)).cast("decimal(38,0)").alias("unmet"))


def split_at(extents: DataFrame, width: int) -> DataFrame:
    """Extents cut at the multiples of ``width``; other columns stay."""
    first, last = F.expr(f"start div {width}"), F.expr(f"(stop - 1) div {width}")
    pieces = extents.where("stop > start").withColumn("_k", F.explode(F.sequence(first, last)))
    return (
        pieces.withColumn("_from", F.greatest("start", F.col("_k") * width))
        .withColumn("stop", F.least("stop", (F.col("_k") + 1) * width))
        .withColumn("start", F.col("_from"))
        .drop("_k", "_from")
    )


def subtract(extents: DataFrame, holes: DataFrame, on: list[str]) -> DataFrame:
    """What is left of ``extents`` (unique by ``on`` and start) outside the non-overlapping ``holes``."""
    keys = [*on, "start", "stop"]
    l = extents.select(*on, F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    r = holes.select(*on, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    met = overlap_join(l, r, on).select(*on, F.col("l_start").alias("start"), F.col("l_stop").alias("stop"), "r_start", "r_stop")
    # Each hole ends one remnant and begins the next; the extent's own bounds are the outermost.
    order = Window.partitionBy(*keys).orderBy("r_start")
    before = met.withColumn("_from", F.coalesce(F.lag("r_stop").over(order), F.col("start"))).select(*on, F.col("_from").alias("start"), F.col("r_start").alias("stop"))
    after = met.groupBy(*keys).agg(F.max("r_stop").alias("_from")).select(*on, F.col("_from").alias("start"), "stop")
    whole = extents.select(*keys).join(met.select(*keys).distinct(), keys, "left_anti")
    return before.unionByName(after).unionByName(whole).where("stop > start")


def truncate(extents: DataFrame, size: Column) -> DataFrame:
    """Extents up to a size."""
    return extents.where(F.col("start") < size).withColumn("stop", F.least("stop", size)).where("stop > start")


def coalesce_adjacent(extents: DataFrame, on: list[str]) -> DataFrame:
    """Extents of each ``on`` joined where they touch or overlap: (on, start, stop)."""
    order = Window.partitionBy(*on).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_reach") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        extents.where("stop > start")
        .withColumn("_reach", reach)
        .withColumn("_island", island)
        .groupBy(*on, "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_island")
    )


def logical_parts(parts: DataFrame) -> DataFrame:
    """Parts (id, seq, start, stop) with their place in the content: from, upto."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("stop") - F.col("start")
    return parts.where("stop > start").withColumn("upto", F.sum(size).over(order)).withColumn("from", F.col("upto") - size)


def read_window(parts: DataFrame, offset: int, size: int) -> DataFrame:
    """Where bytes [offset, offset+size) of each content lie: (id, at, start, stop), ``at`` in the window.
    Reads beyond the end give nothing."""
    p = logical_parts(parts).where((F.col("from") < offset + size) & (F.col("upto") > offset))
    lo, hi = F.greatest("from", F.lit(offset)), F.least("upto", F.lit(offset + size))
    return p.select(
        "id",
        (lo - offset).cast("long").alias("at"),
        (F.col("start") + lo - F.col("from")).cast("long").alias("start"),
        (F.col("start") + hi - F.col("from")).cast("long").alias("stop"),
    )


def holes_in_window(extents: DataFrame, on: list[str], begin: int, end: int) -> DataFrame:
    """A read of [begin, end): data and holes in order, (on, start, stop, is_hole).  Extents do not overlap; a key
    without any extent in the window has one hole."""
    data = extents.where((F.col("start") < end) & (F.col("stop") > begin)).select(
        *on, F.greatest("start", F.lit(begin)).cast("long").alias("start"), F.least("stop", F.lit(end)).cast("long").alias("stop")
    )
    order = Window.partitionBy(*on).orderBy("start")
    left = data.select(*on, F.coalesce(F.lag("stop").over(order), F.lit(begin)).cast("long").alias("_s"), F.col("start").alias("stop")).withColumnRenamed("_s", "start")
    # Behind the last extent in the window; of keys without one, the whole window.
    seen = F.max(F.when((F.col("start") < end) & (F.col("stop") > begin), F.least("stop", F.lit(end))))
    right = extents.groupBy(*on).agg(F.coalesce(seen, F.lit(begin)).cast("long").alias("start")).withColumn("stop", F.lit(end).cast("long"))
    holes = left.unionByName(right).where("stop > start").withColumn("is_hole", F.lit(True))
    return data.withColumn("is_hole", F.lit(False)).unionByName(holes)
