"""File-operation logs: open counts, write sessions and overlays, as batch queries and as a stream.

An operation is (file_id, op_seq, op, pos, size): OPEN, WRITE at ``pos`` of ``size`` bytes, TRUNCATE to ``pos``, RELEASE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import MAX_POSITION
from ..operators.extents import coalesce_adjacent, overlap_join, subtract

_SO_FAR = (Window.unboundedPreceding, 0)


def _by_file() -> Window:
    return Window.partitionBy("file_id").orderBy("op_seq")


def handle_counts(ops: DataFrame) -> DataFrame:
    """``ops`` with ``handles``: open handles after each operation.  Releasing what is not open changes nothing."""
    delta = F.when(F.col("op") == "OPEN", 1).when(F.col("op") == "RELEASE", -1).otherwise(0)
    summed = ops.withColumn("_s", F.sum(delta).over(_by_file().rowsBetween(*_SO_FAR)))
    lowest = F.min("_s").over(_by_file().rowsBetween(*_SO_FAR))
    return summed.withColumn("handles", (F.col("_s") - F.least(F.lit(0), lowest)).cast("long")).drop("_s")


def sized(ops: DataFrame) -> DataFrame:
    """``ops`` with ``handles``, ``valid`` (writes and truncations of open files) and ``file_size`` after each operation.

    The size is that of the last valid truncation, or 0, or the furthest end of a valid write since."""
    counted = handle_counts(ops)
    change = F.col("op").isin("WRITE", "TRUNCATE")
    before = F.coalesce(F.lag("handles").over(_by_file()), F.lit(0))
    marked = counted.withColumn("valid", change & (before > 0))
    cut = F.col("valid") & (F.col("op") == "TRUNCATE")
    grouped = marked.withColumn("_cuts", F.sum(F.when(cut, 1).otherwise(0)).over(_by_file().rowsBetween(*_SO_FAR)))
    reach = F.when(cut, F.col("pos")).when(F.col("valid"), F.col("pos") + F.col("size")).otherwise(F.lit(0))
    since = Window.partitionBy("file_id", "_cuts").orderBy("op_seq").rowsBetween(*_SO_FAR)
    return grouped.withColumn("file_size", F.greatest(F.max(reach).over(since), F.lit(0)).cast("long")).drop("_cuts")


def persist_queue(ops: DataFrame) -> DataFrame:
    """(file_id, op_seq, file_size) of every release that closes a file which was changed since it was opened."""
    rows = sized(ops)
    before = F.coalesce(F.lag("handles").over(_by_file()), F.lit(0))
    marked = rows.withColumn("closes", (F.col("op") == "RELEASE") & (before == 1))
    earlier = F.sum(F.when(F.col("closes"), 1).otherwise(0)).over(_by_file().rowsBetween(Window.unboundedPreceding, -1))
    sessions = marked.withColumn("_session", F.coalesce(earlier, F.lit(0)))
    changed = F.max(F.when(F.col("valid"), 1).otherwise(0)).over(Window.partitionBy("file_id", "_session"))
    return sessions.withColumn("_changed", changed).where("closes AND _changed = 1").select("file_id", "op_seq", "file_size")


def effective_writes(ops: DataFrame) -> DataFrame:
    """(file_id, op_seq, start, stop): what later truncations leave of each write."""
    later = _by_file().rowsBetween(1, Window.unboundedFollowing)
    cut = F.min(F.when(F.col("op") == "TRUNCATE", F.col("pos"))).over(later)
    stop = F.least(F.col("pos") + F.col("size"), F.coalesce(F.col("_cut"), F.col("pos") + F.col("size")))
    return ops.withColumn("_cut", cut).where("op = 'WRITE'").select("file_id", "op_seq", F.col("pos").alias("start"), stop.alias("stop")).where("stop > start")


def overlay(ops: DataFrame) -> DataFrame:
    """(file_id, start, stop, op_seq): which write each byte of a file shows in the end, as maximal runs between write bounds."""
    writes = effective_writes(ops)
    bounds = writes.select("file_id", F.explode(F.array("start", "stop")).alias("start")).distinct()
    pieces = bounds.withColumn("stop", F.lead("start").over(Window.partitionBy("file_id").orderBy("start"))).where("stop IS NOT NULL")
    l = pieces.select("file_id", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    r = writes.select("file_id", "op_seq", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    met = overlap_join(l, r, ["file_id"])
    return met.groupBy("file_id", F.col("l_start").alias("start"), F.col("l_stop").alias("stop")).agg(F.max("op_seq").alias("op_seq"))


def overlay_bytes(ops: DataFrame, payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_id, pos, bytes): what a reader of each file sees, in pieces: of each byte the last valid write that it shows (payloads: file_id,
    op_seq, bytes), else what is stored (file_id, pos, bytes; pieces that do not overlap), up to the visible size.  What neither has is zeros, which
    ``content.filled`` adds."""
    ops = sized(ops).where("valid").select("file_id", "op_seq", "op", "pos", "size")
    shown = overlay(ops)
    begun = effective_writes(ops).select("file_id", "op_seq", F.col("start").alias("_begin"))
    at = shown.join(begun, ["file_id", "op_seq"]).join(payloads.select("file_id", "op_seq", "bytes"), ["file_id", "op_seq"])
    cut = F.substring(F.col("bytes"), (F.col("start") - F.col("_begin") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    written_bytes = at.select("file_id", F.col("start").alias("pos"), cut.alias("bytes"))
    # A truncation cuts what was stored before it, even where the file grows again.
    lowest = ops.where("op = 'TRUNCATE'").groupBy("file_id").agg(F.min("pos").alias("_cut"))
    kept = stored.join(lowest, "file_id", "left").withColumn("_end", F.least(F.col("pos") + F.octet_length("bytes"), F.coalesce("_cut", F.lit(MAX_POSITION))))
    under = kept.where("_end > pos").select("file_id", F.col("pos").alias("start"), F.col("_end").alias("stop"))
    holes = coalesce_adjacent(shown.select("file_id", "start", "stop"), ["file_id"])
    left = subtract(under, holes, ["file_id"])
    # Each remnant lies in one stored piece.
    l = left.select("file_id", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    r = stored.select("file_id", F.col("pos").alias("r_start"), (F.col("pos") + F.octet_length("bytes")).alias("r_stop"))
    places = overlap_join(l, r, ["file_id"]).select("file_id", F.col("l_start").alias("start"), F.col("l_stop").alias("stop"), F.col("r_start").alias("_pos"))
    own = stored.select(F.col("file_id").alias("_f"), F.col("pos").alias("_p"), "bytes")
    rest = places.join(own, (F.col("file_id") == F.col("_f")) & (F.col("_pos") == F.col("_p")))
    part = F.substring(F.col("bytes"), (F.col("start") - F.col("_pos") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return written_bytes.unionByName(rest.select("file_id", F.col("start").alias("pos"), part.alias("bytes")))


def visible_sizes(ops: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_id, size): the size that a reader sees: the open or unpersisted state's, else the stored one (file_id, size)."""
    last = sized(ops).groupBy("file_id").agg(F.max_by("file_size", "op_seq").alias("_now"), F.max(F.col("valid").cast("int")).alias("_changed"))
    both = stored.join(last, "file_id", "full")
    return both.select("file_id", F.when(F.col("_changed") == 1, F.col("_now")).otherwise(F.coalesce("size", F.lit(0))).alias("size"))


_STATE = "handles long, size long, changed boolean"
_CLOSED = "file_id long, op_seq long, file_size long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One file's new operations; emits its closings."""
    handles, size, changed = state.get if state.exists else (0, 0, False)
    # Batches of one trigger come in any order.
    ops = pd.concat(list(batches)).sort_values("op_seq")
    closed = []
    for seq, op, pos, n in zip(ops["op_seq"], ops["op"], ops["pos"], ops["size"]):
        if op == "OPEN":
            handles += 1
        elif op == "WRITE" and handles:
            size, changed = max(size, pos + n), True
        elif op == "TRUNCATE" and handles:
            size, changed = max(pos, 0), True
        elif op == "RELEASE" and handles:
            handles -= 1
            if not handles and changed:
                closed.append((key[0], seq, size))
                changed = False
    state.update((int(handles), int(size), bool(changed)))
    yield pd.DataFrame(closed, columns=["file_id", "op_seq", "file_size"])


def persist_stream(ops: DataFrame) -> DataFrame:
    """``persist_queue`` of a stream of operations that arrive in the order of op_seq, trigger by trigger."""
    rows = ops.select("file_id", "op_seq", "op", "pos", "size")
    return rows.groupBy("file_id").applyInPandasWithState(_fold, _CLOSED, _STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there into Parquet files, and stop."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
