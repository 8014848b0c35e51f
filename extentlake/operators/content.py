"""Content: chunks, digests, deduplication, storage parts, assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHUNK_BYTES, FILE_BYTES
from ..model import address_file_column as address_to_file
from .extents import overlap_join, prefix_axis, split_at


def chunked(files: DataFrame, data: str = "data", size: int = CHUNK_BYTES) -> DataFrame:
    """(id, pos, bytes): binary contents cut into chunks."""
    begin = F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(size)))
    rows = files.where(F.octet_length(data) > 0).select("id", F.col(data).alias("_data"), begin.alias("pos"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.substring(F.col("_data"), F.col("pos") + 1, F.lit(size)).alias("bytes"))


def digests(chunks: DataFrame) -> DataFrame:
    """(id, hash, length) of contents that fit into one cell: the MD5 of the chunks in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "bytes")))
    return chunks.groupBy("id").agg(ordered.alias("_c")).select(
        "id",
        F.md5(F.aggregate("_c", F.lit(b""), lambda a, c: F.concat(a, c["bytes"]))).alias("hash"),
        F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["bytes"])).alias("length"),
    )


def large_digests(chunks: DataFrame) -> DataFrame:
    """(id, hash, length) of contents of any size: chunks are sorted inside partitions and hashed as they
    stream by, so that no content is ever whole in memory."""
    ordered = chunks.select("id", "pos", "bytes").repartition("id").sortWithinPartitions("id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, length = None, None, 0

        def closed() -> pa.RecordBatch:
            columns = [pa.array([current], pa.int64()), pa.array([digest.hexdigest()]), pa.array([length], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "length"])

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is None or i != current:
                    if digest is not None:
                        yield closed()
                    current, digest, length = i, hashlib.md5(), 0
                digest.update(data)
                length += len(data)
        if digest is not None:
            yield closed()

    return ordered.mapInArrow(run, "id long, hash string, length long")


def deduplicated(incoming: DataFrame, known: DataFrame, first_id: int) -> DataFrame:
    """``incoming`` (file, hash, length) with ``dataId`` and ``action``.

    Contents equal in (hash, length) to a known one (id, hash, length; the least id if several) are linked.  The rest is stored
    once for each (hash, length), with ids from ``first_id`` in the order of the least file."""
    # Copies collapse before anything is joined, so a frequent content is one row.
    wanted = incoming.groupBy("hash", "length").agg(F.min("file").alias("_first"))
    probe = known.groupBy("hash", "length").agg(F.min("id").alias("_known"))
    probed = wanted.join(probe, ["hash", "length"], "left")
    misses = probed.where("_known IS NULL").withColumn("one", F.lit(1).cast("long"))
    numbered = prefix_axis(misses, "_first", "one", "_n", "_to").select("hash", "length", (F.col("_n") + first_id).alias("_new"))
    ids = probed.join(numbered, ["hash", "length"], "left").select("hash", "length", "_first", "_known", F.coalesce("_known", "_new").alias("dataId"))
    action = (
        F.when(F.col("length") == 0, "empty").when(F.col("_known").isNotNull(), "link").when(F.col("file") == F.col("_first"), "store").otherwise("link")
    )
    return incoming.join(ids, ["hash", "length"]).withColumn("action", action).drop("_first", "_known")


def layout(contents: DataFrame, start: int = 0) -> DataFrame:
    """``contents`` (id, length, ...) back to back from ``start`` in the order of their ids, with start and stop."""
    placed = prefix_axis(contents, "id", "length", "start", "stop")
    return placed.withColumn("start", F.col("start") + start).withColumn("stop", F.col("stop") + start)


def multipart(placed: DataFrame, size: int) -> DataFrame:
    """Contents (id, length, start, stop, hash) in parts of ``size`` bytes, numbered from 1; length and hash only with the first."""
    at = F.posexplode(F.sequence(F.col("start"), F.greatest(F.col("stop") - 1, F.col("start")), F.lit(size)))
    parts = placed.select("id", "length", "hash", F.col("stop").alias("_stop"), at.alias("_k", "start"))
    first = F.col("_k") == 0
    return parts.select(
        "id",
        (F.col("_k") + 1).alias("seq"),
        F.when(first, F.col("length")).alias("length"),
        "start",
        F.least(F.col("start") + size, "_stop").alias("stop"),
        F.when(first, F.col("hash")).alias("hash"),
    )


def file_pieces(placed: DataFrame, size: int = FILE_BYTES) -> DataFrame:
    """Extents cut at the boundaries of the store's files: file, offset in the file and bytes."""
    return split_at(placed, size).select(
        "id", address_to_file(F.col("start"), size).alias("file"), (F.col("start") % size).alias("offset"), (F.col("stop") - F.col("start")).alias("bytes")
    )


def to_areas(chunks: DataFrame, areas: DataFrame) -> DataFrame:
    """Where the bytes of contents (id, pos, bytes) go in their reserved areas (id, seq, start, stop): (id, start, bytes)."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    axis = areas.withColumn("r_stop", F.sum(F.col("stop") - F.col("start")).over(order)).withColumn("r_start", F.col("r_stop") - (F.col("stop") - F.col("start")))
    data = chunks.select("id", F.col("pos").alias("l_start"), (F.col("pos") + F.octet_length("bytes")).alias("l_stop"))
    # Only places are joined by overlap; the bytes come last.
    met = overlap_join(data, axis.select("id", "r_start", "r_stop", "start"), ["id"])
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_stop", "r_stop")
    cut = met.select(
        F.col("id").alias("_id"),
        F.col("l_start").alias("_pos"),
        (F.col("start") + lo - F.col("r_start")).alias("start"),
        (lo - F.col("l_start") + 1).cast("int").alias("_at"),
        (hi - lo).cast("int").alias("_n"),
    )
    joined = chunks.join(cut, (F.col("id") == F.col("_id")) & (F.col("pos") == F.col("_pos")))
    return joined.select("id", "start", F.substring(F.col("bytes"), F.col("_at"), F.col("_n")).alias("bytes"))


def unfitting(chunks: DataFrame, areas: DataFrame) -> DataFrame:
    """Contents whose data and areas differ in size: (id, data_bytes, area_bytes).  Both are errors of a write."""
    data = chunks.groupBy("id").agg(F.sum(F.octet_length("bytes")).cast("long").alias("data_bytes"))
    room = areas.groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("area_bytes"))
    both = data.join(room, "id", "full").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("data_bytes", "area_bytes")))
    return both.where("data_bytes <> area_bytes")


def read_contents(parts: DataFrame, store: DataFrame) -> DataFrame:
    """(id, pos, bytes): the bytes of contents' parts (id, seq, start, stop) from a store (start, bytes), in pieces.  What the
    store has not is missing here; ``filled`` puts zeros in its place.  If the store says whose bytes it has (id),
    only a content's own count: space that was given out again may still hold older ones."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("stop") - F.col("start")
    wanted = parts.where("stop > start").withColumn("_upto", F.sum(size).over(order)).select(
        "id", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"), (F.col("_upto") - size).alias("_pos")
    )
    own = ["id"] if "id" in store.columns else []
    held = store.select(*own, F.col("start").alias("r_start"), (F.col("start") + F.octet_length("bytes")).alias("r_stop"))
    # Only places are joined by overlap; the bytes come last.
    met = overlap_join(wanted, held, own)
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_stop", "r_stop")
    cut = met.select(
        "id",
        (F.col("_pos") + lo - F.col("l_start")).alias("pos"),
        F.col("r_start").alias("_start"),
        (lo - F.col("r_start") + 1).cast("int").alias("_at"),
        (hi - lo).cast("int").alias("_n"),
    )
    pieces = store.select(*(F.col(c).alias(f"_own_{c}") for c in own), F.col("start").alias("_held"), "bytes")
    same = F.col("_start") == F.col("_held")
    for c in own:
        same = same & (F.col(c) == F.col(f"_own_{c}"))
    return cut.join(pieces, same).select("id", "pos", F.substring(F.col("bytes"), F.col("_at"), F.col("_n")).alias("bytes"))


def filled(pieces: DataFrame, lengths: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(id, pos, bytes): non-overlapping pieces of the contents in (id, length), with chunks of zeros where they have none, so
    that all of a content is there in pieces, however long it is."""
    spans = pieces.select("id", F.col("pos").alias("start"), (F.col("pos") + F.octet_length("bytes")).alias("stop"))
    order = Window.partitionBy("id").orderBy("start")
    before = spans.select("id", F.coalesce(F.lag("stop").over(order), F.lit(0)).cast("long").alias("begin"), F.col("start").alias("end"))
    ends = spans.groupBy("id").agg(F.max("stop").alias("_last"))
    behind = lengths.join(ends, "id", "left").select("id", F.coalesce("_last", F.lit(0)).cast("long").alias("begin"), F.col("length").alias("end"))
    empty = before.unionByName(behind).where("end > begin")
    cut = empty.select("id", "end", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(size).cast("long"))).alias("pos"))
    zeros = F.unhex(F.repeat(F.lit("00"), F.least(F.lit(size), F.col("end") - F.col("pos")).cast("int")))
    return pieces.select("id", "pos", "bytes").unionByName(cut.select("id", "pos", zeros.alias("bytes")))


def assemble(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, data): contents of (id, length) put together from non-overlapping (id, pos, bytes), zeros between.  A content is one
    cell, so this is for those of less than 2 GiB; ``filled`` and ``export.write_files`` are for all."""
    gathered = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("_p"))
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
    joined = lengths.join(gathered, "id", "left")
    filled = F.aggregate(
        F.coalesce("_p", F.array().cast("array<struct<pos:bigint,bytes:binary>>")),
        F.lit(b""),
        lambda a, p: F.concat(a, zeros(p["pos"] - F.octet_length(a)), p["bytes"]),
    )
    return joined.withColumn("_data", filled).select("id", F.concat("_data", zeros(F.greatest(F.col("length") - F.octet_length("_data"), F.lit(0)))).alias("data"))
