"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is encoded as the rank file's library does it: the pattern cuts the text into pre-tokens from
left to right, and each pre-token's bytes are merged by rank.

A long text is cut into chunks that overlap, and the chunks are pre-tokenised in parallel.  A chunk
that starts inside a pre-token gets its first cuts wrong, but soon falls into step with the cuts of
the chunk before.  Chunk k's cuts are certain from its first *hard* cut on: between two characters
of different classes of which the first is not white space, no match can reach across, whatever came
before (an apostrophe before a letter excepted, for contractions).  Where a certain cut of chunk k is
also a cut of chunk k+1, both go on alike, since a match depends only on what follows it.  The two are
stitched at the first such place behind a non-space character.  If the overlap has none - a word
longer than the overlap - the two chunks stay together as one piece, so the result is always exact.
The pieces between stitches are then encoded in parallel and their ids put one behind the other.

Texts of up to ``PARALLEL`` code points are cut, stitched and encoded in the task they are in, without a shuffle; only the chunks of
longer ones, which are larger, go to different tasks.  Texts of up to one chunk are one piece.  Decoding looks
up each id's bytes and concatenates them; only whole texts are valid UTF-8, so bytes are returned.

Null texts encode to no ids, as empty ones; an empty table gives an empty one.  Row keys may repeat or be null.  A very long text
without any place to stitch is one piece, and so one cell.  Columns named like the added one are replaced.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_rows

#: Code points of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 11, 1 << 8
#: Code points of the texts whose chunks go to different tasks, and of those chunks and their overlap.
PARALLEL, FAR_OVERLAP = 1 << 16, 1 << 10
#: Code points before a chunk's end in which a cut may still change with what follows.
_MARGIN = 4
#: A character after which a cut is certain whatever came before: its class differs from the next one's.
_HARD = r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|[^\s\p{L}\p{N}](?=[\s\p{N}])|[^\s\p{L}\p{N}'](?=\p{L})"


class Vocabulary:
    """The ranks of a vocabulary file and the pattern that goes with them."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.hard = regex.compile(_HARD)
        self.space = regex.compile(r"\s")
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def pieces(self, text: str, chunk: int, overlap: int) -> list[str]:
        """The text in pieces that are encoded each by itself: its chunks, stitched."""
        begin, before, out = 0, set(), []
        for start in range(0, max(0, len(text) - overlap - 1) + 1, chunk):
            part = text[start : start + chunk + overlap]
            head, tail = self.ends(part, start, len(text), chunk, overlap)
            joint = min(before.intersection(head), default=None)
            if joint is not None:
                out.append(text[begin:joint])
                begin = joint
            before = set(tail)
        return [*out, text[begin:]]

    def ends(self, part: str, start: int, size: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
        """A chunk's cuts in its overlap with the chunk before, and the certain ones in that with the chunk behind."""
        found, certain = self.cuts(part, start, start + len(part) >= size)
        return [b for b in found if b < start + overlap], [b for b in found if b >= max(certain, start + chunk)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def cuts(self, text: str, start: int, last: bool) -> tuple[list[int], int]:
        """The places behind a non-space character where a chunk's matches start, counted from the text's
        start at ``start``, and the first from which they are certain."""
        end = len(text) if last else len(text) - _MARGIN
        found = [
            start + m.start()
            for m in self.pattern.finditer(text)
            if 0 < m.start() <= end and not self.space.match(text, m.start() - 1)
        ]
        hard = self.hard.search(text)
        certain = 0 if start == 0 else start + hard.end() if hard else start + len(text) + 1
        return found, certain


@functools.lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    return Vocabulary(ranks_path, pattern)


def _ids(values: list[int]) -> bytes:
    return np.array(values, dtype="<u4").tobytes()


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    text: str = "text",
    ids: str = "ids",
    keep_text: bool = True,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    parallel: int = PARALLEL,
    far_overlap: int = FAR_OVERLAP,
) -> DataFrame:
    """``df`` with a binary column ``ids``: the token ids as little-endian unsigned 32-bit integers.
    The text itself is only carried on if ``keep_text``.

    ``ranks_path`` must be readable on every executor, as part of its Python installation is.
    """
    if not (2 * _MARGIN < overlap < chunk and 2 * _MARGIN < far_overlap < parallel):
        raise ValueError("the overlap must be shorter than a chunk")
    df = df.drop(ids)
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if keep_text or i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(ids, T.BinaryType())])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(ranks_path, pattern)
        texts = batch.column(at).to_pylist()
        values = [b"".join(_ids(vocab.encode(x)) for x in vocab.pieces(t, chunk, overlap)) if t else b"" for t in texts]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(values, pa.binary())],
            names=[*(batch.schema.names[i] for i in kept), ids],
        )

    size = F.coalesce(F.length(text), F.lit(0))
    short = map_rows(df.where(size <= parallel), schema, whole)
    long = _encode_long(df.where(size > parallel), ranks_path, pattern, text, ids, parallel, far_overlap)
    return short.unionByName(long.select(*short.columns))


def _encode_long(
    df: DataFrame, ranks_path: str, pattern: str, text: str, ids: str, chunk: int, overlap: int
) -> DataFrame:
    row = fresh(df, "row_hash")
    # Repeated rows have equal keys and equal ids, so they can share one encoding of their text.
    keyed = df.withColumn(row, F.sha2(F.col(text), 256))
    texts = keyed.select(F.col(row).alias("row"), F.col(text).alias("text")).dropDuplicates(["row"])
    chunks = texts.select(
        "row",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(chunk)),
                lambda s: F.struct(s.alias("start"), F.substring(F.col("text"), s + 1, F.lit(chunk + overlap)).alias("part")),
            )
        ).alias("k", "c"),
        F.length("text").alias("size"),
    ).select("row", "k", "c.start", "c.part", "size")
    # One text's chunks go to different tasks.
    chunks = chunks.repartition(F.col("row"), F.col("k"))

    cut_schema = "row string, k int, start int, part string, size int, head array<int>, tail array<int>"

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(ranks_path, pattern)
        heads, tails = [], []
        for start, part, size in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            head, tail = vocab.ends(part, start, size, chunk, overlap)
            heads.append(head)
            tails.append(tail)
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(heads, kind), pa.array(tails, kind)],
            names=["row", "k", "start", "part", "size", "head", "tail"],
        )

    cuts = map_rows(chunks, cut_schema, cut)
    # A chunk starts a piece where it falls into step with the one before; else it goes on with that one's piece.
    order = Window.partitionBy("row").orderBy("k")
    joint = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    placed = cuts.withColumn("joint", F.when(F.col("k") == 0, 0).otherwise(joint)).withColumn(
        "piece", F.max(F.when(F.col("joint").isNotNull(), F.col("k"))).over(order)
    )
    pieces = (
        placed.groupBy("row", "piece")
        .agg(
            F.max("joint").alias("begin"),
            F.max(F.col("start") + F.length("part")).alias("reach"),
            F.array_sort(F.collect_list(F.struct("k", "start", "part"))).alias("parts"),
        )
        .withColumn("end", F.lead("begin").over(Window.partitionBy("row").orderBy("piece")))
        .select(
            "row",
            "piece",
            # Each part without what the next one repeats, from the piece's begin to the next piece's.
            F.expr(
                f"substring(concat_ws('', transform(parts, (p, i) -> if(i < size(parts) - 1, substring(p.part, 1, {chunk}), p.part))),"
                " begin - parts[0].start + 1, coalesce(end, reach) - begin)"
            ).alias("part"),
        )
        .repartition(F.col("row"), F.col("piece"))
    )

    def encode_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(ranks_path, pattern)
        values = [_ids(vocab.encode(t)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(values, pa.binary())], names=["row", "piece", "ids"]
        )

    encoded = (
        map_rows(pieces, "row string, piece int, ids binary", encode_pieces)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
        .select(
            "row",
            F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias(ids),
        )
    )
    return keyed.join(encoded, keyed[row] == encoded["row"]).select(*(keyed[c] for c in df.columns), encoded[ids])


def decode(df: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that the ids stand for."""
    df = df.drop(out)
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(ranks_path, pattern)
        values = [vocab.decode(np.frombuffer(v or b"", dtype="<u4")) for v in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, out]
        )

    return map_rows(df, schema, run)
