"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and longer paragraphs into passages at content-defined
places, after words whose hash says so, so that an edit only changes the passages it touches.  The
set of the passages' 64-bit digests is hashed into cells; each digest goes to ``HASHES`` cells, which
add up a count, the digests and their check values.  Two texts' sketches subtract cell by cell; what
both have cancels out.  A cell with one digest left gives it away, it is taken out of its other
cells, and so on: peeling recovers the digests that differ, and on which side.

A fingerprint is the sketch of ``CELLS`` cells with the number of digests, so equal texts have equal
fingerprints.  If peeling fails since too much differs, both texts are sketched again with
``GROWTH`` times the cells, as often as it takes.  The likeness of two texts is the
Jaccard similarity of their digest sets, from the sizes and the recovered differences.

Null and empty texts have no digests; two of them have likeness 1.  Rows with equal keys, and those with null keys, which come
last, follow each other by the hashes of their texts; repeated rows are ties, in any order.  A very long text is one cell, and
its sketches grow with it.  An empty table gives an empty result; of a single row the next one is itself.  Only key and text
are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Cells of a fingerprint's sketch.
CELLS = 24
#: Cells that each digest goes to.
HASHES = 3
#: Factor by which a sketch grows when peeling fails.
GROWTH = 4
#: Ranges of keys whose bounds are read by the driver, at most.
RANGES = 256
#: Words of a passage on average.
PASSAGE = 4

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, kept for the worker's life up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


_hashes = _Hashes()


def digests(text: str | None) -> np.ndarray:
    """The sorted distinct digests of a text's passages."""
    words, ends = [], []
    for line in (text or "").split("\n"):
        own = line.split()
        if own:
            words += own
            ends.append(len(words) - 1)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    last = (h >> np.uint64(40)) % np.uint64(PASSAGE) == 0
    last[ends] = True
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    # Each word counts with its place in the passage.
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return np.unique(mix(np.add.reduceat(mix(h + place.astype(np.uint64) * _M1), starts)))


class Sketches:
    """Sketches of several texts side by side; text i has ``cells[i]`` cells."""

    def __init__(self, sets: list[np.ndarray], cells: np.ndarray) -> None:
        self.cells = cells.astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.cells)))
        self.count = np.zeros(self.at[-1], np.int64)
        self.sum = np.zeros(self.at[-1], np.uint64)
        self.check = np.zeros(self.at[-1], np.uint64)
        if sets:
            self.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))

    def places(self, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The HASHES cells of each value: one in each third of its owner's sketch."""
        third = (self.cells[owner] // HASHES).astype(np.uint64)
        return np.stack(
            [self.at[owner] + ((mix(values + np.uint64((k + 1) * int(_M1) % (1 << 64))) % third) + np.uint64(k) * third).astype(np.int64) for k in range(HASHES)]
        )

    def add(self, owner: np.ndarray, values: np.ndarray, sign: np.ndarray | int = 1) -> None:
        one = np.broadcast_to(np.asarray(sign, np.int64), values.shape)
        wrap = one.astype(np.uint64)
        for place in self.places(owner, values):
            np.add.at(self.count, place, one)
            np.add.at(self.sum, place, values * wrap)
            np.add.at(self.check, place, mix(values ^ _M1) * wrap)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches([], self.cells)
        out.count, out.sum, out.check = self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and side (+1, -1) of all that can be recovered; the cells are used up."""
        owners, values, sides = [], [], []
        of_cell = np.repeat(np.arange(len(self.cells)), self.cells)
        candidates = np.arange(len(self.count))
        while len(candidates):
            c = candidates[np.abs(self.count[candidates]) == 1]
            side = self.count[c]
            value = self.sum[c] * side.astype(np.uint64)
            pure = self.check[c] == mix(value ^ _M1) * side.astype(np.uint64)
            c, side, value = c[pure], side[pure], value[pure]
            if not len(c):
                break
            # A digest may be alone in several cells at once.
            owner = of_cell[c]
            _, first = np.unique(np.stack([owner.astype(np.uint64), value]), axis=1, return_index=True)
            owner, value, side = owner[first], value[first], side[first]
            places = self.places(owner, value)
            # A stray match of the check value may name a digest that has no place in its cell.
            self.add(owner, value, -side)
            owners.append(owner)
            values.append(value)
            sides.append(side)
            candidates = np.unique(places)
        empty = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x or e) for x, e in zip((owners, values, sides), empty))

    def clean(self) -> np.ndarray:
        """Which sketches are empty."""
        dirty = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        return np.add.reduceat(dirty, self.at[:-1]) == 0 if len(self.cells) else np.zeros(0, bool)

    def text(self, i: int, size: int) -> str:
        """Sketch i as a fingerprint: the digests' number and the cells."""
        own = slice(self.at[i], self.at[i + 1])
        raw = self.count[own].astype("<i4").tobytes() + self.sum[own].astype("<u8").tobytes() + self.check[own].astype("<u8").tobytes()
        return f"{size}:{base64.b85encode(raw).decode()}"


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The fingerprints of some texts' digests."""
    sketches = Sketches(sets, np.full(len(sets), cells))
    return [sketches.text(i, len(s)) for i, s in enumerate(sets)]


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of texts the digests that only the first and only the second has."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(a)
    # Cells enough for a difference of everything come before more than those.
    sizes = np.full(len(a), cells)
    full = 2 * HASHES * np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) + cells
    todo = np.arange(len(a))
    none = np.zeros(0, np.uint64)
    while len(todo):
        own = sizes[todo] // HASHES * HASHES
        rest = Sketches([a[i] for i in todo], own).minus(Sketches([b[i] for i in todo], own))
        owner, value, side = rest.peel()
        clean = rest.clean()
        order = np.argsort(owner, kind="stable")
        owner, value, side = owner[order], value[order], side[order]
        bounds = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(clean):
            v, s = value[bounds[k] : bounds[k + 1]], side[bounds[k] : bounds[k + 1]]
            out[todo[k]] = (np.sort(v[s > 0]), np.sort(v[s < 0])) if len(v) else (none, none)
        todo = todo[~clean]
        below = sizes[todo] < full[todo]
        sizes[todo] = np.where(below, np.minimum(sizes[todo] * GROWTH, full[todo]), sizes[todo] * GROWTH)
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """The Jaccard similarity of each pair, from what peeling recovers."""
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b)):
        common = len(x) - len(only_x)
        union = common + len(only_x) + len(only_y)
        out.append(common / union if union else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _buckets(rows: DataFrame, count: int) -> Column:
    """The bucket of a row (key, tie): buckets follow each other in rising order of both, nulls first.

    Ranges of equal numbers of rows come from quantiles of the key; in a range, buckets are equal in width.  A key that
    fills ranges of its own, and null, has buckets of equal widths of the tie."""
    nulls = rows.where("key IS NULL").limit(1).count()
    ranges = max(1, min(RANGES, count))
    found = rows.agg(F.percentile_approx("key", [i / ranges for i in range(ranges + 1)], 100 * RANGES)).first()[0] or []
    bounds = sorted({int(x) for x in found})
    frequent = sorted({int(x) for x, y in zip(found, found[1:]) if x == y})
    # Begins of ranges; a frequent key is one by itself.
    begins = sorted({*bounds, *frequent, *(x + 1 for x in frequent)}) or [0]
    each = max(1, -(-count // (len(begins) + nulls)))
    parts = F.lit(each)
    at = F.array(*(F.lit(x).cast("long") for x in begins))
    number = F.size(F.filter(at, lambda x: x <= F.col("key")))
    ends = [*begins[1:], begins[-1] + 1]
    widths = F.array(*(F.lit(-(-(y - x) // each)).cast("long") for x, y in zip(begins, ends)))
    # The quantiles are of the whole column, but approximate: keys may lie outside them.
    past = (F.col("key").cast("decimal(38,0)") - F.get(at, F.greatest(F.lit(0), number - 1))) / F.get(widths, F.greatest(F.lit(0), number - 1))
    inside = F.least((parts - 1).cast("decimal(38,0)"), F.floor(past)).cast("long")
    by_tie = F.shiftright(F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 33) * parts, 31)
    hot = F.col("key").isin(frequent) if frequent else F.lit(False)
    return (
        F.when(F.col("key").isNull(), by_tie)
        .when(hot, (number + 1) * parts + by_tie)
        .otherwise((number + 1) * parts + F.greatest(F.lit(0), inside))
        .cast("long")
    )


def _followed(df: DataFrame, key: str, text: str, bucket_rows: int) -> DataFrame:
    """(bucket, peek, key, tie, text): the rows by bucket of neighbouring keys and ties; each bucket also has the row
    that comes after its last one, marked as a peek.

    Only each bucket's greatest row crosses into the bucket that the order has before, so every text is exchanged once
    and a bucket's head at most once more.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    count = max(1, min(1 << 20, -(-rows.count() // bucket_rows)))
    rows = rows.withColumn("bucket", _buckets(rows.select("key", "tie"), count))
    # The order is by falling bucket; in it nulls, which are in the least ones, come last.
    heads = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head"))
    ordered = Window.orderBy(F.desc("bucket"))
    # One row per bucket, about 2^20 at most, whatever the corpus.
    follow = heads.select(
        "bucket",
        "head",
        # The first bucket's head follows the last bucket's end.
        F.coalesce(
            F.lag("bucket").over(ordered),
            F.last("bucket").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("goes_to"),
    )
    marked = rows.join(F.broadcast(follow), "bucket")
    is_head = F.struct("key", "tie").eqNullSafe(F.col("head"))
    return marked.select(
        F.explode(
            F.when(is_head, F.array(F.struct("bucket", F.lit(False).alias("peek")), F.struct(F.col("goes_to").alias("bucket"), F.lit(True).alias("peek"))))
            .otherwise(F.array(F.struct("bucket", F.lit(False).alias("peek"))))
        ).alias("b"),
        "key",
        "tie",
        "text",
    ).select("b.bucket", "b.peek", "key", "tie", "text")


def versions(df: DataFrame, *, key: str = "doc_id", text: str = "text", bucket_rows: int = 2000) -> DataFrame:
    """For each row: key, n_chars, sha256 of its edited text, both fingerprints, and the likeness of the
    text to its edited text and to the next row's text, in falling order of the key (cyclic).

    Rows with equal keys, and those with null keys, follow each other in the order of their texts' hashes.
    """
    spark = df.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        _followed(df, key, text, bucket_rows)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "peek", F.desc_nulls_last("key"), F.desc("tie"))
        .select("bucket", "peek", "key", "text")
    )
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last row of its bucket so far: bucket, key, text, digests
        taken: int | None = None  # the bucket whose following row has come
        for batch in batches:
            kind = batch.schema.field(2).type
            ready: list[tuple] = []
            for bucket, peek, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == taken:
                    continue  # rows with the same greatest key: only the first follows
                t = t or ""
                row = (bucket, k, t, digests(t))
                if waiting is not None and waiting[0] == bucket:
                    ready.append((waiting, row))
                waiting = None if peek else row
                taken = bucket if peek else None
            if ready:
                yield _compared(ready, names, kind)

    return ordered.mapInArrow(run, schema)


def _compared(pairs: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    texts = [edited(x[2], y[2]) for x, y in pairs]
    own, after, changed = [x[3] for x, _ in pairs], [y[3] for _, y in pairs], [digests(t) for t in texts]
    columns = [
        pa.array([x[1] for x, _ in pairs], kind),
        pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
        pa.array(fingerprints(own)),
        pa.array(fingerprints(changed)),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)

