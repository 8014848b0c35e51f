"""Exact n-gram Jaccard self-join of documents by parity sketches.

A document is the set of its word shingles.  Equal sets are joined first by a digest of the set, so
that copies cost nothing further; what follows works on distinct sets, the nodes.

Two sets whose sizes add up to s and whose similarity is at least t differ in at most
d = s (1-t)/(1+t) shingles.  Sets are grouped in size bands, and all sets of a band are cut into the same
number of parts by shingle hash.  In each part the shingles are XOR-hashed into a bit sketch: each flips
one bit.  A differing shingle changes its own part at most, so with more than d parts one part's sketch
is equal in both sets (pigeonhole); its bits, with band and part, are a join key.  A set also gives keys
in the next band, since its larger partners may lie there, and bands are so wide that they reach no further.

Parts with at most one shingle have keys that say little.  There are therefore some parts more than
d + 1: then several parts are equal, and a set with no more such weak parts than that leaves their keys
out.  Sets with more weak parts keep them.  If either of two similar sets leaves them out, one of their
equal parts is not weak, so no pair is lost.  Empty parts say nothing at all, and all sets of a band that have one would share its key.
So a set with so many empty parts that all equal ones may be empty is cut anew, by other bits, up to ``CUTS`` times, and gives the keys of its parts with
shingles in each cut: two similar sets without a common key in a cut are both cut anew.  Only the last cut has keys of empty parts.

Keys are sorted in ranges of key and set, so that a key that very many sets share is no single task's; those of
one set only go.  Candidates are checked by the Hamming distance of whole parity sketches, whose length follows the set's,
which bounds the symmetric difference from below, and then by the shingle sets themselves, which are made anew
for the documents in question.  Since only components are wanted, groups
with one key are first joined as stars: one set of each component that the group spans, around one of them,
in several rounds with ever more different choices.  All remaining pairs of sets that are in different components then
follow, filtered inside the join by the sketches folded to fewer bits.  So a large group of near copies is not
spelled out as pairs, and no link between components is missed.

Null and empty documents have no shingles and no links.  Repeated rows are equal sets.  Documents with
fewer words than a shingle are one shingle.  Very long texts are worked on in pieces; their sets, six bytes a shingle,
are one cell.  An empty table gives an empty result.  Only key and text are read, so further columns may have any name.

Sets are equal if the 128-bit digests of their sorted 64-bit shingle hashes are.  Within a key two sets count as one if 64 bits
of the digest are equal, and two sets are compared by 48 bits of their shingles' hashes: a pair of sets of n shingles
together is misjudged with a probability of about n^2 / 2^49.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bit_map, fresh, map_rows, on_map, partitions, settings, small_batches, written
from .components import components
from .shingling import mix, shingle_sets

#: Star rounds before all remaining pairs, by how many different sets a group's stars may be around.
STARS = (1, 8)
#: Components of a group from which more than one star round is made.
MANY = 16
#: Long words that a whole parity sketch is folded to for the filter inside the joins of candidates; also its least length.
FOLDED = 8
#: Bits of the longest whole sketches.  Those of longer sets only rule out less.
LONGEST = 1 << 20
#: Bits of a part's sketch.
PART_BITS = 1 << 16
#: Ways in which a set is cut into parts, as long as there are too many empty ones.
CUTS = 8
#: Keys handed to a Python worker at a time.
KEY_ROWS = "65536"

_M1 = np.uint64(0x9E3779B97F4A7C15)
_CUT_SEEDS = np.arange(CUTS, dtype=np.uint64) * _M1
#: Bits of a shingle's hash that sets are compared by.
_COMPARED = np.uint64((1 << 48) - 1)
_KEY_BITS = np.uint64((1 << 48) - 1)


class Join:
    """The arithmetic of a join at ``num / den`` similarity."""

    def __init__(self, size: int, num: int, den: int) -> None:
        self.size, self.num, self.den = size, num, den

    def differ(self, both: np.ndarray | int) -> np.ndarray | int:
        """The most shingles in which similar sets of so many together can differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def tops(self) -> list[int]:
        """The largest sizes of the bands, up to 2^40.  Similar sets lie in one band or in neighbouring ones."""
        if not hasattr(self, "_tops"):
            self._tops = [1]
            while self._tops[-1] < 1 << 40:
                self._tops.append(max(self._tops[-1] + 1, self._tops[-1] * self.den // self.num))
        return self._tops

    def top(self, k: int) -> int:
        return self.tops()[k]

    def parts(self, k: int) -> tuple[int, int]:
        """How many parts a set of band k is cut into, and how many more than needed those are."""
        need = self.differ(2 * self.top(k)) + 1
        spare = 0 if need == 1 else need // 16 + 2
        return need + spare, spare

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The owners (positions in ``sets``) and values of all join keys of some sets."""
        sizes = np.array([len(s) for s in sets], np.int64)
        own = np.searchsorted(self.tops(), sizes)
        owners, values = [], []
        for ahead in (0, 1):
            band = own + ahead
            need = np.array([self.parts(k) for k in band.tolist()], np.int64).reshape(-1, 2)
            # One part would only join equal sets; the next band only has sets that are larger than this band's.
            use = (sizes > 0) & (need[:, 0] > 1)
            if ahead:
                above = np.array([self.top(k) + 1 for k in own.tolist()], np.int64)
                use &= sizes * self.den >= above * self.num
            chosen = np.flatnonzero(use)
            if not len(chosen):
                continue
            for cut in range(CUTS):
                found = np.concatenate([sets[i] for i in chosen])
                of = np.repeat(np.arange(len(chosen)), sizes[chosen])
                count = need[chosen, 0].astype(np.uint64)
                if cut:
                    found = mix(found ^ _CUT_SEEDS[cut])
                    order = np.lexsort((found, of))
                    found = found[order]
                part = (found >> np.uint64(32)) * count[of] >> np.uint64(32)
                bit = mix((found & np.uint64(PART_BITS - 1)) + _M1)
                # Sets are sorted, so a set's parts are runs.
                starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1]))))
                held = np.diff(np.append(starts, len(found)))
                sketch = np.bitwise_xor.reduceat(bit, starts)
                of, part = of[starts], part[starts]
                seed = mix(band[chosen].astype(np.uint64) + _M1) + _CUT_SEEDS[cut]
                value = mix(mix(part + seed[of]) + sketch * _M1)
                strong = np.bincount(of[held > 1], minlength=len(chosen))
                lean = (need[chosen, 0] - strong <= need[chosen, 1]) & (strong > 0)
                keep = ~lean[of] | (held > 1)
                owners.append(chosen[of[keep]])
                values.append(value[keep])
                # If no more parts are empty than are spare, one of the equal parts is not.
                again = need[chosen, 0] - np.bincount(of, minlength=len(chosen)) > need[chosen, 1]
                if cut == CUTS - 1:
                    for i in np.flatnonzero(again):
                        empty = np.setdiff1d(np.arange(need[chosen[i], 0]).astype(np.uint64), part[of == i])
                        owners.append(np.full(len(empty), chosen[i]))
                        values.append(mix(mix(empty + seed[i])))
                chosen = chosen[again]
                if not len(chosen):
                    break
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(owners), np.concatenate(values) & _KEY_BITS

    def similar(self, x: bytes, y: bytes, both: int) -> bool:
        """Whether two packed sets of so many shingles together are similar."""
        merged = np.sort(np.concatenate([unpacked(x), unpacked(y)]), kind="stable")
        common = int((merged[1:] == merged[:-1]).sum())
        return self.den * common >= self.num * (both - common)


def packed(found: np.ndarray) -> bytes:
    """The compared bits of a set's hashes, six bytes each."""
    return np.unique(found & _COMPARED).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def sketch(found: np.ndarray) -> bytes:
    """The whole parity sketch of a set, of about as many bits as it has shingles."""
    bits = min(LONGEST, max(64 * FOLDED, 1 << (len(found) - 1).bit_length()))
    flips = np.bincount((found >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def shortened(raw: bytes, size: int) -> np.ndarray:
    """A whole sketch as long words, folded to so many bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches in the bits of the shorter."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(shortened(x, size) ^ shortened(y, size)).sum(dtype=np.int64))


def folded(raw: bytes) -> list[int]:
    """A sketch of FOLDED long words: the parity of those of the whole one."""
    return shortened(raw, 8 * FOLDED).view(np.int64).tolist()


def name_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _profiles(docs: DataFrame, join: Join) -> DataFrame:
    """(doc, t, t2, id, n, name, short, sketch, folded, keys) of every row: n shingles, the set's name and its first half.  The last three
    are there once for each set and task."""
    own = [docs.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("t", "t2", "id"))]
    longs = T.ArrayType(T.LongType())
    more = {"n": T.LongType(), "name": T.BinaryType(), "short": T.LongType(), "sketch": T.BinaryType(), "folded": longs, "keys": longs}
    schema = T.StructType([*own, *(T.StructField(c, t) for c, t in more.items())])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sets = shingle_sets(batch.column(4), join.size)
            names = [name_of(s) if len(s) else None for s in sets]
            new = np.zeros(len(sets), bool)
            for i, name in enumerate(names):
                if name is not None and name not in seen:
                    seen.add(name)
                    new[i] = True
            owners, values = join.keys([s if x else s[:0] for s, x in zip(sets, new)])
            order = np.argsort(owners, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(sets))))).astype(np.int32)
            sketches = [sketch(s) if x else None for s, x in zip(sets, new)]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(names, pa.binary()),
                pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.array([x and folded(x) for x in sketches], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns], names=schema.names)

    numbered = docs.select("doc", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(2), "text").alias("t2"), F.monotonically_increasing_id().alias("id"), "text")
    return numbered.mapInArrow(run, schema)


def _shared(profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, short) of the keys that several sets share, with few others: the keys at the ends of a range are not known to be shared."""
    spark = profiles.sparkSession
    keyed = profiles.select(F.explode("keys").alias("key"), "short")
    ordered = keyed.repartitionByRange(partitions(spark), "key", "short").sortWithinPartitions("key", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row before and whether it stays, that is, whether its key was the first of the range or stood before it.
        held: tuple[int, int] | None = None
        kept = True
        for batch in batches:
            keys, shorts = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(keys):
                continue
            if held is not None:
                keys, shorts = np.append(held[0], keys), np.append(held[1], shorts)
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (shorts[1:] != shorts[:-1])
            if not fresh.all():
                keys, shorts = keys[fresh], shorts[fresh]
            equal = keys[1:] == keys[:-1]
            stays = np.zeros(len(keys), bool)
            stays[1:] |= equal
            stays[:-1] |= equal
            stays[0] |= kept
            held, kept = (int(keys[-1]), int(shorts[-1])), bool(stays[-1])
            stays[-1] = False
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[stays]), pa.array(shorts[stays])], names=["key", "short"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "short"])

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": KEY_ROWS}):
        return scratch.written(ordered.mapInArrow(run, "key long, short long"), "shared")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar: by sizes and folded sketches, inside the join, by whole sketches, then by sets."""
    possible = (
        pairs.join(_profile(nodes, "_a"), F.col("a") == F.col("node_a"))
        .drop("node_a")
        .join(_profile(nodes, "_b"), (F.col("b") == F.col("node_b")) & _may_be_similar("_a", "_b", join))
        .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"))
    )

    # Folded sketches say nothing about long texts, whose sets are large: the whole ones are compared before any set moves.
    def whole(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(f"_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    drawn = possible.join(whole("a"), F.col("a") == F.col("_a")).drop("_a").join(whole("b"), F.col("b") == F.col("_b")).drop("_b")

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        both, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
        ok = [apart(p, q) <= join.differ(n) for n, p, q in zip(both, x, y)]
        return batch.select(["a", "b", "both"]).filter(pa.array(ok, pa.bool_()))

    close = scratch.written(map_rows(drawn.select("a", "b", "both", "sketch_a", "sketch_b"), "a long, b long, both long", near), "close")
    if not close.limit(1).count():
        return close.select("a", "b")
    asked = close.select(F.col("a").alias("_n")).union(close.select(F.col("b").alias("_n"))).distinct()
    wanted = scratch.written(nodes.join(asked, F.col("node") == F.col("_n")).select("node", "t", F.col("name").alias("_name")), "wanted")
    bits = scratch.written(bit_map(wanted, "t"), "bits")
    sets = scratch.written(_sets(docs.where(on_map(bits.scalar(), F.xxhash64("text"))), wanted, join), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(f"_{name}"), F.col("set").alias(f"set_{name}"))

    # A star's hub is on the left, and one set can be the hub of very many: its rows can be split, and its partners' sets move first.
    compared = (
        close.join(side("b"), F.col("b") == F.col("_b"))
        .select("a", "b", "both", "set_b")
        .join(side("a"), F.col("a") == F.col("_a"))
        .select("a", "b", "both", "set_a", "set_b")
    )

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [join.similar(x, y, n) for n, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = scratch.written(map_rows(compared, "a long, b long", verify), "links")
    scratch.drop(close, wanted, bits, sets)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(node, set) of the wanted nodes, from documents that include theirs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for s in shingle_sets(batch.column(0), join.size):
                name = name_of(s)
                if len(s) and name not in seen:
                    seen.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([packed(s)], pa.binary())], names=["name", "set"])

    found = docs.select("text").mapInArrow(run, "name binary, set binary").groupBy("name").agg(F.first("set").alias("set"))
    return found.join(wanted, F.col("name") == F.col("_name")).select("node", "set")


def _profile(nodes: DataFrame, suffix: str) -> DataFrame:
    """The nodes' names, sizes and folded sketches in columns with a suffix."""
    plain = [F.col(c).alias(c + suffix) for c in ("node", "n")]
    return nodes.select(*plain, *(F.col("folded")[i].alias(f"f{i}{suffix}") for i in range(FOLDED)))


def _may_be_similar(x: str, y: str, join: Join) -> Column:
    """Whether sizes and folded sketches allow two sets to be similar."""
    n_x, n_y = F.col("n" + x), F.col("n" + y)
    flips = sum((F.bit_count(F.col(f"f{i}{x}").bitwiseXOR(F.col(f"f{i}{y}"))) for i in range(FOLDED)), F.lit(0))
    near = flips * (join.den + join.num) <= (n_x + n_y) * (join.den - join.num)
    return (F.least(n_x, n_y) * join.den >= F.greatest(n_x, n_y) * join.num) & near


def _stars(open_keys: DataFrame, hubs: int, scratch: Scratch) -> DataFrame:
    """One set of each component of a key's group, paired with one of them all; which sets depends on the key, in ``hubs`` ways.
    After the first round, in which each set is a component, only groups of many components are worth it: the others have few pairs."""
    turn = F.struct(F.xxhash64("node", F.pmod("key", F.lit(hubs)), F.lit(hubs)).alias("turn"), "node")
    if hubs == 1:
        one = open_keys.select("key", turn.alias("own"))
    else:
        one = scratch.written(open_keys.groupBy("key", "root").agg(F.min(turn).alias("own")), "one")
    hub = one.groupBy(F.col("key").alias("_key")).agg(F.min("own").alias("hub"), F.count("*").alias("spans"))
    hub = scratch.written(hub.where(F.col("spans") >= (2 if hubs == 1 else MANY)).drop("spans"), "hubs")
    starred = one.join(hub, F.col("key") == F.col("_key")).where("own <> hub")
    return starred.select(F.col("hub.node").alias("a"), F.col("own.node").alias("b")).distinct()


def _remaining(open_keys: DataFrame, nodes: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """All pairs of sets of different components with a common key, but those that sizes or folded sketches rule out."""
    rows = open_keys.join(_profile(nodes, "").withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    rows = scratch.written(rows, "rows")
    l, r = (rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns)) for s in "lr")
    different = (F.col("root_l") != F.col("root_r")) & (F.col("node_l") < F.col("node_r"))
    met = l.join(r, (F.col("key_l") == F.col("key_r")) & different & _may_be_similar("_l", "_r", join))
    return met.select(F.col("node_l").alias("a"), F.col("node_r").alias("b")).distinct()


def _open(keys: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, root) of those ``keys`` that still span components.  ``keys`` is dropped."""
    own = roots.select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    merged = keys.join(own, F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("_root", "root").alias("root"))
    placed = scratch.written(merged, "placed")
    spread = placed.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    spread = scratch.written(spread.select("_key"), "spread")
    found = scratch.written(placed.join(spread, F.col("key") == F.col("_key"), "left_semi"), "open")
    scratch.drop(keys, placed, spread)
    return found


def _merged(links: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(node, root) after ``links`` (a, b) are added to the components so far: only links between their roots are followed."""
    if roots is None:
        return scratch.written(components(links, scratch), "roots")
    at = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    for side in "ab":
        found = links.join(at, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_r", side))
        links = found.drop("_n", "_r")
    added = scratch.written(components(links, scratch), "added")
    to = added.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = roots.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    # Nodes that had no link before.
    new = added.join(roots.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return scratch.written(moved.unionByName(new), "roots")


def classes(docs: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """(doc, t, t2, n, root) of every row of ``docs`` (doc, text): two hashes of the text, how many shingles it has, and a number that
    exactly those rows share whose sets are linked, null without shingles."""
    profiles = scratch.written(_profiles(docs, join), "profiles")
    # The first half of a name can be that of several sets: then each gets the keys of all.
    once = profiles.where("sketch IS NOT NULL").groupBy("name").agg(
        F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("short", "n", "sketch", "folded", "t"))
    )
    all_nodes = scratch.written(once, "nodes")
    shared = _shared(profiles, scratch)
    keyed = shared.join(all_nodes.select(F.col("short").alias("_s"), "node"), F.col("short") == F.col("_s")).select("key", "node")
    keys = scratch.written(keyed.withColumn("root", F.col("node")), "keys")
    scratch.drop(shared)
    # Only these nodes are looked at again.
    nodes = scratch.written(all_nodes.join(keys.select(F.col("node").alias("_n")).distinct(), F.col("node") == F.col("_n"), "left_semi"), "open_nodes")

    roots: DataFrame | None = None
    for hubs in (*STARS, 0):
        pairs = _stars(keys, hubs, scratch) if hubs else _remaining(keys, nodes, join, scratch)
        links = _linked(pairs, nodes, docs, join, scratch)
        if not links.limit(1).count():
            continue
        roots = _merged(links, roots, scratch)
        if hubs:
            keys = _open(keys, roots, scratch)

    named = all_nodes.select(F.col("name").alias("_name"), "node")
    if roots is not None:
        own = roots.select(F.col("node").alias("_n"), "root")
        named = named.join(own, F.col("node") == F.col("_n"), "left").select("_name", F.coalesce("root", "node").alias("root"))
    else:
        named = named.withColumnRenamed("node", "root")
    named = scratch.written(named, "named")
    return scratch.written(profiles.join(named, F.col("name") == F.col("_name"), "left").select("doc", "t", "t2", "n", "root"), "classes")


def similar_groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the number of its shingles, and the least key that is
    reachable over links of at least ``num / den`` similarity.  Keys are integers; a row without a key has the id of
    those that have one."""
    with Scratch(docs.sparkSession) as scratch:
        rows = classes(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), Join(size, num, den), scratch)
        least = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc").alias("least"))
        least = scratch.written(least, "least")
        found = rows.join(least, F.col("root") == F.col("_root"), "left")
        found = found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
        return written(found, "groups")


def one_of_each_group(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with one row of each group that links make, that with the least key; of rows with that key, or if no row has one,
    that with the least hash of its text.  Of rows without words that repeat key and text, one stays."""
    name = ["null", "doc", "t", "t2"]
    own = [fresh(docs, f"_{n}") for n in name]
    with Scratch(docs.sparkSession) as scratch:
        rows = classes(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), Join(size, num, den), scratch)
        rows = rows.select("root", F.col("doc").isNull().alias("null"), F.coalesce("doc", F.lit(0)).alias("doc"), "t", "t2")
        best = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(*name)).alias("one")).select("one.*")
        chosen = written(best.unionByName(rows.where("root IS NULL").select(*name).distinct()), "chosen")
    hashes = [F.col(key).isNull(), F.coalesce(F.col(key).cast("long"), F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit(2), F.col(text))]
    # Rows that repeat key and text are merged before they are exchanged.
    merged = docs.withColumns(dict(zip(own, hashes))).dropDuplicates(own)
    chosen = chosen.toDF(*(f"{o}_chosen" for o in own))
    return merged.join(chosen, [F.col(o) == F.col(f"{o}_chosen") for o in own], "left_semi").select(*docs.columns)
