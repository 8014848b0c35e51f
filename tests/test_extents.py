import random

import pytest

from extentlake.model import MAX_POSITION, address_file_column
from extentlake.operators import content, extents
from pyspark.sql import functions as F

M = MAX_POSITION


def frame(spark, rows, names="id long, seq int, start long, stop long"):
    return spark.createDataFrame(rows, names)


def spans(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("areas", "gaps", "end"),
    [
        ([], [], 0),
        ([(4, 9)], [(0, 4)], 9),
        ([(15, 22), (0, 3), (7, 11)], [(3, 7), (11, 15)], 22),
        ([(0, 6), (8, 12), (12, 19)], [(6, 8)], 19),
    ],
)
def test_gaps(spark, areas, gaps, end):
    df = frame(spark, [(i, 1, a, b) for i, (a, b) in enumerate(areas)])
    assert spans(extents.gaps(df), "start", "stop") == gaps
    assert extents.end_of_storage(df).first()[0] == end


def test_overlap_and_duplicate_start_are_found(spark):
    df = frame(spark, [(1, 1, 0, 5), (2, 1, 10, 31), (3, 1, 30, 40), (4, 1, 0, 2)])
    assert spans(extents.overlapping(df), "id", "reach") == [(1, 2), (3, 31)]
    pairs = {(r["a"]["id"], r["b"]["id"]) for r in extents.overlapping_pairs(df).collect()}
    assert pairs == {(1, 4), (2, 3)}
    assert spans(extents.duplicate_starts(df), "start", "extents") == [(0, 2)]


def test_free_areas_skip_blacklisted(spark):
    df = frame(spark, [(1, 1, 0, 0)])
    assert spans(extents.free_areas(df), "start", "stop") == [(0, M)]
    df = frame(spark, [(1, 1, 0, 0), (2, 1, 5, 10), (2, 2, 20, 25)])
    assert spans(extents.free_areas(df), "start", "stop") == [(0, 5), (10, 20), (25, M)]


@pytest.mark.parametrize(
    ("size", "expected"),
    [(12, [(7, 19)]), (40, [(7, 19), (50, 78)]), (61, [(7, 19), (50, 90), (300, 309)])],
)
def test_allocate_one(spark, size, expected):
    free = frame(spark, [(7, 19), (50, 90), (300, M)], "start long, stop long")
    asked = frame(spark, [(1, size), (2, 0), (3, -1)], "id long, size long")
    assert spans(extents.allocate(asked, free), "start", "stop") == expected
    assert extents.unmet_bytes(asked, free).first()[0] == 0
    short = frame(spark, [(7, 19)], "start long, stop long")
    assert extents.unmet_bytes(asked, short).first()[0] == max(0, size - 12)


def test_allocate_like_one_after_the_other(spark):
    rng = random.Random(5)
    at, free = 0, []
    for _ in range(30):
        at += rng.randint(1, 9)
        free.append((at, at + rng.randint(1, 40)))
        at = free[-1][1]
    free.append((at + 3, M))
    asked = [(i, rng.randint(1, 60)) for i in range(40)]
    left, expected = list(free), []
    for i, n in asked:
        while n:
            a, b = left[0]
            take = min(n, b - a)
            expected.append((i, a, a + take))
            n -= take
            left[0] = (a + take, b)
            if left[0][0] == b:
                left.pop(0)
    got = extents.allocate(frame(spark, asked, "id long, size long"), frame(spark, free, "start long, stop long"))
    assert spans(got, "id", "start", "stop") == sorted(expected)


def test_interval_algebra_against_sets(spark):
    rng = random.Random(6)
    data = [(f, s, s + rng.randint(0, 12)) for f in range(4) for s in (rng.randint(0, 80) for _ in range(12))]
    names = "f long, start long, stop long"
    joined = extents.coalesce_adjacent(frame(spark, data, names), ["f"])
    cells = {(f, x) for f, a, b in data for x in range(a, b)}
    runs = spans(joined, "f", "start", "stop")
    assert {(f, x) for f, a, b in runs for x in range(a, b)} == cells
    assert all(r[0] != q[0] or r[2] < q[1] for r, q in zip(runs, runs[1:]))
    holes = [(f, s, s + 5) for f in range(4) for s in range(3, 90, 20)]
    rest = spans(extents.subtract(joined, frame(spark, holes, names), ["f"]), "f", "start", "stop")
    gone = {(f, x) for f, a, b in holes for x in range(a, b)}
    assert {(f, x) for f, a, b in rest for x in range(a, b)} == cells - gone
    cut = spans(extents.truncate(joined, F.lit(40)), "f", "start", "stop")
    assert {(f, x) for f, a, b in cut for x in range(a, b)} == {c for c in cells if c[1] < 40}
    seen = spans(extents.holes_in_window(joined, ["f"], 10, 50), "f", "start", "stop", "is_hole")
    assert {(f, x) for f, a, b, h in seen if not h for x in range(a, b)} == {c for c in cells if 10 <= c[1] < 50}
    # A key without an extent in the window has one hole.
    assert spans(extents.holes_in_window(frame(spark, [(1, 100, 120), (2, 0, 5), (2, 20, 70)], names), ["f"], 10, 60), "f", "start", "stop", "is_hole") == [
        (1, 10, 60, True), (2, 10, 20, True), (2, 20, 60, False),
    ]


def test_gaps_of_overlapping_extents(spark):
    rng = random.Random(9)
    for n in (4, 60):
        data = [(i, s, s + rng.randint(0, 30)) for i, s in enumerate(rng.sample(range(10, 2000), n))]
        df = frame(spark, [(i, 1, a, b) for i, a, b in data], "id long, seq int, start long, stop long")
        used = {x for _, a, b in data for x in range(a, b)}
        free = spans(extents.free_areas(df, checked=False), "start", "stop")
        assert not used & {x for a, b in free for x in range(a, min(b, 3000))} and len(used) + sum(min(b, 3000) - a for a, b in free) == 3000
        pairs = {(i, j) for i, a, b in data for j, c, d in data if i < j and max(a, c) < min(b, d)}
        assert {(r["a"]["id"], r["b"]["id"]) for r in extents.overlapping_pairs(df).collect()} == pairs
        if pairs:
            with pytest.raises(ValueError, match="overlaps"):
                extents.free_areas(df)


def test_requests_and_ids_far_from_the_others(spark):
    free = frame(spark, [(0, 7), (10, 12), (20, M)], "start long, stop long")
    asked = frame(spark, [(1, 8), (2, 10**14), (10**17, 5)], "id long, size long")
    assert spans(extents.allocate(asked, free), "id", "start", "stop") == [
        (1, 0, 7), (1, 10, 11), (2, 11, 12), (2, 20, 20 + 10**14 - 1), (10**17, 20 + 10**14 - 1, 20 + 10**14 + 4),
    ]
    ids = [*range(1000), 1 << 60]
    got = extents.prefix_axis(frame(spark, [(i, 1) for i in ids], "id long, size long"), "id", "size")
    assert [r["axis_from"] for r in got.orderBy("id").collect()] == list(range(1001))


def test_wide_positions(spark):
    m = 2147483647
    df = frame(spark, [(1, m - 1000, m + 1000)], "f long, start long, stop long")
    hole = frame(spark, [(1, m - 500, m + 500)], "f long, start long, stop long")
    assert spans(extents.subtract(df, hole, ["f"]), "start", "stop") == [(m - 1000, m - 500), (m + 500, m + 1000)]


def test_read_window_and_beyond_end(spark):
    parts = frame(spark, [(1, 1, 100, 110), (1, 2, 50, 70)])
    assert spans(extents.read_window(parts, 5, 10), "at", "start", "stop") == [(0, 105, 110), (5, 50, 55)]
    assert spans(extents.read_window(parts, 30, 10), "at") == []


def test_address_to_file(spark):
    cases = {
        # The format of the store's file names.
        0: "00/00/0000000000",
        99999999: "00/00/0000000000",
        10**8: "00/00/0100000000",
        99 * 10**8: "00/00/9900000000",
        100 * 10**8 + 1: "00/01/10000000000",
        10**12: "01/00/1000000000000",
        M // 2: "4611686/01/4611686018400000000",
        -1: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p long")
    assert {r[0]: r[1] for r in df.select("p", address_file_column(F.col("p"))).collect()} == cases


def test_chunks_to_areas(spark):
    chunks = spark.createDataFrame([(1, 0, bytearray([1, 2, 3])), (1, 3, bytearray([4, 5, 6]))], "id long, pos long, bytes binary")
    areas = frame(spark, [(1, 1, 100, 102), (1, 2, 200, 203), (1, 3, 300, 301)])
    got = {r["start"]: list(r["bytes"]) for r in content.to_areas(chunks, areas).collect()}
    assert got == {100: [1, 2], 200: [3], 201: [4, 5], 300: [6]}
    assert content.unfitting(chunks, areas).count() == 0
    assert content.unfitting(chunks, frame(spark, [(1, 1, 0, 10)])).count() == 1
    assert content.unfitting(chunks, frame(spark, [(1, 1, 0, 2)])).count() == 1


def test_pieces_are_filled_with_zeros(spark):
    pieces = spark.createDataFrame([(1, 2, bytearray(b"ab")), (1, 9, bytearray(b"c")), (3, 0, bytearray(b"d"))], "id long, pos long, bytes binary")
    lengths = spark.createDataFrame([(1, 12), (2, 5), (3, 1), (4, 0)], "id long, length long")
    got = {}
    for r in content.filled(pieces, lengths, 2).orderBy("id", "pos").collect():
        assert r["pos"] == len(got.get(r["id"], b"")) and len(r["bytes"]) <= 2
        got[r["id"]] = got.get(r["id"], b"") + bytes(r["bytes"])
    assert got == {1: b"\0\0ab\0\0\0\0\0c\0\0", 2: bytes(5), 3: b"d"}


def test_missing_store_bytes_read_as_zeros(spark):
    parts = frame(spark, [(1, 1, 8, 14)])
    store = spark.createDataFrame([(8, bytearray([2, 3])), (10, bytearray([4, 5]))], "start long, bytes binary")
    lengths = spark.createDataFrame([(1, 6), (2, 3)], "id long, length long")
    got = {r["id"]: list(r["data"]) for r in content.assemble(content.read_contents(parts, store), lengths).collect()}
    assert got == {1: [2, 3, 4, 5, 0, 0], 2: [0, 0, 0]}


def test_digests_agree(spark):
    import hashlib

    data = [(i, bytearray(random.Random(i).randbytes(n))) for i, n in enumerate([1, 100, 1024, 5000])]
    chunks = content.chunked(spark.createDataFrame(data, "id long, data binary"), size=1000)
    expected = sorted((i, hashlib.md5(d).hexdigest(), len(d)) for i, d in data)
    assert spans(content.digests(chunks), "id", "hash", "length") == expected
    assert spans(content.large_digests(chunks), "id", "hash", "length") == expected
