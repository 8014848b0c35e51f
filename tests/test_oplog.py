import random
import uuid

from extentlake.model import DB_VERSION
from extentlake.sources.repository import Repository
from extentlake.sources.storage import shared_root
from extentlake.streaming import oplog

OPS = "file_id long, op_seq long, op string, pos long, size long"


def random_ops(seed, files=3, n=60):
    rng = random.Random(seed)
    out = []
    for f in range(files):
        for k in range(n):
            op = rng.choice(["OPEN", "WRITE", "WRITE", "TRUNCATE", "RELEASE", "READ"])
            out.append((f, k, op, rng.randint(0, 30), rng.randint(0, 9)))
    return out


def test_overlay_against_byte_arrays(spark):
    ops = random_ops(1)
    shown = {}
    for f, k, op, pos, n in ops:
        own = shown.setdefault(f, {})
        if op == "WRITE":
            own.update({x: k for x in range(pos, pos + n)})
        elif op == "TRUNCATE":
            shown[f] = {x: w for x, w in own.items() if x < pos}
    got = {}
    for r in oplog.overlay(spark.createDataFrame(ops, OPS)).collect():
        got.setdefault(r["file_id"], {}).update({x: r["op_seq"] for x in range(r["start"], r["stop"])})
    assert got == {f: c for f, c in shown.items() if c}


def model(ops):
    handles, sizes, dirty, counts, closed = {}, {}, {}, [], []
    for f, k, op, pos, n in ops:
        h = handles.get(f, 0)
        if op == "OPEN":
            h += 1
        elif op == "WRITE" and h:
            sizes[f] = max(sizes.get(f, 0), pos + n)
            dirty[f] = True
        elif op == "TRUNCATE" and h:
            sizes[f] = pos
            dirty[f] = True
        elif op == "RELEASE" and h:
            h -= 1
            if not h and dirty.get(f):
                closed.append((f, k, sizes[f]))
                dirty[f] = False
        handles[f] = h
        counts.append((f, k, h))
    return counts, closed


def test_handles_and_queue(spark):
    for seed in (2, 3):
        ops = random_ops(seed)
        counts, closed = model(ops)
        df = spark.createDataFrame(ops, OPS)
        assert sorted(tuple(r) for r in oplog.handle_counts(df).select("file_id", "op_seq", "handles").collect()) == sorted(counts)
        assert sorted(tuple(r) for r in oplog.persist_queue(df).collect()) == sorted(closed)


def test_overlay_bytes(spark):
    rng = random.Random(11)
    ops = random_ops(6)
    payload = {(f, k): rng.randbytes(n) for f, k, op, _, n in ops if op == "WRITE"}
    stored = {f: [(p, rng.randbytes(7)) for p in (0, 9, 20)] for f in {o[0] for o in ops}}
    seen = {f: {p + i: b for p, data in parts for i, b in enumerate(data)} for f, parts in stored.items()}
    handles = {}
    for f, k, op, pos, n in sorted(ops, key=lambda o: o[1]):
        if op == "OPEN":
            handles[f] = handles.get(f, 0) + 1
        elif op == "RELEASE" and handles.get(f):
            handles[f] -= 1
        elif op == "WRITE" and handles.get(f):
            seen[f].update({pos + i: b for i, b in enumerate(payload[f, k])})
        elif op == "TRUNCATE" and handles.get(f):
            seen[f] = {p: b for p, b in seen[f].items() if p < pos}
    got = {f: {} for f in seen}
    frames = (
        spark.createDataFrame(ops, OPS),
        spark.createDataFrame([(f, k, bytearray(d)) for (f, k), d in payload.items()], "file_id long, op_seq long, bytes binary"),
        spark.createDataFrame([(f, p, bytearray(d)) for f, parts in stored.items() for p, d in parts], "file_id long, pos long, bytes binary"),
    )
    for r in oplog.overlay_bytes(*frames).collect():
        assert not got[r["file_id"]].keys() & set(range(r["pos"], r["pos"] + len(r["bytes"])))
        got[r["file_id"]].update({r["pos"] + i: b for i, b in enumerate(r["bytes"])})
    assert got == seen


def test_stream_over_several_triggers(spark):
    ops = random_ops(4)
    base = f"{shared_root(spark)}/test-{uuid.uuid4().hex}"
    for a, b in ((0, 20), (20, 40), (40, 60)):
        spark.createDataFrame([o for o in ops if a <= o[1] < b], OPS).coalesce(1).write.mode("append").parquet(f"{base}/log")
        source = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
        oplog.drain(oplog.persist_stream(source), f"{base}/out", f"{base}/state")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect()) == sorted(model(ops)[1])


def test_repository_snapshots(spark, tmp_path):
    import datetime

    import pytest

    repo = Repository(spark, f"file://{tmp_path}/repo")
    with pytest.raises(FileNotFoundError):
        repo.version()
    repo.init(5)
    with pytest.raises(FileExistsError):
        repo.init(5)
    entries, contents = repo.opened()
    assert [tuple(r) for r in entries.collect()] == [(0, 0, "", 5, 0, None)] and contents.count() == 0
    added = spark.createDataFrame([(1, 0, "a", 6, 0, None)], entries.schema)
    assert repo.publish({"tree_entries": entries.unionByName(added)}) == 2
    assert repo.table("tree_entries").count() == 2 and repo.table("context").first()["value"] == DB_VERSION
    folder = repo.portable_copy(datetime.datetime(2024, 1, 2, 3, 4))
    assert folder.endswith("snapshot_2024-01-02_03-04")
    repo.restore_snapshot(1)
    assert repo.table("tree_entries").count() == 1
    repo.restore_copy(folder)
    assert repo.table("tree_entries").count() == 2
    repo.compact()
    assert repo.opened()[0].count() == 2
    with pytest.raises(PermissionError):
        Repository(spark, repo.base, read_only=True).publish({})
