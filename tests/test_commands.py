import os

import pytest

from extentlake.plans.commands import Commands
from extentlake.sources.export import export_files
from extentlake.sources.repository import Repository, scan_files
from pyspark.sql import functions as F


def files(spark, rows):
    return spark.createDataFrame([(p, t, bytearray(d)) for p, t, d in rows], "path string, time long, data binary")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    repo = Repository(spark, f"file://{tmp_path_factory.mktemp('repo')}")
    repo.init(1)
    commands = Commands(repo, file_bytes=1000)
    commands.ingest(files(spark, [("/a/b/one.txt", 5, b"x" * 2500), ("/a/two.txt", 6, b"y" * 700), ("/a/c/copy.txt", 7, b"y" * 700), ("/empty", 8, b"")]), 10)
    return commands


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def restored(commands, path="/"):
    return {r["path"]: bytes(r["data"]) for r in commands.restore(path).collect()}


def test_round_trip(spark, filled, tmp_path):
    assert restored(filled) == {"/a/b/one.txt": b"x" * 2500, "/a/two.txt": b"y" * 700, "/a/c/copy.txt": b"y" * 700, "/empty": b""}
    assert restored(filled, "/a/b") == {"/a/b/one.txt": b"x" * 2500}
    assert {r["verdict"] for r in filled.check("/").collect()} == {"OK"}
    assert tuple(filled.live_bytes().first()) == (3900, 3200)
    assert rows(filled.list("/a"), "place", "name", "size") == [(1, "b", None), (2, "c", None), (3, "two.txt", 700)]
    assert rows(filled.find("A/*.TXT"), "path") == [("/a/b/one.txt",), ("/a/c/copy.txt",), ("/a/two.txt",)]
    assert rows(filled.stats("/a"), "files", "dirs", "bytes") == [(3, 2, 3900)]
    written = export_files(filled.restore("/a"), f"file://{tmp_path}/out")
    assert rows(written, "path", "bytes") == [("/a/b/one.txt", 2500), ("/a/c/copy.txt", 700), ("/a/two.txt", 700)]
    assert open(f"{tmp_path}/out/a/b/one.txt", "rb").read() == b"x" * 2500
    assert sorted(r["size"] for r in scan_files(spark, f"file://{tmp_path}/out", "*.txt").collect()) == [700, 700, 2500]
    assert not [f for _, _, names in os.walk(f"{tmp_path}/out") for f in names if not f.endswith((".txt", ".crc"))]


def test_plan(spark, filled):
    source = spark.createDataFrame([("two.txt", 6, 700), ("b/one.txt", 99, 2500), ("new", 1, 1)], "path string, time long, size long")
    assert rows(filled.plan(source, "/a", "/a"), "path", "action") == [("b/one.txt", "UPDATE"), ("new", "CREATE"), ("two.txt", "KEEP")]


def test_changes(spark, filled):
    filled.ingest(files(spark, [("/a/two.txt", 20, b"z" * 300), ("/a/d/three", 21, b"x" * 2500)]), 30)
    assert restored(filled, "/a/two.txt") == {"/a/two.txt": b"z" * 300} and restored(filled, "/a/d") == {"/a/d/three": b"x" * 2500}
    assert filled.rename("/a/d", "/a/b/e") == "OK" and filled.rename("/a", "/a/b/x") == "EINVAL"
    assert restored(filled, "/a/b/e") == {"/a/b/e/three": b"x" * 2500}
    assert filled.delete("/a/c", 40) == 2
    with pytest.raises(FileNotFoundError):
        filled.list("/a/c")
    gone = filled.reclaim(0, 50)
    assert gone == {"entries": 2, "contents": 1, "orphan_references": 0} and sorted({r["id"] for r in filled._stored().select("id").collect()}) == sorted(
        r["id"] for r in filled._tables()[1].select("id").distinct().collect()
    )
    # The copy was the last reference to its content; its space is given out again.
    assert filled.live_bytes().first()["stored"] == 2800
    filled.ingest(files(spark, [("/f", 60, b"n" * 900)]), 61)
    assert restored(filled, "/f") == {"/f": b"n" * 900}
    filled.blacklist("/a/b", True, 70)
    assert restored(filled, "/a/b/one.txt") == {"/a/b/one.txt": bytes(2500)}
    assert {r["path"]: r["verdict"] for r in filled.check("/a").collect()}["/a/b/one.txt"] == "BLACKLISTED"


@pytest.fixture
def fresh(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.init(1)
    return Commands(repo, file_bytes=1000)


def test_single_changes(spark, fresh):
    fresh.ingest(files(spark, [("/d/f", 5, b"abcdef" * 500), ("/d/g", 6, b"gg"), ("/e/h", 7, b"hh")]), 10)
    assert fresh.read("/d/f", 2995, 100) == (b"abcdef" * 500)[2995:] and fresh.read("/d/f", 998, 5) == (b"abcdef" * 500)[998:1003] and fresh.read("/d/f", 9999, 5) == b""
    assert [fresh.make_dir(p, 20) for p in ("/d/n", "/d/n", "/d/f/x", "/no/x", "/")] == ["OK", "EEXIST", "ENOTDIR", "ENOENT", "ENOENT"]
    assert [fresh.remove(*a) for a in (("/d", 30, True), ("/d/f", 30, True), ("/none", 30, True), ("/d/n", 30, False), ("/d/n", 31, True))] == ["ENOTEMPTY", "ENOTDIR", "ENOENT", "EISDIR", "OK"]
    assert fresh.set_time("/d/g", 3, 5_000_000) == "OK" and fresh.stat("/d/g").first()["time"] == 3005
    assert fresh.set_time("/d/g", -1, 0) == "EINVAL"
    # A file replaces a file, a directory an empty one, but nothing a full one.
    assert fresh.rename("/d/g", "/e/h", 40) == "OK" and fresh.rename("/e/h", "/d", 41) == "EISDIR" and fresh.rename("/e", "/d", 41) == "ENOTEMPTY"
    assert fresh.rename("/d", "/e/copy", 42, copy=True) == "OK"
    assert restored(fresh) == {"/d/f": b"abcdef" * 500, "/e/copy/f": b"abcdef" * 500, "/e/h": b"gg"}
    assert Commands(Repository(spark, fresh.repository.base, read_only=True)).make_dir("/z", 1) == "EROFS"


def test_large_files_and_lost_pieces(spark, fresh, tmp_path):
    fresh.ingest(files(spark, [("/x/one", 5, b"x" * 2500), ("/x/two", 6, b"y" * 700), ("/none", 7, b"")]), 10)
    assert rows(fresh.export("/", f"file://{tmp_path}/out"), "path", "bytes") == [("/none", 0), ("/x/one", 2500), ("/x/two", 700)]
    assert open(f"{tmp_path}/out/x/one", "rb").read() == b"x" * 2500 and open(f"{tmp_path}/out/none", "rb").read() == b""
    two = fresh.stat("/x/two").first()["dataId"]
    from extentlake.sources.repository import rewrite_store

    rewrite_store(fresh._stored().where(F.col("id") != two), fresh.repository, 1000)
    assert rows(fresh.check("/"), "path", "verdict") == [("/none", "OK"), ("/x/one", "OK"), ("/x/two", "UNREADABLE")]


def test_sync_by_a_plan(spark, fresh):
    fresh.ingest(files(spark, [("/old/keep", 5, b"kk"), ("/old/changed", 6, b"cc"), ("/old/sub/x", 7, b"x" * 50), ("/new/sub", 8, b"s")]), 10)
    fresh.ingest(files(spark, [("/new/keep/file", 5, b"f")]), 11)
    source = spark.createDataFrame(
        [("keep", 5, 2, bytearray(b"!!")), ("changed", 9, 3, bytearray(b"ccc")), ("fresh", 1, 4, bytearray(b"four"))], "path string, time long, size long, data binary"
    )
    counts = fresh.sync(source, "/new", "/old", 20)
    # What the reference has is not read: its bytes here would be others.
    assert counts == {"REPLACE DIRECTORY, COPY REFERENCE": 1, "CREATE": 2, "bytes": 7}
    assert restored(fresh, "/new") == {"/new/keep": b"kk", "/new/changed": b"ccc", "/new/fresh": b"four", "/new/sub": b"s"}
    with pytest.raises(ValueError, match="more than once"):
        fresh.ingest(files(spark, [("/q", 1, b"1"), ("//q", 2, b"2")]), 30)
    with pytest.raises(IsADirectoryError):
        fresh.ingest(files(spark, [("/old", 1, b"1")]), 30)


def test_targets_and_references(spark, fresh):
    fresh.ingest(files(spark, [("/r/2023-01/b", 1, b"a"), ("/r/2023-05/a", 1, b"a")]), 6)
    assert fresh.target("/r/?other", 5) == "/r/other"
    with pytest.raises(FileNotFoundError):
        fresh.target("/s/t", 5)
    with pytest.raises(FileExistsError):
        fresh.target("/r/!other", 5)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert fresh.reference("/r/2023*", names("a")) == "/r/2023-05/"
    with pytest.raises(ValueError, match="few names"):
        fresh.reference("/r/2023*", names("b", "c", "d"))
    with pytest.raises(FileNotFoundError):
        fresh.reference("/nothing*")


def test_publishers_at_the_same_time(spark, fresh):
    repo = fresh.repository
    last, version, folder = repo._current()
    fresh.make_dir("/a", 1)
    with pytest.raises(OSError, match="meanwhile"):
        repo._point(last + 1, version, folder)
    assert rows(fresh.list("/"), "name") == [("a",)]


def test_dispatch(spark, tmp_path):
    from extentlake.__main__ import dispatch

    repo = f"repo=file://{tmp_path}/cli"
    dispatch(spark, ["init", repo])
    assert dispatch(spark, ["mkdir", repo, "/a"]) == "OK" and dispatch(spark, ["rename", repo, "/a", "/b", "copy=false"]) == "OK"
    assert rows(dispatch(spark, ["list", repo, "/"]), "name") == [("b",)]
    assert dispatch(spark, ["del", repo, "/b"]) == 1
    assert dispatch(spark, ["reclaim", repo, "keepdays=0"])["entries"] == 1
    for words, error in ((["list", repo], "takes 1"), (["list", "/"], "missing"), (["none"], "commands are"), (["list", repo, "/", "x=1"], "does not know"), (["reclaim", repo, "keepdays=a"], "invalid literal")):
        with pytest.raises(ValueError, match=error):
            dispatch(spark, words)
    with pytest.raises(PermissionError):
        dispatch(spark, ["mkdir", repo, "readonly=true", "/c"])
