from datetime import datetime

import pytest

from extentlake.functions import patterns
from extentlake.model import TREE_ENTRIES
from extentlake.operators import checks, edits, ingest, maintenance, tree
from pyspark.sql import functions as F


def entries(spark, rows):
    return spark.createDataFrame(rows, TREE_ENTRIES)


@pytest.fixture
def small(spark):
    return entries(
        spark,
        [
            (0, 0, "", 1, 0, None),
            (1, 0, "dir1", 1, 0, None),
            (2, 1, "dir2", 1, 0, None),
            (3, 2, "file1", 1, 0, 10),
            (4, 1, "old", 1, 50, None),
            (5, 4, "lost", 1, 0, 11),
        ],
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_paths(small):
    assert rows(tree.paths(small), "id", "path") == [(0, "/"), (1, "/dir1/"), (2, "/dir1/dir2/"), (3, "/dir1/dir2/file1")]
    assert rows(maintenance.deleted_paths(small), "id") == [(5,)]


def test_resolve(spark, small):
    wanted = spark.createDataFrame([("/",), ("dir1//dir2/",), ("/dir1/dir2/file1",), ("/DIR1",), ("/dir1/old",)], "path string")
    got = {r["path"]: r["id"] for r in tree.resolve(small, wanted).collect()}
    assert got == {"/": 0, "dir1//dir2/": 2, "/dir1/dir2/file1": 3, "/DIR1": None, "/dir1/old": None}


def test_cycle_is_found(spark):
    bad = entries(spark, [(0, 0, "", 1, 0, None), (1, 2, "a", 1, 0, None), (2, 1, "b", 1, 0, None)])
    assert rows(tree.cycles(bad), "id") == [(1,), (2,)]
    with pytest.raises(ValueError, match="cycle"):
        tree.descend(bad.where("id = 1").select("id", F.lit(0).alias("depth")), bad, F.col("_p") + 1, ["depth"], 8)


def test_make(spark, small):
    asked = [(1, 1, "new", 5, None), (2, 1, "new", 5, None), (3, 9, "x", 5, None), (4, 1, "", 5, None), (5, 3, "x", 5, None), (6, 1, "dir2", 5, 7), (7, 1, "a:b", 5, 7), (8, 0, "f", 5, 7)]
    requests = spark.createDataFrame(asked, "request long, parentId long, name string, time long, dataId long")
    after, answers = edits.make(small, requests, 100)
    assert {r["request"]: r["outcome"] for r in answers.collect()} == {1: "OK", 2: "EEXIST", 3: "ENOENT", 4: "EINVAL", 5: "ENOTDIR", 6: "EEXIST", 7: "EINVAL", 8: "OK"}
    assert rows(after.where("id >= 100"), "id", "parentId", "name") == [(100, 1, "new"), (101, 0, "f")]


def test_rename_guards(spark, small):
    asked = [(1, 2, 1, "dir2"), (2, 1, 2, "under"), (3, 0, 1, "root"), (4, 77, 1, "none"), (5, 3, 1, "moved")]
    after, answers = edits.rename(small, spark.createDataFrame(asked, "request long, id long, parentId long, name string"))
    assert {r["request"]: r["outcome"] for r in answers.collect()} == {1: "OK", 2: "EINVAL", 3: "ENOENT", 4: "ENOENT", 5: "OK"}
    assert rows(after.where("id = 3"), "parentId", "name") == [(1, "moved")]


def test_reclaim(spark, small):
    day = maintenance.DAY_MILLIS
    # The cut is far in the past even for many days: no overflow.
    assert rows(maintenance.purged(small, 40, 40 * day + 50), "id") == [(4,), (5,)]
    assert rows(maintenance.purged(small, 40, 40 * day + 49), "id") == []
    contents = spark.createDataFrame([(10, 1, 5, 0, 5, "a"), (11, 1, 4, 5, 7, "b"), (11, 2, None, 9, 11, None)], "id long, seq int, length long, start long, stop long, hash string")
    kept, held = maintenance.reclaim(small, contents, 0, 100)
    assert rows(kept, "id") == [(0,), (1,), (2,), (3,)]
    # All parts of an orphan go.
    assert rows(held, "id") == [(10,)]


def test_deleted_root_purges_nothing(spark):
    gone = entries(spark, [(0, 0, "", 1, 5, None), (1, 0, "a", 1, 0, None)])
    assert maintenance.purged(gone, 0, 100).count() == 0
    assert rows(maintenance.deletable(entries(spark, [(0, 0, "", 1, 0, None)])), "id") == []


def test_blacklist(spark):
    te = entries(
        spark,
        [(0, 0, "", 1, 0, None), (1, 0, "blacklist", 1, 0, None), (2, 1, "black1", 1, 0, 9), (3, 1, "black2", 1, 0, 9), (4, 0, "dir1", 1, 0, None), (5, 4, "file1", 1, 0, 9)],
    )
    de = spark.createDataFrame([(9, 1, 10, 10, 15, "h"), (9, 2, None, 15, 20, None)], "id long, seq int, length long, start long, stop long, hash string")
    for copies, deleted in ((False, []), (True, [(5,)])):
        after, held = maintenance.blacklist(te, de, 1, copies, 77)
        assert rows(after.where("deleted <> 0"), "id") == deleted
        assert rows(held, "id", "seq", "length", "start", "stop") == [(9, 1, 10, 0, 0)]


def test_blacklist_ingest(spark):
    files = spark.createDataFrame([(1, "a", 12), (2, "b", 13), (3, "a", 12)], "file long, hash string, length long")
    known = spark.createDataFrame([], "id long, hash string, length long")
    got = rows(maintenance.add_to_blacklist(files, known, 50), "id", "length", "start", "stop")
    assert got == [(50, 12, 0, 0), (51, 13, 0, 0)]


def test_constraints(spark, small):
    found = {r["rule"] for r in checks.tree_violations(small).collect()}
    assert found == {"live below live"}
    with pytest.raises(ValueError, match="live below live: 5"):
        checks.ensure(checks.tree_violations(small))
    checks.ensure(checks.tree_violations(small), {"live below live"})
    bad = spark.createDataFrame(
        [(1, 1, 5, 0, 5, "a"), (2, 1, 9, 3, 8, "b"), (3, 2, 4, 20, 19, None)], "id long, seq int, length long, start long, stop long, hash string"
    )
    assert {r["rule"] for r in checks.data_violations(bad).collect()} == {
        "no overlap", "part bounds", "length and hash with the first part only", "stored size", "parts without gaps in their numbers",
    }


def test_globs():
    import re

    pattern = patterns.glob_to_regex("no?es-*(1).txt")
    assert all(re.match(pattern, x) for x in ("notes-(1).txt", "nodes-of may (1).txt"))
    assert not any(re.match(pattern, x) for x in ("noes-(1).txt", "notes-1.txt", "notes-(1).txt~", "my notes-(1).txt", "notes-(1)xtxt"))
    assert patterns.glob_to_like("a_%*?") == "a\\_\\%%_"
    rules = patterns.parse_rules(["  ", "build/*/out?/", "#todo/x", " *.tmp\t"])
    assert [r.levels for r in rules] == [("build", "*", "out?/"), ("*.tmp",)]


def test_ignored(spark):
    rules = patterns.parse_rules(["src*/*.bak", "cache/", "/top", "c++"])
    paths = ["src1/x.bak", "src1/x.py", "src/deep/x.bak", "cache/", "cache/a/b", "caches/b", "top", "c++", "ccc"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    hit = {r["path"] for r in df.where(patterns.ignored(F.col("path"), rules)).collect()}
    assert hit == {"src1/x.bak", "cache/", "cache/a/b", "c++"}


def test_targets_and_options():
    now = datetime(2022, 12, 31, 23, 5)
    assert patterns.target_path(r"/x[yyyy.MM.dd_HH-mm]\[a\]", now) == "/x2022.12.31_23-05[a]"
    target = patterns.parse_target("/archive/?new/!fresh")
    assert target.elements == ("archive", "new", "fresh") and target.may_create == (False, True, True) and target.must_be_new
    assert patterns.parse_options(["Repo=/x=y", r"a\=b", "find"]) == ({"repo": "/x=y"}, ["a=b", "find"])


def test_reference(spark, small):
    assert rows(ingest.latest_reference(small, ["dir?", "*"]), "id") == [(2,)]
    assert rows(ingest.latest_reference(small, ["none"]), "id") == []
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert ingest.similarity(names("a", "b"), names("a", "c")).first()["accepted"]
    assert not ingest.similarity(names("a", "b", "c"), names("a")).first()["accepted"]
