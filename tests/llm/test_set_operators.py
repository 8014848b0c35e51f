"""WARC packages, fingerprints, line dedup, Jaccard join, components, sharding: results and edge cases."""

import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from extentlake.llm import common, components, iblt, line_dedup, ngram_join, sharding, shingling, warc
from pyspark.sql import functions as F


def test_archives(spark):
    big, other = "<p>é</p>" * 200, "<p>x</p>" * 300
    rows = [(1, "u1", big), (2, "u2", big), (5, "u\n5", big), (3, None, other), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", other), (9, "u", "z" * 3_000_000), (5, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    packages = warc.write_packages(df, warc.shared_path(spark, "test"), package_bytes=2000)
    assert packages.count() > 1
    got = warc.read_packages(packages, range_bytes=3000).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[2] or "" for r in rows}
    for r in got:
        k = None if r["key"] is None else int(r["key"])
        data = (other if k is None else text[k]).encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        expected = {1: "5", 2: "5", None: "3"}.get(k)
        assert r["refers_to"] == expected and r["record_type"] == ("revisit" if expected else "response")
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (None if expected else data)
    assert warc.round_trip(df.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data, self.most = data, 0

    def read_at(self, n, at):
        self.most = max(self.most, n)
        return self.data[at : at + n]


def package(data):
    return warc.Package(Bytes(data), len(data))


def records(n):
    return [(warc.record_bytes(str(i), "u", 3, hashlib.sha1(b"abc").hexdigest(), None, b"abc"), str(i), "u") for i in range(n)]


def test_package_directories():
    data = warc.memory_package(records(5))
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    found = list(package(data).ranges())
    assert len(found) == 5
    # A comment behind the directory, even one with the record's own mark.
    sink = io.BytesIO(data)
    with zipfile.ZipFile(sink, "a") as z:
        z.comment = b"PK\x05\x06" + b"c" * 100
    assert list(package(sink.getvalue()).ranges()) == found
    with pytest.raises(ValueError, match="not a ZIP"):
        package(b"nothing").members()


def test_zip64_directory_and_missing_index():
    data = warc.memory_package(records(4))
    pack = package(data)
    offset, length, entries = pack.directory()
    # The same package with ZIP64 records in place of the short ones.
    wide = bytearray(data[: offset + length])
    at = len(wide)
    wide += b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + bytes(8) + entries.to_bytes(8, "little") * 2 + length.to_bytes(8, "little") + offset.to_bytes(8, "little")
    wide += b"PK\x06\x07" + bytes(4) + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
    wide += b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    assert package(bytes(wide)).directory() == (offset, length, entries)
    assert list(package(bytes(wide)).ranges()) == list(pack.ranges())
    member = next(m for m in pack.members() if m.name == warc.ARCHIVE)
    raw = pack.read(pack.data_at(member), member.size)
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc.ARCHIVE, raw)
    assert [n for _, n in package(bare.getvalue()).ranges()] == [n for _, n in pack.ranges()]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, raw)
    with pytest.raises(ValueError, match="compressed"):
        list(package(packed.getvalue()).ranges())


def test_peeling_recovers_differences():
    rng = np.random.default_rng(1)
    a, b = [], []
    for n in (0, 1, 5, 60, 900):
        common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a.append(np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)])))
        b.append(np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)])))
    for x, y, (only_x, only_y) in zip(a, b, iblt.differences(a, b)):
        assert np.array_equal(only_x, np.setdiff1d(x, y)) and np.array_equal(only_y, np.setdiff1d(y, x))


def test_versions(spark):
    rng = random.Random(4)
    texts = {i * 7 - 30: "\n".join(" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))) for i in range(60)}
    texts |= {500: None, 501: "", 502: "été" * 50_000, 503: texts[5]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("key", F.lit(1))
    for rows in (3, 1000):
        got = {r["doc_id"]: r for r in iblt.versions(df, bucket_rows=rows).collect()}
        order = sorted(texts, reverse=True)
        assert sorted(got) == sorted(texts)
        for k, nxt in zip(order, order[1:] + order[:1]):
            t, n = texts[k] or "", len(texts[k] or "") // 3
            changed = t[: len(t) - n] + (texts[nxt] or "")[:n]
            assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            sets = [set(iblt.digests(x).tolist()) for x in (t, changed, texts[nxt])]
            for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
                union = len(sets[0] | other)
                assert got[k][name] == pytest.approx(len(sets[0] & other) / union if union else 1.0)
        assert got[500]["fingerprint"] == got[501]["fingerprint"] and got[5]["fingerprint"] == got[503]["fingerprint"]
    assert iblt.versions(df.limit(0)).count() == 0


def test_versions_of_repeated_and_null_keys(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "c"), (2, "d"), (None, "e"), (None, None)]
    got = iblt.versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert iblt.versions(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).first()["near_next"] == 1.0


def lines_brute(docs):
    seen, inv, out = [], defaultdict(list), defaultdict(list)
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            words = frozenset(x for x in line.lower().split(" ") if x)
            if not regex.search(r"[\p{L}\p{N}]", line):
                continue
            counts = Counter(j for w in words for j in inv[w])
            if any(5 * c >= 4 * (len(words) + len(seen[j]) - c) for j, c in counts.items()):
                out[d].append(i)
            for w in words:
                inv[w].append(len(seen))
            seen.append(words)
    return dict(out)


def line_case():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", ", "]).join(words))
        lines += ["", "***", "THE SAME LINE"][: rng.randint(0, 3)]
        docs.append((d, "\n".join(lines)))
    return [*docs, (90, None), (91, ""), (92, "\n\n"), (93, " ".join(f"u{i}" for i in range(4700))), (None, "the same line\nalone " + "z " * 5000)]


def test_line_dedup(spark):
    docs = line_case()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit("clash")).withColumn("removed_lines", F.lit(0))
    found = {(None if r["doc"] == -(1 << 63) else r["doc"]): list(r["lines"]) for r in line_dedup.removed_lines(df, bins=64).collect()}
    expected = lines_brute(docs)
    assert found == expected
    kept = {r["doc_id"]: r for r in line_dedup.without_repeats(df, bins=64).collect()}
    for d, text in docs:
        if d not in expected:
            assert kept[d]["text"] == text and kept[d]["lines"] == "clash"
        else:
            rest = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected[d])
            assert (kept[d]["text"] == rest) if regex.search(r"[\p{L}\p{N}]", rest) else d not in kept
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a b c\nd"), (1, "a b c\nd"), (2, "c b a")], "doc_id long, text string")
    assert [(r["doc"], list(r["lines"])) for r in line_dedup.removed_lines(df, bins=16).collect()] == [(2, [0])]


def test_rows_of_one_key_or_none_are_told_apart(spark):
    def left(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(line for r in line_dedup.without_repeats(docs).collect() for line in r["text"].split("\n"))

    for key in (None, 7):
        texts = ["x\nunique words here", "q\nx", "other words\nlast line"]
        assert left([(key, t) for t in texts]) == ["last line", "other words", "q", "unique words here", "x"]
    # Repeats at the same line number, and a null key beside the least one.
    assert left([(None, "a b\nc d"), (None, "a b\ne f"), (-(1 << 63), "a b\nc d")]) == ["a b", "c d", "e f"]


def test_sketches_rule_out_pairs_inside_the_join(spark):
    rng = random.Random(5)
    # All lines share their prefixes, but each near copy is only similar to its source.
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    lines = [["rare1", "rare2", "rare3", *own(n)] for n in (30, 40, 60, 70, 90, 120, 150) for _ in range(8)]
    near = [[*lines[k][:-2], "x", "y"] for k in (0, 8, 16, 24, 32, 40, 48)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*lines, *near])], "doc_id long, text string")
    with common.Scratch(spark) as scratch:
        levels = scratch.written(line_dedup._levels(docs, "text", 64), "rarity")
        found = line_dedup._distinct(line_dedup._lines(docs, "doc_id", "text"), levels, 64, 80, 100)
        first = F.struct(F.col("first.doc").alias("doc"), F.lit(0).cast("long").alias("own"))
        found = scratch.written(found.withColumn("first", first).withColumn("id", F.col("first.doc")).withColumn("prefix", F.array(F.lit(1), F.lit(2))), "lines")
        pairs = [tuple(r) for r in line_dedup._rest(found, found, 80, 100, scratch).select("a", "b").collect()]
    assert sorted(pairs) == [(k, len(lines) + i) for i, k in enumerate((0, 8, 16, 24, 32, 40, 48))]


def test_pairs_do_not_grow_with_the_square_of_a_cluster(spark, monkeypatch):
    rng = random.Random(8)
    source = [f"w{i}" for i in range(60)]
    made = []
    written = common.Scratch.written

    def counted(scratch, df, name):
        found = written(scratch, df, name)
        if name in ("met", "groups"):
            made.append(found.count())
        return found

    def near(words):
        # New words are the rarest, so that the copies share no neighbours among these.
        found = list(words)
        for k in rng.sample(range(len(found)), 3):
            found[k] = f"x{rng.randrange(10**9)}"
        return " ".join(found)

    monkeypatch.setattr(common.Scratch, "written", counted)
    monkeypatch.setattr(line_dedup, "HUBS", 16, raising=False)
    monkeypatch.setattr(line_dedup, "STEP", 4, raising=False)
    rows = [(i, near(source)) for i in range(400)] + [(400 + i, " ".join(f"y{rng.randrange(10**9)}" for _ in range(20))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc"]: list(r["lines"]) for r in line_dedup.removed_lines(docs, bins=1 << 12).collect()}
    assert found == lines_brute(rows)
    # All pairs of the cluster would be 79,800, each once for every shared prefix word.
    assert 0 < sum(made) < 100_000


def test_line_dedup_leaves_out_words_that_occur_once(spark, monkeypatch):
    rng = random.Random(3)
    common_words = [f"c{i}" for i in range(300)]
    sources = [[rng.choice(common_words) for _ in range(rng.randint(4, 90))] for _ in range(60)]
    rows = []
    for i in range(400):
        words = list(rng.choice(sources))
        # Copies are longer or shorter than their sources, by as many words as the threshold allows and some more.
        k = rng.randint(0, len(words) // 4 + 1)
        words = words[k:] if rng.random() < 0.5 else [*words, *(rng.choice([f"once{i}x{j}", rng.choice(common_words)]) for j in range(k))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joins, scans = [], []
    written, matched = common.Scratch.written, line_dedup._matched

    def seen(scratch, df, name):
        if name == "met":
            joins.append(name)
        if name == "lines":
            found = df.collect()
            # What occurs once has no partner.
            lines = {r["first"]["doc"]: r for r in found}
            counts = Counter(w for _, text in rows for w in text.split())
            for i, text in rows:
                if i in lines:
                    size = len(set(text.split()))
                    once = sum(counts[w] == 1 for w in set(text.split()))
                    assert len(lines[i]["prefix"]) == max(0, size - -(-size * 4 // 5) + 1 - once)
        return written(scratch, df, name)

    monkeypatch.setattr(common.Scratch, "written", seen)
    monkeypatch.setattr(line_dedup, "_matched", lambda *args: scans.append(1) or matched(*args))
    monkeypatch.setattr(line_dedup, "HUBS", 4)
    monkeypatch.setattr(line_dedup, "STEP", 2)
    found = {r["doc"]: list(r["lines"]) for r in line_dedup.removed_lines(docs, bins=1 << 22).collect()}
    assert found == lines_brute(rows)
    # The candidates of all rounds against shares of the lines are compared at once, those of the last join in two steps.
    assert len(scans) == 3 and len(joins) > 5


def test_line_dedup_looks_up_and_rates_only_lines_in_question(spark, monkeypatch):
    words = lambda k: [f"v{k}x{j}" for j in range(9)]
    # 200 lines of their own, a line there twice and a near copy.
    rows = [(k, " ".join(words(k))) for k in range(200)] + [(200, " ".join(words(0))), (201, " ".join([*words(1), "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, rated, collected = [], [], []
    written, touched, collect = common.Scratch.written, getattr(line_dedup, "_touched", None), getattr(line_dedup, "collect_garbage", None)

    def seen(scratch, df, name):
        names.append(name)
        return written(scratch, df, name)

    def counted(*args):
        found = touched(*args)
        rated.append(found.count())
        return found

    monkeypatch.setattr(common.Scratch, "written", seen)
    monkeypatch.setattr(line_dedup, "_touched", counted, raising=False)
    monkeypatch.setattr(line_dedup, "collect_garbage", lambda spark: collected.append(1) or collect(spark), raising=False)
    found = {r["doc"]: list(r["lines"]) for r in line_dedup.removed_lines(docs, bins=1 << 12).collect()}
    assert found == lines_brute(rows) == {200: [0], 201: [0]}
    # Nothing is gone yet before the only round, so nothing is looked up; the last join gets the lines in question, not all of them.
    assert "stay" not in names and rated == [2] and collected


def test_ranks_of_words_are_sorted_as_plain_longs(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with common.Scratch(spark) as scratch:
        levels = scratch.written(line_dedup._levels(docs, "text", 64), "rarity")
        plan = line_dedup._distinct(line_dedup._lines(docs, "doc_id", "text"), levels, 64, 80, 100)._jdf.queryExecution().analyzed()
        types = []

        def walk(node):
            for e in (node.expressions().apply(i) for i in range(node.expressions().size())):
                stack = [e]
                while stack:
                    x = stack.pop()
                    if x.nodeName() == "SortArray":
                        types.append(x.dataType().containsNull())
                    stack += [x.children().apply(i) for i in range(x.children().size())]
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
    assert types == [False]


def test_empty_parts_give_no_keys():
    rng = np.random.default_rng(4)
    join = ngram_join.Join(5, 80, 100)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sets = [draw(n) for n in (5, 9, 14, 18, 30) for _ in range(400)]
    owners, keys = join.keys(sets)
    _, shared = np.unique(np.unique(np.stack([keys, owners.astype(np.uint64)]), axis=1)[0], return_counts=True)
    assert (shared * (shared - 1) // 2).sum() < 20
    # Similar sets still meet: some shingles are replaced, as many as the threshold allows.
    for x in sets:
        both = 2 * len(x)
        y = np.unique(np.concatenate([x[join.differ(both) // 2 :], draw(join.differ(both) // 2)]))
        less = x[: max(1, -(-len(x) * 4 // 5))]
        owners, keys = join.keys([x, y, less])
        of = [set(keys[owners == k].tolist()) for k in range(3)]
        assert len(x) == len(y) and (of[0] & of[1] or np.array_equal(x, y)) and of[0] & of[2]


def groups_brute(docs, size, num, den):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_join(spark, size, num):
    rng = random.Random(num)
    docs, n = [], 0
    for _ in range(25):
        base = [f"W{rng.randint(0, 400)}" for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 200, 500]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
            docs.append((n, rng.choice([" ", "\t\n"]).join(words)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, docs[0][1]), (n + 4, "a b c"), (n + 5, "日 本 語 テ キ")]
    # Longer than a piece, and longer sketches.
    long_words = [f"L{i}" for i in range(250_000)]
    docs += [(n + 6, " ".join(long_words)), (n + 7, " ".join(long_words[5000:])), (n + 8, " ".join(long_words[::-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, size=size, num=num).collect()}
    assert got == groups_brute(docs, size, num, 100)


def test_jaccard_join_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.similar_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (None, None)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == {(3, 3): 2, (None, 3): 1, (9, 3): 1, (None, None): 1}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(base[: 40 - rng.randint(0, 8)] + [f"own{i}"] * rng.randint(0, 1))) for i in range(400)]
    docs += [(1000 + i, " ".join(base[rng.randint(0, 12) :])) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=4, num=85).collect()}
    assert got == groups_brute(docs, 4, 85, 100)


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    join = ngram_join.Join(4, 85, 100)
    for n in (7, 12, 40, 300, 2000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            differ = int(join.differ(2 * len(x)))
            cut = rng.integers(0, differ // 2 + 1)
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64) * np.uint64(2)]))
            if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) and not np.array_equal(x, y):
                owners, keys = join.keys([x, y])
                assert np.intersect1d(keys[owners == 0], keys[owners == 1]).size
                assert ngram_join.apart(*map(ngram_join.sketch, (x, y))) <= len(np.setxor1d(x, y))


def test_shingles_do_not_depend_on_batches():
    rng = random.Random(2)
    texts = [None, "", "  ", *(" ".join(rng.choice(["Aa", "bé", "c", "dd"]) for _ in range(rng.randint(0, 30))) for _ in range(50)), "x " * 700_000 + "y"]
    column = pa.array(texts, pa.string())
    whole = shingling.shingle_sets(column, 4)
    assert all(np.array_equal(a, shingling.shingle_sets(column[i : i + 1], 4)[0]) for i, a in enumerate(whole))
    assert len(whole[-1]) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    with common.Scratch(spark) as scratch:
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_shuffle(spark):
    rows = [(i, "x") for i in range(1003)] + [(None, None)] * 5 + [(7, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_cell", F.lit(1))
    got = sharding.shuffle(df, 8, key=["doc_id", "text"], seed=3, blocks=16, cells=4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(len(s) for s in slots.values()) == sorted(len(rows) // 8 + (j < len(rows) % 8) for j in range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle(df, 8, key=["doc_id", "text"], seed=3, blocks=16, cells=4).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)
    other = sharding.shuffle(df, 8, key=["doc_id", "text"], seed=4, blocks=16, cells=4).collect()
    assert sorted((r["doc_id"] or 0, r["shard"]) for r in other) != sorted((r["doc_id"] or 0, r["shard"]) for r in got)
    assert sharding.shuffle(df.limit(0), 8, key=["doc_id"]).count() == 0


def test_equal_rows_are_spread(spark):
    rows = [(1, "same")] * 300 + [(i, "x") for i in range(2, 502)]
    got = sharding.shuffle(spark.createDataFrame(rows, "doc_id long, text string"), 8, key=["doc_id", "text"], blocks=16, cells=4).collect()
    for shard in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == shard and r["doc_id"] == 1)
        assert 20 <= len(own) <= 56 and own[-1] - own[0] > 1.5 * len(own)


def test_large_urns_follow_the_law():
    rng, other = np.random.default_rng(1), np.random.default_rng(2)
    for good, bad, draws in ((300, 500, 90), (20, 3, 11), (1000, 7, 400)):
        mine = [sharding._hypergeometric(rng, good, bad, draws, urn=1) for _ in range(4000)]
        theirs = other.hypergeometric(good, bad, draws, 4000)
        assert min(mine) >= max(0, draws - bad) and max(mine) <= min(good, draws)
        assert abs(np.mean(mine) - draws * good / (good + bad)) < 5 * np.std(theirs) / 4000**0.5 and abs(np.std(mine) / np.std(theirs) - 1) < 0.08
    n = sharding._hypergeometric(rng, 10**12, 7 * 10**12, 10**9)
    assert abs(n - 125_000_000) < 10 * 10_000


def test_communication_matrix_follows_its_law():
    counts, sizes = [30, 0, 50, 20], [40, 35, 25]
    total = np.zeros((4, 3))
    for seed in range(2000):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and m.min() >= 0
        total += m
    assert np.allclose(total / 2000, np.outer(counts, sizes) / 100, atol=0.25)
    big = sharding.communication_matrix([3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], 1)
    assert abs(big[0, 0] - 1.5e9) < 1e6 and big.sum() == 4 * 10**9
