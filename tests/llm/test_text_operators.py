"""BPE, decontamination, HTML extraction, language identification, quality: results and edge cases."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from extentlake.llm import bpe, decontam, html_extract, langid, quality
from pyspark.sql import functions as F

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n  \n", "a", "don't  stop now'll\n\n  x", "日本語テキスト。" * 40, "é" * 300, "x" * 700, "  " * 300, "1 2  3\t\t4 '’s '", "🙂👍🏽 ok" * 30]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize(("chunk", "overlap", "parallel"), [(64, 16, 120), (200, 40, 64), (bpe.CHUNK, bpe.OVERLAP, bpe.PARALLEL)])
def test_bpe_equals_the_library(spark, library, chunk, overlap, parallel):
    rng = random.Random(chunk)
    pieces = ["word", " the", "'re", "'", "  ", "\n", "\n\n", "12", "é", "日本", ".", "...", "\t", "A", "🙂", "x" * 90, " " * 70]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    df = documents(spark, texts).unionByName(documents(spark, texts[:5])).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, RANKS, PATTERN, chunk=chunk, overlap=overlap, parallel=parallel, far_overlap=min(40, bpe.FAR_OVERLAP)), RANKS, PATTERN).collect()
    assert len(got) == len(texts) + 5
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_pieces_are_the_text(library):
    own = bpe.vocabulary(RANKS, PATTERN)
    rng = random.Random(12)
    parts = ["word", " the", "'re", "'", "  ", "\n", "12", "é", ".", "\t", "🙂", "x" * 30, " " * 20]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        pieces = own.pieces(text, 50, 20)
        assert "".join(pieces) == text and [i for p in pieces for i in own.encode(p)] == library.encode_ordinary(text)


def test_bpe_of_nothing(spark):
    assert bpe.encode(documents(spark, []), RANKS, PATTERN).count() == 0


def brute_decontamination(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, text in docs:
        own = words(text)
        hit, found = set(), set()
        for item, t in items:
            w = words(t)
            n = min(size, len(w))
            for i in range(len(w) - n + 1) if w else ():
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        out[d] = (len(own), len(hit), sorted(found))
    return out


def contamination_case(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "cat", "ÉTÉ", "été", "sat", "on", "x1", "mat", "日本"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 12, 20])))) for i in range(12)] + [(50, None), (3, "cat, cat; sat!")]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "-- !"), (103, "pre " + (items[-3][1] or "").upper() + " post"), (104, " ".join(["cat"] * 5000))]
    return docs, items


@pytest.mark.parametrize(("block_bytes", "run"), [(decontam.BLOCK_BYTES, decontam.RUN), (400, 3)])
def test_decontamination(spark, monkeypatch, block_bytes, run):
    monkeypatch.setattr(decontam, "RUN", run)
    docs, items = contamination_case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.contaminated(df, bench, block_bytes=block_bytes).collect()}
    expected = brute_decontamination(docs, items)
    assert got == expected
    kept = {r["doc_id"] for r in decontam.clean(df.withColumn("item_id", F.lit(1)), bench, block_bytes=block_bytes).collect()}
    assert kept == {d for d, (_, hit, _) in expected.items() if not hit}


def test_decontamination_spans_lead_to_the_original(spark):
    df = documents(spark, ["été: Ein, ZWEI drei! vier"])
    bench = spark.createDataFrame([(1, "zwei... DREI")], "item_id long, text string")
    (row,) = decontam.contaminated(df, bench).collect()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(10, 19)]


def test_blocks_keep_repeated_and_null_keys(spark):
    docs, items = contamination_case()
    hit = items[4][1] or "cat cat sat"
    rows = [(None, hit), (None, "clean words"), (7, "clean words"), (7, "clean words"), (7, f"Pre, {hit}!"), (None, "cat, cat sat " + hit)]
    df = spark.createDataFrame([*docs, *rows], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(repr, decontam.contaminated(df, bench, block_bytes=n).collect())) for n in (decontam.BLOCK_BYTES, 400))
    assert len(one) == len(docs) + len(rows) and one == many


def test_items_without_an_id(spark, tmp_path):
    import duckdb

    from extentlake.llm import queries

    rows = [(1, "see the red fox run"), (2, "blue fish swim"), (3, "nothing here"), (4, "red fox and blue fish")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(None, "red fox"), (None, "blue fish"), (5, "blue fish"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()["op5_benchmark_decontamination"])
    names = [d[0] for d in found.description]
    got = queries.op5_benchmark_decontamination(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
    docs, bench = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark"))
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [3]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents(spark, ["a b"]), none).first()["n_hit"] == 0
    assert decontam.contaminated(documents(spark, []), none).count() == 0


PAGE = (
    "<!doctype html><html><head><title>No</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home page link</a></ul></nav>"
    '<div class="ad">Buy this now and save</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b> words<br>go on. <p>Second &lt;one&gt;'
    '<aside>not this</aside><div class="comments"><p>A reader says so</div><p>Third.</article><footer>The end of the page</footer></body></html>'
)


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(5)] + [(9, "u", None), (10, "u", ""), (11, None, "<p"), (12, "u", "<!-- x"), (13, "u", "plain words only")], "page_id long, url string, html string")
    scores = html_extract.fit(pages)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages.withColumn("text", F.lit("clash")), scores).collect()}
    assert got[0] == "Head & line First bold words go on. Second <one> Third."
    assert (got[9], got[10], got[11], got[12], got[13]) == ("", "", "", "", "plain words only")


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_run(v)
        best = max([0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])
        assert sum(v[a:b]) == best


def test_html_without_article_and_long_page(spark):
    menu = "<div>" + "<a href=x>menu</a> " * 30 + "</div>"
    body = "".join(f"<p>{'word ' * 40}</p>" for _ in range(500))
    text = html_extract.main_text(f"<body>{menu}{body}<div>{'<a>x</a>' * 20}</div></body>", html_extract.Scores())
    assert text == " ".join(["word"] * 20000)


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()


def article(rng, kind="article", inserts=True):
    """A page and its main text; ``kind`` is the element around the article."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    blocks = [say(rng.randint(2, 9)), *(say(rng.randint(20, 80)) for _ in range(rng.randint(2, 6)))]
    body = f"<h1>{blocks[0]}</h1>"
    for i, b in enumerate(blocks[1:]):
        body += f"<p>{b}</p>"
        if inserts and rng.random() < 0.5:
            body += rng.choice(['<div class="ad">{}</div>', "<aside>{}</aside>", '<form><p>{}</p></form>', '<div class="social-share">{}</div>']).format(say(rng.randint(5, 60)))
    tail = f'<section class="comments"><h2>{say(2)}</h2>' + "".join(f"<p>{say(25)}</p>" for _ in range(rng.randint(0, 6))) + "</section>"
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[: rng.randint(3, 9)])
    teasers = "".join(f"<div><a href=x>{say(4)}</a> <span>{say(3)}</span></div>" for _ in range(rng.randint(1, 5)))
    page = f"<html><head><title>{say(5)}</title></head><body><nav><ul>{menu}</ul></nav><{kind}>{body}{tail if inserts else ''}</{kind}><div>{teasers}</div><footer>{say(9)}</footer></body></html>"
    return page, " ".join(blocks)


def test_the_scan_finds_the_region(spark):
    rng = random.Random(3)
    labelled = [article(rng) for _ in range(60)]
    scores = html_extract.fit(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(labelled)], "page_id long, html string"))
    for kind in ("article", "div", "td"):
        pages = [article(rng, kind) for _ in range(60)]
        right = [html_extract.main_text(p, scores) == t for p, t in pages]
        assert sum(right) >= 0.95 * len(right), (kind, sum(right))
    # Without the scan the text outside the article would stay.
    page, text = article(rng, "div")
    found, _ = html_extract.pieces(page, scores.hints)
    everything = " ".join(" ".join(p.text.split()) for p in found if p.text.strip() and not p.place[0])
    assert everything != text


def test_names_of_boilerplate_are_learned(spark):
    rng = random.Random(5)
    pages = [(i, article(rng)[0].replace("<footer>", '<div class="zugabe">' + "mehr " * 12 + "</div><footer>")) for i in range(20)]
    scores = html_extract.fit(spark.createDataFrame(pages, "page_id long, html string"))
    assert "zugabe" in scores.hints and "zugabe" not in html_extract.Scores().hints
    # Ids of headings and sections in an article say what they are about.
    page = '<article><h2 id="related-work">Related work</h2><section id="discussion"><p>one two three</p></section><figcaption>Four</figcaption></article>'
    assert html_extract.main_text(page, scores) == "Related work one two three Four"


def test_deep_nesting_is_linear():
    import time

    def took(n):
        began = time.perf_counter()
        assert html_extract.main_text("<div class=a>" * n + "word " * 20 + "</div>" * n + "</p>" * n, html_extract.Scores()).split() == ["word"] * 20
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 30 * max(took(4000), 0.005)


def test_repeated_pages_and_large_inserts():
    for words in (5, 200):
        page = f"<article><p>{'one ' * 50}</p><div class=advert>{'buy ' * words}</div><p>{'two ' * 80}</p></article>"
        assert html_extract.main_text(page, html_extract.Scores()) == " ".join(["one"] * 50 + ["two"] * 80)


LANGS = {"xx": "kla bru tof zim", "yy": "éla öru üof ñim", "zz": "qua wex vyp jud", "uu": "abab cdcd efef ghgh", "vv": "mnop opmn pnmo nmop", "ww": "rst tsr srt str"}


def corpus(spark, langs, n=40):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(20, 60))), lang) for i, lang in enumerate([*langs] * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("count", [1, 2, 4, 6])
def test_languages_on_held_out_rows(spark, count):
    df = corpus(spark, [*LANGS][:count])
    model = langid.fit(df.where("doc_id % 7 <> 2"))
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).where("doc_id % 7 = 2").collect()
    assert got and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ² --"), (4, "q" * 3_000_000), (4, "kla")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    model = langid.fit(corpus(spark, ["xx", "zz"]))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "zz")]
    assert langid.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(odd.limit(0), model).count() == 0


def test_repeated_rows_and_many_labels(spark, monkeypatch):
    df = corpus(spark, ["xx", "zz"])
    seen = []
    kept = langid.map_rows

    def counted(rows, schema, fn):
        seen.append(rows.count())
        return kept(rows, schema, fn)

    monkeypatch.setattr(langid, "map_rows", counted)
    model = langid.fit(df.unionByName(df.where("doc_id < 4").crossJoin(spark.range(200)).drop("id")), per_label=30)
    assert seen == [60] and model.labels == ["xx", "zz"]
    # Only the most frequent labels are learned; one key may have several texts and labels.
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    rare = spark.createDataFrame([(1, f"rare {i}", f"l{i}") for i in range(50)] + [(1, None, "xx"), (None, "kla", "xx"), (2, "kla", None)], df.schema)
    assert langid.fit(df.unionByName(rare)).labels == ["xx", "zz"]


def test_language_equals_brute_force(spark):
    """The query's rows by one profile and one decoding a document."""
    df = corpus(spark, [*LANGS][:4])
    model = langid.fit(df)
    for r in langid.predict(df, model).collect():
        best, score = model.decode(np.stack([langid.profile(r["text"])]))
        losses = []
        for c in range(len(model.labels)):
            bits = np.append(langid.profile(r["text"]), 1) @ model.weights
            losses.append(sum(t * np.log1p(np.exp(-min(30, max(-30, w * b)))) for t, w, b in zip(model.trust[c], model.code[c], bits)))
        low = sorted(losses)
        assert r["lang_pred"] == model.labels[int(np.argmin(losses))] == model.labels[best[0]]
        assert r["score"] == pytest.approx((low[1] - low[0]) / (low[0] + low[1]), abs=1e-4) == pytest.approx(score[0], abs=1e-4)


def test_codewords_differ():
    for n in (2, 3, 5, 6, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "green", "under", "morning"]) + rng.choice(["", "s", "ed"]) for _ in range(60))
    bad = lambda: " ".join([rng.choice(["buy$$$", "win***"])] * 60)
    rows = [(i, good() if i % 3 else bad(), "en", f"s{i % 5}") for i in range(400)] + [(1000, None, None, None), (1001, "", "en", "s1"), (7, good(), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    scorers = quality.fit(docs, labels, ["quality", "toxic"])
    got = {r["doc_id"]: r["scores"] for r in quality.score(docs, scorers).collect()}
    held_out = [i for i in range(1, 400, 2)]
    right = [(got[i][0][2] > 0.5) == (i % 3 != 0) for i in held_out]
    assert sum(right) >= 0.95 * len(right), sum(right)
    assert all(0 <= s <= 1 for v in got.values() for views in v for s in views) and got[5][1][2] == 0.0
    assert quality.score(docs.limit(0), scorers).count() == 0
    assert quality.fit(docs, labels.limit(0), ["quality"])[0].prior == 0.5


def test_quality_of_repeated_keys(spark, monkeypatch):
    rows = [(i, f"text {i}", "en", "s") for i in range(20)] + [(3, f"other {i}", "en", "s") for i in range(500)] + [(None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("label", F.lit("clash")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1)] * 50 + [(99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    seen = []
    kept = quality._views

    def counted(found):
        out = kept(found)
        seen.append(len(out[0]))
        return out

    monkeypatch.setattr(quality, "_views", counted)
    scorer = quality.fit(docs, labels, ["quality"])
    assert seen == [20]
    got = quality.score(docs, scorer).collect()
    assert len(got) == len(rows) and all(0 <= x <= 1 for r in got for v in r["scores"] for x in v)


def test_quality_equals_brute_force(spark):
    """The scores of single documents by plain arithmetic on the fitted weights."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["up", "down", "$$$", "9"]) for _ in range(30)) + (" bad" * 9 if i % 2 else ""), "en", f"s{i % 3}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    (scorer,) = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int"), ["quality"])
    squash = lambda z: 1 / (1 + np.exp(-z))
    for r in quality.score(docs, [scorer]).collect():
        _, text, lang, source = rows[r["doc_id"]]
        x, m = quality.text_view(text), quality.meta_view(source, lang, len(text))
        own = [float(np.append(v, 1) @ w[:, 0]) for v, w in ((x, scorer.text), (m, scorer.meta))]
        calibrated = [z * a + b for z, (a, b) in zip(own, scorer.platt)]
        both = float(np.append(calibrated, 1) @ scorer.mixed[:, 0])
        assert list(r["scores"][0]) == pytest.approx([squash(calibrated[0]), squash(calibrated[1]), squash(both)], abs=1e-4)


def test_every_document_is_in_a_pool(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda: " ".join(rng.choice(["river", "stone", "under"]) for _ in range(20))
    rows = [(i, words(), "en", f"s{i % 5}") for i in range(2300)] + [(None, "no key", "en", "s0")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    kept = quality._pooled

    def pooled(found, tasks, pool):
        seen.append((found.count(), found.where("key IS NULL").count()))
        return kept(found, tasks, pool)

    monkeypatch.setattr(quality, "_pooled", pooled)
    one, again, many = (quality.fit(d, labels, ["quality"], pool=n)[0] for d, n in ((docs, 5000), (docs.repartition(7), 5000), (docs, 500)))
    assert seen == [(2303, 3)] * 3
    assert np.array_equal(one.text, again.text) and np.array_equal(one.meta, again.meta)
    assert one.text.shape == many.text.shape and not np.array_equal(one.text, many.text)
    # Documents beyond the first thousands teach, too.
    fewer = quality.fit(docs.where("doc_id < 2200"), labels, ["quality"], pool=5000)[0]
    assert not np.array_equal(one.text, fewer.text)


def test_hashes_of_the_contract(spark, library):
    text = "Ein Test, zwei Tests."
    row = bpe.encode(documents(spark, [text]), RANKS, PATTERN).select(F.sha2("ids", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
