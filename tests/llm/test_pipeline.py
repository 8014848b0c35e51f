import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import regex
from test_set_operators import groups_brute, lines_brute
from test_text_operators import LANGS, brute_decontamination, library  # noqa: F401

from extentlake.llm import langid


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.schema == docs.schema
        docs = made
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass(spark, sf, empty):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", None, "s", 11), (2, "a b c d e f", None, "s", 11), (3, "the of and " * 5, "en", None, 55)]
    docs = spark.createDataFrame([] if empty else rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert docs.count() == 0 if empty else docs.count() >= 1


def test_one_row_of_each_group(spark, sf):
    long_text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long_text), (2, long_text), (3, long_text), (None, long_text + " end"), (None, "other " * 3), (None, "other " * 3), (5, ""), (5, ""), (6, ""), (5, "own words of this row alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(2, long_text), (None, "other " * 3), (5, ""), (6, ""), (5, "own words of this row alone")]))


def test_run_equals_brute_force(spark, tmp_path, library):  # noqa: F811
    rng = random.Random(21)
    say = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "x", "y", "z"]) * rng.randint(0, 3) for _ in range(n))
    exam = [say("xx", 14), say("zz", 30)]
    rows = []
    for i in range(50):
        lang = rng.choice(["xx", "zz"])
        text = "\n".join(say(lang, rng.randint(5, 30)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, lang))
        for _ in range(rng.choice([0, 0, 1, 2])):
            # A near copy whose lines differ by more than the line dedup takes, joined into one line.
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((100 + len(rows), " ".join(words), lang))
    rows += [(400, "pre " + exam[0] + " post " + say("xx", 9), "xx"), (401, rows[0][1], "xx"), (402, rows[3][1].split("\n")[0] + "\n" + say("zz", 20), "zz")]
    rows += [(403, None, None), (404, "", "xx"), (405, "12 34", "zz"), (406, "kla", None), (1, say("xx", 25), "xx"), (None, say("zz", 25), None), (406, "kla", None)]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(exam)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = langid.predict(spark.read.parquet(f"{tmp_path}/documents.parquet"), langid.fit(docs)).where("lang_pred <> 'und' AND NOT ambiguous")
    # Rows that repeat key and text are one document to the line dedup.
    left = dict.fromkeys((r["doc_id"], r["text"]) for r in kept.collect())
    order = {r: i for i, r in enumerate(sorted(left, key=lambda x: (x[0] is not None, x[0] or 0)))}
    gone = lines_brute([(order[r], r[1]) for r in left])
    texts = {}
    for r, i in order.items():
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(i, []))
        if i not in gone or regex.search(r"[\p{L}\p{N}]", text):
            texts[i] = (r[0], text)
    # Null keys come last in a group.
    ranked = {i: k for k, i in enumerate(sorted(texts, key=lambda i: (texts[i][0] is None, texts[i][0] or 0)))}
    groups = groups_brute([(ranked[i], t) for i, (_, t) in texts.items()], 5, 80, 100)
    one = {i: texts[i] for i in texts if groups[ranked[i]][1] == ranked[i] or not groups[ranked[i]][0]}
    hits = brute_decontamination([(i, t) for i, (_, t) in one.items()], list(enumerate(exam)))
    expected = Counter()
    for i, (d, t) in one.items():
        if not hits[i][1]:
            ids = library.encode_ordinary(t)
            expected[d, len(ids), np.array(ids, "<u4").tobytes()] += 1
    assert got == expected and len(texts) > len(one) > sum(expected.values()) > 30
