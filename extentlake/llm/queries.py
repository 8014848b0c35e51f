"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, iblt, langid, line_dedup, ngram_join, quality, sharding, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, pattern, keep_text=False)
    decoded = bpe.decode(encoded, ranks, pattern)
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = dict(zip(line_dedup.NAMES, line_dedup.names()))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    counted = docs.select("doc_id", n_lines.alias("n_lines"), *(c.alias(n) for n, c in named.items()))
    none = F.array().cast("array<int>")
    found = line_dedup.with_removed(counted, line_dedup.removed_lines(docs), tuple(F.col(n) for n in named), "lines")
    return found.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("lines", none).alias("removed_lines"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good, toxic = quality.fit(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    scored = quality.score(docs, [good, toxic])

    def one(scorer: int, view: int) -> F.Column:
        return F.col("scores")[scorer][view]

    return scored.select(
        "doc_id",
        one(0, 0).alias("text_score"),
        one(0, 1).alias("meta_score"),
        one(0, 2).alias("quality_score"),
        one(1, 2).alias("toxic_score"),
        ((one(0, 2) >= good.threshold) & (one(1, 2) <= 0.5)).alias("keep"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # The operator writes these narrow rows once; the texts are only read here.
    dealt = sharding.shuffle(rows, 8, key=["doc_id", "size", "text_crc32"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def queries() -> dict[str, Query]:
    found = [op1_byte_level_bpe, op2_warc, op3_document_fingerprints, op4_html_extraction, op5_benchmark_decontamination, op6_line_dedup, op7_language_id, op8_quality_classifier, op9_ngram_jaccard_join, op10_sharding]
    return {f.__name__: f for f in found}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_SQL = {
    "op2_warc": """
        WITH a AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS first FROM a WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, a.d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM a LEFT JOIN m ON a.d = m.d AND n >= 1000""",
    "op5_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
               FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
