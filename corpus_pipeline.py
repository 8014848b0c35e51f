"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back by the next.

1. Language identification drops documents without a language and those it cannot tell apart.
2. Line dedup removes repeated and nearly repeated lines, and documents of which nothing else remains.
3. The n-gram Jaccard join keeps one row of each group of near copies, the one with the smallest key; rows without a key
   come last. Of rows without words that repeat key and text, one is kept.
4. Decontamination drops documents in which a benchmark passage occurs.
5. Byte-level BPE encodes the texts that remain.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extentlake.llm import bpe, decontam, langid, line_dedup, ngram_join
from extentlake.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  The classifiers learn from the labels of a bounded sample."""
    model = langid.fit(docs)
    # The names that the operator adds may be taken by the documents' own columns.
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    kept = langid.predict(renamed, model, text=text).where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; n_chars follows the text."""
    found = line_dedup.without_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids (little-endian unsigned 32-bit integers) and their number."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(docs.select("doc_id", "text"), ranks, pattern, keep_text=False)
    return found.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: SQL can express neither the classifiers nor the token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
