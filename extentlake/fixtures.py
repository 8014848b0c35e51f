"""Logical views of a repository over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.content import layout

FIRST_FILE = 1_000_000
NOW = 1_800_000_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: doc_id, lang, source, hash (md5 of the text) and length in bytes.

    The text itself never leaves the scan."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, folder, "documents").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.md5(text.cast("binary")).alias("hash"),
        F.octet_length(text).cast("long").alias("length"),
    )


def content_ids(files: DataFrame) -> DataFrame:
    """(hash, length, id): the least file of each content gives its id."""
    return files.groupBy("hash", "length").agg((F.min("doc_id") + 1).alias("id"))


def data_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Contents back to back in the order of their ids, one part each."""
    placed = layout(content_ids(files(spark, folder)), 0)
    return placed.select("id", F.lit(1).alias("seq"), "length", "start", "stop", "hash")


def tree_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of languages, sources and documents; every tenth document is deleted."""
    own = files(spark, folder)
    # Languages and sources are few: ranking them takes one small task.
    pairs = own.select("lang", "source").distinct()
    langs = pairs.select("lang").distinct().withColumn("lang_id", F.row_number().over(Window.orderBy("lang")) + 1)
    sources = pairs.withColumn("source_id", F.row_number().over(Window.orderBy("lang", "source")) + 100)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def rows(df: DataFrame, i: F.Column, parent: F.Column, name: F.Column, time: F.Column = zero, deleted: F.Column = zero, data: F.Column = none) -> DataFrame:
        kinds = (("id", i), ("parentId", parent), ("time", time), ("deleted", deleted), ("dataId", data))
        cast = {n: c.cast("long").alias(n) for n, c in kinds}
        return df.select(cast["id"], cast["parentId"], name.alias("name"), cast["time"], cast["deleted"], cast["dataId"])

    root = rows(spark.range(1), zero, zero, F.lit(""))
    lang_dirs = rows(langs, F.col("lang_id"), zero, F.col("lang"))
    source_dirs = rows(sources.join(langs, "lang"), F.col("source_id"), F.col("lang_id"), F.col("source"))
    ids = content_ids(own).withColumnRenamed("id", "data_id")
    gone = F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1_700_000_000_000).otherwise(0)
    documents = rows(
        own.join(sources, ["lang", "source"]).join(ids, ["hash", "length"]),
        F.col("doc_id") + FIRST_FILE,
        F.col("source_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")),
        F.col("doc_id") * 1000,
        gone,
        F.col("data_id"),
    )
    return root.unionByName(lang_dirs).unionByName(source_dirs).unionByName(documents)


def operations(events: DataFrame) -> DataFrame:
    """Events as operations on files, one file per user, numbered by time and event id."""
    k = F.regexp_extract("props", r"(-?\d+)", 1).cast("long")
    op = (
        F.when(F.col("event_type") == "signup", "OPEN")
        .when(F.col("event_type") == "click", "WRITE")
        .when(F.col("event_type") == "purchase", "TRUNCATE")
        .when(F.col("event_type") == "error", "RELEASE")
        .otherwise("READ")
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("file_id"),
        F.row_number().over(order).cast("long").alias("op_seq"),
        op.alias("op"),
        F.when(op == "TRUNCATE", k * 3).otherwise(k).alias("pos"),
        (F.floor("value") + 1).cast("long").alias("size"),
    )


#: The same views in SQL: f (files), c (contents), te (tree entries), de (data entries).
FA_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS hash,
         CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length FROM documents),
c AS (SELECT hash, length, min(doc_id) + 1 AS id FROM f GROUP BY hash, length),
l AS (SELECT lang, 1 + row_number() OVER (ORDER BY lang) AS id FROM (SELECT DISTINCT lang FROM f)),
s AS (SELECT lang, source, 100 + row_number() OVER (ORDER BY lang, source) AS id FROM (SELECT DISTINCT lang, source FROM f)),
te AS (
  SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS "parentId", '' AS name, CAST(0 AS BIGINT) AS time, CAST(0 AS BIGINT) AS deleted, CAST(NULL AS BIGINT) AS "dataId"
  UNION ALL SELECT id, 0, lang, 0, 0, NULL FROM l
  UNION ALL SELECT s.id, l.id, s.source, 0, 0, NULL FROM s JOIN l ON s.lang = l.lang
  UNION ALL SELECT 1000000 + f.doc_id, s.id, 'doc_' || f.doc_id || '.txt', f.doc_id * 1000,
                   CASE WHEN f.doc_id % 10 = 3 THEN 1700000000000 + f.doc_id ELSE 0 END, c.id
            FROM f JOIN s ON f.lang = s.lang AND f.source = s.source JOIN c ON f.hash = c.hash AND f.length = c.length),
de AS (SELECT id, 1 AS seq, length, CAST(sum(length) OVER (ORDER BY id) AS BIGINT) - length AS start,
              CAST(sum(length) OVER (ORDER BY id) AS BIGINT) AS stop, hash FROM c),
p AS (SELECT id, '/' AS path FROM te WHERE id = 0
      UNION ALL SELECT te.id, p.path || te.name || '/' FROM te JOIN p ON te."parentId" = p.id WHERE te.id <> te."parentId" AND te.deleted = 0),
paths AS (SELECT te.*, CASE WHEN te."dataId" IS NULL THEN p.path ELSE rtrim(p.path, '/') END AS path FROM p JOIN te ON te.id = p.id)
"""

#: Operations in SQL: ops.
FD_SQL = """
WITH RECURSIVE ops AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS op_seq,
         CASE event_type WHEN 'signup' THEN 'OPEN' WHEN 'click' THEN 'WRITE' WHEN 'purchase' THEN 'TRUNCATE' WHEN 'error' THEN 'RELEASE' ELSE 'READ' END AS op,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) * CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END AS pos,
         CAST(floor(value) + 1 AS BIGINT) AS size FROM events)
"""
