"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker at a time.  Texts can be long, so batches are small.
ARROW_ROWS = 256


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or a temporary one if a
    local test session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="extentlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files at its end if this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors.
    What was written needs its shuffles no more, so Spark deletes their files as the write ends."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of an operator, deleted as soon as they are dropped or the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        found = written(df, name, path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            _delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(t for t, _ in list(self.paths.values())))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Collects the driver's garbage between two steps.  Spark frees broadcasts and shuffles only as their references are collected, and
    the collector lets the heap grow by each plan's tables of megabytes before it does so; afterwards the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch in this session, since a row holds a whole text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def map_rows(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(column), F.lit(0))


#: Long words of a bit map of hashes: 1 MB, whatever is entered.
MAP_WORDS = 1 << 17


def bit_map(hashes: DataFrame, column: str) -> DataFrame:
    """One row ``bits``: a map of the 64-bit hashes in ``column``, one bit each.  A full map lets more through."""
    place = F.pmod(F.shiftrightunsigned(column, 6), F.lit(MAP_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    every = hashes.sparkSession.range(MAP_WORDS).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("long").alias("bits"))
    return (
        hashes.select(place.alias("place"), bit.alias("bits"))
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
        .unionByName(every)
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "bits")))["bits"].alias("bits"))
    )


def on_map(bits: Column, value: Column) -> Column:
    """Whether a hash may be on the map."""
    word = F.get(bits, F.pmod(F.shiftrightunsigned(value, 6), F.lit(MAP_WORDS)).cast("int"))
    return F.call_function("shiftrightunsigned", word, value.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
