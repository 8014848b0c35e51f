"""The logical model: schemas, constants and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

# Fixed values of the storage format.
CHUNK_BYTES = 32768
FILE_BYTES = 100_000_000
MAX_POSITION = (1 << 63) - 1
DB_VERSION = "3"
NO_CONTENT = -1
NAME_LIMIT = 255
FORBIDDEN_IN_NAMES = r'[\\/:*?"<>|]'

TREE_ENTRIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("parentId", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("time", T.LongType(), False),
        T.StructField("deleted", T.LongType(), False),
        T.StructField("dataId", T.LongType(), True),
    ]
)
DATA_ENTRIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("length", T.LongType(), True),
        T.StructField("start", T.LongType(), False),
        T.StructField("stop", T.LongType(), False),
        T.StructField("hash", T.StringType(), True),
    ]
)
CONTEXT = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])


def quotient(a: Column, b: int) -> Column:
    """Integer division."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def is_dir() -> Column:
    """Directories have no content id."""
    return F.col("dataId").isNull()


def is_live() -> Column:
    return F.col("deleted") == 0


def readable_bytes(size: Column) -> Column:
    """Bytes up to 9,999 as they are, then in kB, MB, GB or TB of 1000 with two decimals."""
    scaled = F.when(size < 10_000, F.format_string("%,d B", size))
    for unit, factor in (("kB", 10**3), ("MB", 10**6), ("GB", 10**9)):
        scaled = scaled.when(size < factor * 1000, F.format_string(f"%,.2f {unit}", size / F.lit(float(factor))))
    return scaled.otherwise(F.format_string("%,.2f TB", size / F.lit(1e12)))


def millis_of(seconds: Column, nanos: Column) -> Column:
    """Epoch milliseconds; null for negative seconds or nanoseconds outside [0, 1e9]."""
    valid = (seconds >= 0) & nanos.between(0, 1_000_000_000)
    return F.when(valid, (seconds * 1000 + quotient(nanos, 1_000_000)).cast("long"))


def seconds_nanos(millis: Column) -> Column:
    """(seconds, nanos) of epoch milliseconds."""
    ms = F.pmod(millis, F.lit(1000))
    return F.struct(quotient(millis - ms, 1000).alias("seconds"), (ms * 1_000_000).cast("long").alias("nanos"))


def non_zero(millis: Column) -> Column:
    """A deletion time is never 0, which means live."""
    return F.when(millis == 0, F.lit(1)).otherwise(millis).cast("long")


def valid_name(name: Column) -> Column:
    return (name != "") & ~name.rlike(FORBIDDEN_IN_NAMES) & (F.length(name) <= NAME_LIMIT)


def address_file_column(position: Column, size: int = FILE_BYTES) -> Column:
    """The file that holds a position of the byte store; null for negative positions."""
    file = quotient(position, size)
    hundreds = quotient(file, 100)
    name = F.format_string("%02d/%02d/%010d", quotient(hundreds, 100), hundreds % 100, file * size)
    return F.when(position >= 0, name)
