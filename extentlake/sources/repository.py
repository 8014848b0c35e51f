"""A repository on disk: versioned snapshots of its tables and a pointer to the current one."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CONTEXT, DATA_ENTRIES, DB_VERSION, TREE_ENTRIES, address_file_column

SCHEMAS = {"tree_entries": TREE_ENTRIES, "data_entries": DATA_ENTRIES, "context": CONTEXT}
COPY_NAME = re.compile(r"snapshot_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}")


@dataclass
class Repository:
    """Snapshots in folders under ``base``.  Each publication moves one more pointer file ``CURRENT-<k>``, with the snapshot's number and
    folder, into place as its last step; the pointer with the highest k counts, so that there is one at any time."""

    spark: SparkSession
    base: str
    read_only: bool = False

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _pointers(self) -> dict[int, tuple[int, str]]:
        """By number of publication the number and folder of the snapshot it made the current one."""
        fs, found = self._fs(), {}
        for status in fs.globStatus(self._path("CURRENT-*")) or []:
            stream = fs.open(status.getPath())
            try:
                number, folder = bytes(stream.readAllBytes()).decode().split()
            finally:
                stream.close()
            found[int(status.getPath().getName().rsplit("-", 1)[1])] = int(number), folder
        return found

    def exists(self) -> bool:
        return bool(self._fs().globStatus(self._path("CURRENT-*")))

    def _current(self) -> tuple[int, int, str]:
        """The number of the last publication, its snapshot's number and folder."""
        found = self._pointers()
        if not found:
            raise FileNotFoundError(f"there is no repository at {self.base}")
        return max(found), *found[max(found)]

    def version(self) -> int:
        return self._current()[1]

    def _folder(self, version: int) -> str:
        for number, folder in self._pointers().values():
            if number == version:
                return folder
        raise FileNotFoundError(f"there is no snapshot {version}")

    def init(self, now_ms: int) -> None:
        """An empty repository: the root directory only.  Fails if there is one."""
        if self.exists():
            raise FileExistsError(f"there is a repository at {self.base}")
        rows = {"tree_entries": [(0, 0, "", now_ms, 0, None)], "data_entries": [], "context": [("db version", DB_VERSION)]}
        self.publish({n: self.spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})

    def table(self, name: str, version: int | None = None) -> DataFrame:
        folder = self._current()[2] if version is None else self._folder(version)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{folder}/{name}")

    def opened(self) -> tuple[DataFrame, DataFrame]:
        """(tree_entries, data_entries) after the version check."""
        found = [r["value"] for r in self.table("context").where("key = 'db version'").head(2)]
        if found != [DB_VERSION]:
            raise ValueError(f"the repository has version {found}, not {DB_VERSION}")
        return self.table("tree_entries"), self.table("data_entries")

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write a new snapshot; tables that are not given are taken over.  Readers see all of it or nothing."""
        if self.read_only:
            raise PermissionError("the repository is open for reading only")
        last, old, _ = self._current() if self.exists() else (0, 0, "")
        new = max([n for n, _ in self._pointers().values()], default=0) + 1
        # Publishers at the same time write to folders of their own; the first to point wins.
        folder = f"v={new}-{uuid.uuid4().hex[:8]}"
        for name in SCHEMAS:
            df = tables[name] if name in tables else self.table(name, old)
            df.select(*SCHEMAS[name].names).write.parquet(f"{self.base}/{folder}/{name}")
        self._point(last + 1, new, folder)
        return new

    def _point(self, at: int, version: int, folder: str) -> None:
        fs, draft, place = self._fs(), self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"CURRENT-{at}")
        stream = fs.create(draft, False)
        stream.write(f"{version} {folder}".encode())
        stream.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise OSError("another snapshot was published meanwhile")

    def restore_snapshot(self, version: int) -> None:
        """Make an earlier snapshot the current one."""
        if self.read_only:
            raise PermissionError("the repository is open for reading only")
        self._point(self._current()[0] + 1, version, self._folder(version))

    def compact(self, files: int | None = None) -> int:
        """Rewrite the current snapshot into ``files`` files a table, as many as there are shuffle partitions by default, sorted for pruning."""
        files = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries, contents = self.opened()
        by = {"tree_entries": entries.repartitionByRange(files, "parentId").sortWithinPartitions("parentId", "name")}
        by["data_entries"] = contents.repartitionByRange(files, "start").sortWithinPartitions("start")
        return self.publish(by)

    def portable_copy(self, now: datetime) -> str:
        """A portable copy as gzip'd JSON lines; returns its folder."""
        folder = f"{self.base}/archive/snapshot_{now:%Y-%m-%d_%H-%M}"
        for name in SCHEMAS:
            self.table(name).write.mode("errorifexists").option("compression", "gzip").json(f"{folder}/{name}")
        return folder

    def restore_copy(self, folder: str) -> int:
        if not COPY_NAME.fullmatch(folder.rstrip("/").rsplit("/", 1)[-1]):
            raise ValueError(f"{folder} is not named like a portable copy")
        return self.publish({n: self.spark.read.schema(s).json(f"{folder}/{n}") for n, s in SCHEMAS.items()})

    def migrate(self) -> int:
        """Take a snapshot without a version entry over to the current version."""
        context = self.table("context")
        if context.where("key = 'db version'").head(1):
            raise ValueError("the repository has a version already")
        stamp = self.spark.createDataFrame([("db version", DB_VERSION)], CONTEXT)
        return self.publish({"context": context.unionByName(stamp)})


def store_folder(repository: Repository) -> str:
    """Where the byte store is now: ``store-<k>`` with the highest k."""
    found = repository._fs().globStatus(repository._path("store-*")) or []
    last = max((int(f.getPath().getName().rsplit("-", 1)[1]) for f in found), default=0)
    return f"{repository.base}/store-{last}"


def rewrite_store(pieces: DataFrame, repository: Repository, width: int) -> None:
    """Replace the byte store by ``pieces`` (id, start, bytes) of it: they are written aside and renamed to the next store, then the old one goes."""
    old = store_folder(repository)
    last = int(old.rsplit("-", 1)[1])
    draft = f"{repository.base}/.store-{uuid.uuid4().hex}"
    write_store(pieces, draft, width)
    fs, path = repository._fs(), repository.spark._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(path(draft), path(f"{repository.base}/store-{last + 1}")):
        raise OSError("the byte store could not be replaced")
    fs.delete(path(old), True)


def write_store(pieces: DataFrame, folder: str, width: int) -> None:
    """Write (id, start, bytes) as a table partitioned by the store file each piece lies in; pieces do not cross files."""
    named = pieces.withColumn("file", F.replace(address_file_column(F.col("start"), width), F.lit("/"), F.lit("_")))
    named.repartition("file").sortWithinPartitions("file", "start").write.mode("append").partitionBy("file").parquet(folder)


def scan_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, time, size, hash) of local or remote files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    millis = F.unix_millis("modificationTime")
    return files.select("path", millis.alias("time"), F.col("length").alias("size"), F.md5("content").alias("hash"))
