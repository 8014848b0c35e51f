"""Writing files out: the restore of contents to a file system that all executors reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files`` (path, data) under ``folder``, a URI; (path, bytes) of what was written.

    A file is written beside its place and then moved there, so a task that runs twice leaves one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), []
            for path, data in zip(paths, batch.column(1).to_pylist()):
                if any(p == ".." for p in path.split("/")):
                    raise ValueError(f"{path} leads out of the folder")
                place = posixpath.join(base, path.lstrip("/"))
                store.create_dir(posixpath.dirname(place), recursive=True)
                draft = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(data)
                store.move(draft, place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "data").mapInArrow(run, "path string, bytes long")


def write_files(pieces: DataFrame, folder: str) -> DataFrame:
    """Write files given in pieces (path, pos, bytes) under ``folder``, a URI; (path, bytes) of what was written.  The pieces of a
    file are sorted and written as they stream by, so no file is ever whole in memory.  A piece may have no bytes."""
    ordered = pieces.select("path", "pos", "bytes").repartition("path").sortWithinPartitions("path", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        current, out, draft, size = None, None, None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            store.move(draft, posixpath.join(base, current.lstrip("/")))
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([size], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            for path, pos, data in zip(*(c.to_pylist() for c in batch.columns)):
                if path != current:
                    if out is not None:
                        yield closed()
                    if any(p == ".." for p in path.split("/")):
                        raise ValueError(f"{path} leads out of the folder")
                    place = posixpath.join(base, path.lstrip("/"))
                    store.create_dir(posixpath.dirname(place), recursive=True)
                    current, draft, size = path, f"{place}.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(draft)
                if data and pos != size:
                    raise ValueError(f"{path} has no bytes at {size}")
                out.write(data or b"")
                size += len(data or b"")
        if out is not None:
            yield closed()

    return ordered.mapInArrow(run, "path string, bytes long")
