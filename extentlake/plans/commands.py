"""The commands of a repository: ingest, restore, check, list, find, stats, delete, reclaim, blacklist.

Reading commands return DataFrames; changing ones publish a new snapshot.  Every path is absolute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..model import CHUNK_BYTES, FILE_BYTES, is_dir, is_live, millis_of
from ..operators import content, edits, extents, ingest, maintenance, tree
from ..sources.export import write_files
from ..sources.repository import Repository, rewrite_store, store_folder, write_store
from ..sources.storage import written


@dataclass
class Commands:
    repository: Repository
    #: Bytes of a store file; also the bin width of joins over store positions.
    file_bytes: int = FILE_BYTES

    @property
    def _store(self) -> str:
        return store_folder(self.repository)

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.repository.opened()

    def _publish(self, entries: DataFrame | None = None, contents: DataFrame | None = None) -> int:
        return self.repository.publish({n: t for n, t in (("tree_entries", entries), ("data_entries", contents)) if t is not None})

    def _walk(self, entries: DataFrame, parts: list[str]) -> int | None:
        """The id of the live entry that a path's elements lead to from the root, one lookup each."""
        at: int | None = tree.ROOT
        for name in parts:
            row = entries.where(is_live() & (F.col("parentId") == at) & (F.col("name") == name)).select("id").first()
            if row is None:
                return None
            at = row["id"]
        return at

    def _id(self, entries: DataFrame, path: str) -> int:
        found = self._walk(entries, [p for p in path.split("/") if p])
        if found is None:
            raise FileNotFoundError(path)
        return found

    # --- reading --------------------------------------------------------------------------------

    def list(self, path: str) -> DataFrame:
        entries, contents = self._tables()
        at = entries.where(F.col("id") == self._id(entries, path)).select("id")
        return tree.listing(entries, contents, at).select("place", "name", "is_dir", "size", "time")

    def find(self, glob: str, compat: bool = False) -> DataFrame:
        """Entries by a path fragment with ``*`` and ``?``; the last element must match the name."""
        entries, _ = self._tables()
        last = glob.rstrip("/").rsplit("/", 1)[-1]
        return tree.find(entries, patterns.name_like(F.col("name"), last, compat), patterns.path_like(F.col("path"), glob, compat))

    def stats(self, path: str | None = None) -> DataFrame:
        entries, contents = self._tables()
        if path is None:
            return maintenance.report(entries, contents)
        return tree.subtree_stats(entries, contents).where(F.col("id") == self._id(entries, path))

    def stat(self, path: str) -> DataFrame:
        entries, contents = self._tables()
        return tree.with_sizes(entries, contents).where(F.col("id") == self._id(entries, path))

    def _files(self, entries: DataFrame, path: str) -> DataFrame:
        """(path, dataId, time) of the files at and below a path."""
        below = tree.subtree(entries, entries.where(F.col("id") == self._id(entries, path))).select(F.col("id").alias("_i"))
        return tree.paths(entries).where(~is_dir()).join(below, F.col("id") == F.col("_i"), "left_semi").select("path", "dataId", "time")

    def _pieces(self, contents: DataFrame, wanted: DataFrame) -> DataFrame:
        """(id, pos, bytes): what the store holds of the contents in ``wanted`` (id)."""
        parts = contents.join(wanted.select("id").distinct(), "id", "left_semi")
        return content.read_contents(parts, self._stored())

    def _stored(self) -> DataFrame:
        """(id, start, bytes): the pieces of the byte store."""
        reader = self.repository.spark.read.schema("id long, start long, bytes binary, file string")
        found = reader.parquet(self._store) if self._has_store() else self.repository.spark.createDataFrame([], "id long, start long, bytes binary")
        return found.select("id", "start", "bytes")

    def _has_store(self) -> bool:
        return self.repository._fs().exists(self.repository._path(self._store.rsplit("/", 1)[1]))

    def restore_pieces(self, path: str) -> DataFrame:
        """(path, pos, bytes) of all files at and below a path, in pieces, so that contents may have any size.  Blacklisted contents
        are zeros; an empty file is one piece without bytes."""
        entries, contents = self._tables()
        files = self._files(entries, path)
        ids = files.select(F.col("dataId").alias("id")).distinct()
        lengths = tree.logical_sizes(contents).select(F.col("dataId").alias("id"), F.col("size").alias("length")).join(ids, "id", "left_semi")
        held = written(content.filled(self._pieces(contents, ids), lengths), "pieces")
        rows = files.join(held, F.col("dataId") == F.col("id"), "left")
        return rows.select("path", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "bytes")

    def export(self, path: str, folder: str) -> DataFrame:
        """Write all files at and below a path under ``folder``, a URI; (path, bytes)."""
        return write_files(self.restore_pieces(path), folder)

    def restore(self, path: str) -> DataFrame:
        """(path, time, data) of all files at and below a path, each in one cell: for files of less than 2 GiB; ``export`` is for all."""
        entries, contents = self._tables()
        files = self._files(entries, path)
        ids = files.select(F.col("dataId").alias("id"))
        lengths = tree.logical_sizes(contents).select(F.col("dataId").alias("id"), F.col("size").alias("length")).join(ids.distinct(), "id", "left_semi")
        data = content.assemble(self._pieces(contents, ids), lengths)
        joined = files.join(data, F.col("dataId") == F.col("id"), "left")
        return joined.select("path", "time", F.coalesce("data", F.lit(b"")).alias("data"))

    def read(self, path: str, offset: int, size: int) -> bytes:
        """At most ``size`` bytes of a file from ``offset``; none beyond its end."""
        entries, contents = self._tables()
        at = entries.where((F.col("id") == self._id(entries, path)) & ~is_dir()).first()
        if at is None:
            raise IsADirectoryError(path)
        parts = contents.where(F.col("id") == at["dataId"])
        length = parts.agg(F.coalesce(F.max("length"), F.lit(0)).alias("n")).first()["n"]
        n = max(0, min(size, length - offset))
        held = content.read_contents(parts, self._stored()).where((F.col("pos") < offset + n) & (F.col("pos") + F.octet_length("bytes") > offset))
        # Asked for by the caller, so it fits into the caller's memory.
        out = bytearray(n)
        for r in held.select("pos", "bytes").collect():
            lo, hi = max(r["pos"], offset), min(r["pos"] + len(r["bytes"]), offset + n)
            out[lo - offset : hi - offset] = r["bytes"][lo - r["pos"] : hi - r["pos"]]
        return bytes(out)

    def check(self, path: str) -> DataFrame:
        """(path, verdict) of all files at and below a path.  Contents are hashed as a stream of chunks; one of whose bytes the
        store lacks any is unreadable."""
        entries, contents = self._tables()
        files = self._files(entries, path)
        wanted = files.select(F.col("dataId").alias("id")).where("id >= 0").distinct()
        digests = content.large_digests(self._pieces(contents, wanted)).select(F.col("id").alias("_d"), F.col("hash").alias("actual_hash"), F.col("length").alias("_n"))
        asked = contents.join(wanted, "id", "left_semi")
        stored = maintenance.storage_sizes(asked).select("id", "stored")
        actual = stored.join(digests, (F.col("id") == F.col("_d")) & (F.col("stored") == F.col("_n"))).select("id", "actual_hash")
        verdicts = maintenance.check(asked, actual)
        return files.join(verdicts, F.col("dataId") == F.col("id"), "left").select("path", F.coalesce("verdict", F.lit("OK")).alias("verdict"))

    # --- changing -------------------------------------------------------------------------------

    def delete(self, path: str, now_ms: int) -> int:
        """Mark everything at and below a path deleted; how many entries that were."""
        entries, _ = self._tables()
        top = entries.where(F.col("id") == self._id(entries, path))
        after = written(maintenance.delete_recursively(entries, top, now_ms), "deleted")
        marked = after.where(~is_live()).count() - entries.where(~is_live()).count()
        self._publish(after)
        return marked

    def reclaim(self, keep_days: int, now_ms: int) -> dict[str, int]:
        """Remove what was deleted long ago and give its storage back; how many entries and contents went.  The pieces of contents that
        are gone or have no storage leave the byte store as well."""
        entries, contents = self._tables()
        kept, held = maintenance.reclaim(entries, contents, keep_days, now_ms)
        held = written(held, "contents")
        counts = {
            "entries": entries.count() - kept.count(),
            "contents": contents.select("id").distinct().count() - held.select("id").distinct().count(),
            "orphan_references": maintenance.orphan_references(kept, held).count(),
        }
        self._publish(kept, held)
        if self._has_store():
            live = held.where("stop > start").select(F.col("id").alias("_l")).distinct()
            rewrite_store(self._stored().join(live, F.col("id") == F.col("_l"), "left_semi"), self.repository, self.file_bytes)
        return counts

    def blacklist(self, path: str, delete_copies: bool, now_ms: int) -> int:
        entries, contents = self._tables()
        return self._publish(*maintenance.blacklist(entries, contents, self._id(entries, path), delete_copies, now_ms))

    def blacklist_files(self, files: DataFrame) -> int:
        """Make the contents of external files (path, hash, length) known without storage, so that they are never stored; how many were new."""
        entries, contents = self._tables()
        known = contents.where("seq = 1").select("id", "hash", "length")
        new = written(maintenance.add_to_blacklist(files.select(F.col("path").alias("file"), "hash", "length").withColumn("file", F.xxhash64("file")), known, self._next_id(entries, contents)), "listed")
        self._publish(contents=contents.unionByName(new))
        return new.count()

    def _asked(self, path: str) -> tuple[DataFrame, DataFrame, dict[str, int | None], str, str]:
        """Entries and contents, the ids at a path and at its parent, and the path's last element with its parent."""
        entries, contents = self._tables()
        parts = [p for p in path.split("/") if p]
        up, name = "/" + "/".join(parts[:-1]), parts[-1] if parts else ""
        above = self._walk(entries, parts[:-1])
        own = above if not parts else None if above is None else self._walk(entries, parts)
        return entries, contents, {"own": own, "up": above}, up, name

    def make_dir(self, path: str, now_ms: int) -> str:
        return self._make(path, now_ms, None)

    def make_file(self, path: str, now_ms: int) -> str:
        """Make an empty file."""
        return self._make(path, now_ms, -1)

    def _make(self, path: str, now_ms: int, data: int | None) -> str:
        if self.repository.read_only:
            return "EROFS"
        entries, contents, ids, _, name = self._asked(path)
        if not name or ids["up"] is None:
            return "ENOENT"
        row = [(0, ids["up"], name, now_ms, data)]
        asked = self.repository.spark.createDataFrame(row, "request long, parentId long, name string, time long, dataId long")
        after, answers = edits.make(entries, asked, self._next_id(entries, contents))
        return self._answered(after, answers)

    def _answered(self, after: DataFrame, answers: DataFrame) -> str:
        outcome = answers.first()["outcome"]
        if outcome == "OK":
            self._publish(after)
        return outcome

    def remove(self, path: str, now_ms: int, directory: bool) -> str:
        """Remove one directory without children, or one file."""
        if self.repository.read_only:
            return "EROFS"
        entries, _, ids, _, _ = self._asked(path)
        if ids["own"] is None:
            return "ENOENT"
        own = entries.where(F.col("id") == ids["own"])
        if own.where(is_dir()).isEmpty() == directory:
            return "ENOTDIR" if directory else "EISDIR"
        free = maintenance.deletable(entries).where(F.col("id") == ids["own"])
        if free.isEmpty():
            return "ENOTEMPTY"
        self._publish(maintenance.mark_deleted(entries, free, now_ms))
        return "OK"

    def set_time(self, path: str, seconds: int, nanos: int) -> str:
        if self.repository.read_only:
            return "EROFS"
        entries, _, ids, _, _ = self._asked(path)
        time = self.repository.spark.range(1).select(millis_of(F.lit(seconds), F.lit(nanos)).alias("t")).first()["t"]
        if time is None:
            return "EINVAL"
        if ids["own"] is None:
            return "ENOENT"
        self._publish(edits.update(entries, self.repository.spark.createDataFrame([(ids["own"], time)], "id long, time long"), "time"))
        return "OK"

    def rename(self, path: str, to: str, now_ms: int = 1, copy: bool = False) -> str:
        """Move an entry to another path, or copy it if that is in another directory and copies are asked for."""
        if self.repository.read_only:
            return "EROFS"
        entries, contents, old, _, old_name = self._asked(path)
        _, _, new, _, name = self._asked(to)
        if not old_name or not name or old["own"] is None or new["up"] is None:
            return "ENOENT"
        asked = self.repository.spark.createDataFrame([(0, old["own"], new["up"], name)], "request long, id long, parentId long, name string")
        return self._answered(*edits.rename(entries, asked, now_ms, copy, self._next_id(entries, contents)))

    def target(self, path: str, now_ms: int) -> str:
        """The directory that a target path with ``?`` and ``!`` leads to, with what may be created made; an error if it is not there."""
        wanted = patterns.parse_target(path)
        at, may = "", False
        for name, create in zip(wanted.elements, wanted.may_create):
            at, may = f"{at}/{name}", may or create
            entries, _, ids, _, _ = self._asked(at)
            last = at.count("/") == len(wanted.elements)
            if ids["own"] is None:
                if not may:
                    raise FileNotFoundError(at)
                if (outcome := self.make_dir(at, now_ms)) != "OK":
                    raise OSError(f"{outcome}: {at}")
            elif entries.where(F.col("id") == ids["own"]).where(is_dir()).isEmpty():
                raise NotADirectoryError(at)
            elif last and wanted.must_be_new:
                raise FileExistsError(at)
        return at or "/"

    def reference(self, pattern: str, source: DataFrame | None = None) -> str:
        """The path of the last directory by name that a reference pattern leads to.  If the source's listing (name) is given, both must have enough names in common."""
        entries, _ = self._tables()
        found = ingest.latest_reference(entries, [p for p in pattern.split("/") if p])
        row = tree.paths(entries).join(found.select(F.col("id").alias("_f")), F.col("id") == F.col("_f")).select("id", "path").first()
        if row is None:
            raise FileNotFoundError(pattern)
        inside = tree.children(entries, found).select("name")
        if inside.isEmpty():
            raise ValueError(f"the reference {row['path']} is empty")
        if source is not None and not ingest.similarity(source, inside).first()["accepted"]:
            raise ValueError(f"the source and the reference {row['path']} have too few names in common")
        return row["path"]

    def plan(self, source: DataFrame, target: str, reference: str) -> DataFrame:
        """The action for each source file (path relative to the target, time, size) against a reference directory."""
        entries, contents = self._tables()
        base, old = (p.rstrip("/") for p in (target, reference))
        known = tree.with_sizes(tree.paths(entries), contents)
        strip = lambda prefix: F.regexp_replace(F.expr(f"substring(path, {len(prefix) + 2})"), "/$", "")
        there = known.where(F.col("path").startswith(base + "/")).select(strip(base).alias("path"), "id", is_dir().alias("is_dir"))
        ref = known.where(F.col("path").startswith(old + "/") & ~is_dir()).select(strip(old).alias("path"), "id", "time", "size", "dataId")
        return ingest.ingest_plan(source, there, ref)

    def _next_id(self, entries: DataFrame, contents: DataFrame) -> int:
        """Ids are never given out again, not even those of contents that were reclaimed."""
        used = entries.select("id").unionByName(contents.select("id")).unionByName(self._stored().select("id"))
        return used.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"] + 1

    def sync(self, source: DataFrame, target: str, reference: str, now_ms: int) -> dict[str, int]:
        """Bring ``source`` (path relative to the target, time, size, data) into the target directory by the plan against a reference
        directory: files that are as there keep or get its contents, and only the bytes of the others are read.  How many files had
        each action, and how many bytes were read."""
        base = target.rstrip("/")
        plan = written(self.plan(source.select("path", "time", "size"), target, reference), "plan")
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        full = F.concat(F.lit(base + "/"), F.col("path"))
        entries, contents = self._tables()
        replaced = plan.where(F.col("action").startswith("REPLACE DIRECTORY")).select(full.alias("path"))
        tops = tree.resolve(entries, replaced).select("id")
        entries = written(maintenance.delete_recursively(entries, entries.join(tops, "id", "left_semi"), now_ms), "entries")
        needed = ingest.unread(plan).select(F.col("path").alias("_path"))
        files = source.join(needed, F.col("path") == F.col("_path"), "left_semi").select(full.alias("path"), "time", "data")
        linked = plan.where("dataId IS NOT NULL AND action <> 'KEEP'").select(full.alias("path"), "time", "dataId")
        counts["bytes"] = self._ingest(entries, contents, files, linked, now_ms)
        return counts

    def ingest(self, files: DataFrame, now_ms: int) -> int:
        """Store ``files`` (path, time, data): missing directories are made, equal contents are stored once, files that exist are
        pointed to the new content.  A path is unique in ``files`` and no directory's, else nothing is done.  How many bytes were read."""
        entries, contents = self._tables()
        none = self.repository.spark.createDataFrame([], "path string, time long, dataId long")
        return self._ingest(entries, contents, files.select("path", "time", "data"), none, now_ms)

    def _ingest(self, entries: DataFrame, contents: DataFrame, files: DataFrame, links: DataFrame, now_ms: int) -> int:
        """``links`` (path, time, dataId) are files whose content is stored already."""
        known = tree.paths(entries).select(F.regexp_replace("path", "/$", "").alias("_path"), "id", is_dir().alias("_dir"))
        parts = F.filter(F.split("path", "/"), lambda x: x != "")
        plain = F.concat(F.lit("/"), F.array_join(parts, "/"))
        names = written(files.select(plain.alias("path")).unionByName(links.select(plain.alias("path"))), "names")
        twice = names.groupBy("path").count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"{twice[0]['path']} is there more than once")
        folders = names.join(known.where("_dir"), F.col("path") == F.col("_path"), "left_semi").head(1)
        if folders:
            raise IsADirectoryError(folders[0]["path"])
        next_id = self._next_id(entries, contents)

        # Directories: every proper prefix of a path.
        level = names.select(parts.alias("p")).where(F.size("p") > 1).select(
            F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), k), "/")))).alias("dir")
        )
        missing = level.distinct().join(known, F.col("dir") == F.col("_path"), "left_anti").withColumn("one", F.lit(1).cast("long"))
        numbered = extents.prefix_axis(missing.withColumn("order", F.shiftright(F.xxhash64("dir"), 2)), "order", "one", "_n", "_to")
        made = written(numbered.select("dir", (F.col("_n") + next_id).alias("id")), "dirs")
        dirs = known.where("_dir").select(F.col("_path").alias("dir"), "id").unionByName(made)
        parent = F.regexp_replace("dir", "/[^/]*$", "")
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        up = dirs.select(F.col("dir").alias("_up"), F.col("id").alias("parentId"))
        new_dirs = made.join(up, parent == F.col("_up")).select(
            "id", "parentId", F.regexp_extract("dir", "[^/]*$", 0).alias("name"), F.lit(now_ms).cast("long").alias("time"), zero.alias("deleted"), none.alias("dataId")
        )
        next_id += made.count()

        # Files: number those that are new, digest all, link or store.
        hashed = files.select(plain.alias("path"), "time", F.md5("data").alias("hash"), F.octet_length("data").cast("long").alias("length"), F.lit(None).cast("long").alias("link"))
        none = F.lit(None)
        hashed = hashed.unionByName(links.select(plain.alias("path"), "time", none.cast("string").alias("hash"), none.cast("long").alias("length"), F.col("dataId").alias("link")))
        there = hashed.join(known, F.col("path") == F.col("_path"), "left").withColumn("one", F.lit(1).cast("long"))
        ordered = extents.prefix_axis(there.withColumn("order", F.shiftright(F.xxhash64("path"), 2)), "order", "one", "_n", "_to")
        placed = written(ordered.select("path", "time", "hash", "length", "link", F.col("id").alias("old"), (F.col("_n") + next_id).alias("file")), "files")
        next_id += placed.count()
        held = contents.where("seq = 1").select("id", "hash", "length")
        read = placed.where("link IS NULL").drop("link")
        linked = written(content.deduplicated(read, held, next_id), "linked")
        linked = linked.withColumn("dataId", F.when(F.col("action") == "empty", F.lit(-1)).otherwise(F.col("dataId")).cast("long"))

        shared = placed.where("link IS NOT NULL").select(*linked.drop("dataId", "action").columns, F.col("link").alias("dataId"), F.lit("link").alias("action"))
        linked = linked.unionByName(shared)

        # Storage of what is new.
        stored = linked.where("action = 'store'").select(F.col("dataId").alias("id"), "length", "hash", F.col("path").alias("_path"))
        areas = written(extents.allocate(stored.select("id", F.col("length").alias("size")), extents.free_areas(contents)), "areas")
        rows = areas.join(stored, "id").select("id", "seq", "length", "start", "stop", "hash")
        data = files.select(plain.alias("path"), "data").join(stored.select("id", "_path"), F.col("path") == F.col("_path")).select("id", "data")
        pieces = content.to_areas(content.chunked(data, size=CHUNK_BYTES), extents.split_at(areas, self.file_bytes).drop("seq").withColumn("seq", F.col("start")))
        write_store(pieces, self._store, self.file_bytes)

        name = F.regexp_extract("path", "[^/]*$", 0)
        base = F.regexp_replace("path", "/[^/]*$", "")
        new_files = linked.where("old IS NULL").join(up, base == F.col("_up")).select(
            F.col("file").alias("id"), "parentId", name.alias("name"), "time", zero.alias("deleted"), "dataId"
        )
        changes = linked.where("old IS NOT NULL").select(F.col("old").alias("id"), "time", "dataId")
        after = edits.update(edits.update(entries, changes, "time"), changes, "dataId")
        self._publish(after.unionByName(new_dirs).unionByName(new_files), edits.insert_parts(contents, rows))
        return linked.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n")).first()["n"]

    def live_bytes(self) -> DataFrame:
        """One row: bytes of all live files, each counted, and the bytes in use."""
        entries, contents = self._tables()
        sized = tree.with_sizes(entries.where(is_live()), contents).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical"))
        return sized.withColumn("stored", contents.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).scalar())
