"""The registered queries over repository metadata, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..fixtures import FA_SQL, FD_SQL, NOW
from ..functions import patterns
from ..model import address_file_column, is_dir, is_live, millis_of, non_zero, readable_bytes, seconds_nanos
from ..operators import checks, content, edits, extents, ingest, maintenance, tree
from ..sources.storage import shared_root, written
from ..streaming import oplog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.tree_entries(spark, folder)


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.data_entries(spark, folder)


def _ops(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.operations(fixtures.read(spark, folder, "events"))


# --- content ------------------------------------------------------------------------------------


@query(
    """
    SELECT md5(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS length,
           min(doc_id) + 1 AS content_id, count(*) AS refs,
           CAST((count(*) - 1) * octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes_saved
    FROM documents GROUP BY 1, 2
    """
)
def dedup_report(spark: SparkSession, folder: str) -> DataFrame:
    files = fixtures.files(spark, folder)
    return files.groupBy("hash", "length").agg(
        (F.min("doc_id") + 1).alias("content_id"),
        F.count("*").alias("refs"),
        ((F.count("*") - 1) * F.col("length")).alias("bytes_saved"),
    )


@query(
    FA_SQL
    + """, k AS (SELECT hash, length, min(doc_id) + 1 AS id FROM f WHERE doc_id % 2 = 0 GROUP BY 1, 2),
    i AS (SELECT * FROM f WHERE doc_id % 2 = 1),
    w AS (SELECT i.hash, i.length, min(i.doc_id) AS first FROM i GROUP BY 1, 2),
    n AS (SELECT w.hash, w.length, 5000000 + row_number() OVER (ORDER BY first) - 1 AS id FROM w LEFT JOIN k ON w.hash = k.hash AND w.length = k.length WHERE k.id IS NULL)
    SELECT i.doc_id AS file, coalesce(k.id, n.id) AS "dataId",
           CASE WHEN i.length = 0 THEN 'empty' WHEN k.id IS NOT NULL THEN 'link' WHEN w.first = i.doc_id THEN 'store' ELSE 'link' END AS action
    FROM i JOIN w ON i.hash = w.hash AND i.length = w.length LEFT JOIN k ON i.hash = k.hash AND i.length = k.length
    LEFT JOIN n ON i.hash = n.hash AND i.length = n.length"""
)
def dedup_probe_hit_miss(spark: SparkSession, folder: str) -> DataFrame:
    files = fixtures.files(spark, folder)
    known = fixtures.content_ids(files.where("doc_id % 2 = 0"))
    incoming = files.where("doc_id % 2 = 1").select(F.col("doc_id").alias("file"), "hash", "length")
    return content.deduplicated(incoming, known, 5_000_000).select("file", "dataId", "action")


@query(FA_SQL + "SELECT hash, length, count(*) AS ids, min(id) AS first_id FROM (SELECT hash, length, doc_id + 1 AS id FROM f) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, folder: str) -> DataFrame:
    stored_twice = fixtures.files(spark, folder).select((F.col("doc_id") + 1).alias("id"), F.lit(1).alias("seq"), "hash", "length")
    return maintenance.duplicate_contents(stored_twice)


@query(FA_SQL + "SELECT id, length, start, stop, hash FROM de")
def content_layout(spark: SparkSession, folder: str) -> DataFrame:
    return _contents(spark, folder).select("id", "length", "start", "stop", "hash")


@query(
    FA_SQL
    + """SELECT id, CAST(k + 1 AS INTEGER) AS seq, CASE WHEN k = 0 THEN length END AS length, start + k * 4096 AS start, least(start + (k + 1) * 4096, stop) AS stop,
    CASE WHEN k = 0 THEN hash END AS hash FROM (SELECT *, unnest(range(0, greatest((length + 4095) // 4096, 1))) AS k FROM de)"""
)
def content_layout_multipart(spark: SparkSession, folder: str) -> DataFrame:
    return content.multipart(_contents(spark, folder), 4096)


@query(FA_SQL + "SELECT doc_id AS id, hash, length, true AS same FROM f WHERE length > 0")
def chunk_digest_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    docs = fixtures.read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    again = content.large_digests(content.chunked(docs, size=1024))
    files = fixtures.files(spark, folder).select(F.col("doc_id").alias("id"), F.col("hash").alias("_h"))
    return again.join(files, "id").select("id", "hash", "length", (F.col("hash") == F.col("_h")).alias("same"))


@query(
    FA_SQL
    + """SELECT id, pos, printf('%02d/%02d/%010d', pos // 100000000 // 100 // 100, pos // 100000000 // 100 % 100, pos - pos % 100000000) AS file, pos % 100000000 AS "offset"
    FROM (SELECT id, start * 1000003 AS pos FROM de)"""
)
def address_to_file(spark: SparkSession, folder: str) -> DataFrame:
    at = _contents(spark, folder).select("id", (F.col("start") * 1000003).alias("pos"))
    return at.select("id", "pos", address_file_column(F.col("pos")).alias("file"), (F.col("pos") % 100_000_000).alias("offset"))


@query(
    FA_SQL
    + """SELECT id, printf('%02d/%02d/%010d', k // 100 // 100, k // 100 % 100, k * 10000) AS file, greatest(start, k * 10000) % 10000 AS "offset",
    least(stop, (k + 1) * 10000) - greatest(start, k * 10000) AS bytes
    FROM (SELECT *, unnest(range(start // 10000, (stop - 1) // 10000 + 1)) AS k FROM de WHERE stop > start)"""
)
def split_at_file_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return content.file_pieces(_contents(spark, folder), 10_000)


# --- storage ------------------------------------------------------------------------------------

_USED = ", used AS (SELECT de.* FROM de WHERE stop > start AND id IN (SELECT \"dataId\" FROM te WHERE deleted = 0))"
_GAPS = (
    _USED
    + """, g AS (SELECT coalesce(lag(stop) OVER (ORDER BY start), 0) AS start, start AS stop FROM used), gaps AS (SELECT * FROM g WHERE stop > start),
    free AS (SELECT * FROM gaps UNION ALL SELECT coalesce(max(stop), 0), 9223372036854775807 FROM used)"""
)


def _used(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with a live reference: the others leave gaps."""
    live = _entries(spark, folder).where(is_live()).select(F.col("dataId").alias("_d")).distinct()
    return _contents(spark, folder).join(live, F.col("id") == F.col("_d"), "left_semi")


@query(FA_SQL + _GAPS + "SELECT start, stop FROM free")
def storage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return extents.free_areas(written(_used(spark, folder), "used"))


@query(FA_SQL + _GAPS + "SELECT count(*) AS gaps, CAST(coalesce(sum(stop - start), 0) AS BIGINT) AS free_bytes, (SELECT max(stop) FROM used) AS storage_end FROM gaps")
def gap_totals(spark: SparkSession, folder: str) -> DataFrame:
    used = written(_used(spark, folder), "used")
    found = extents.gaps(used).agg(F.count("*").alias("gaps"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).cast("long").alias("free_bytes"))
    return found.withColumn("storage_end", extents.end_of_storage(used).scalar())


@query(FA_SQL + _USED + "SELECT DISTINCT a.start FROM used a WHERE NOT EXISTS (SELECT 1 FROM used b WHERE b.stop = a.start)")
def area_starts_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return extents.area_starts(_used(spark, folder))


@query(
    FA_SQL
    + _GAPS
    + """, r AS (SELECT doc_id AS id, n_chars AS size FROM documents WHERE n_chars > 0),
    ra AS (SELECT id, CAST(sum(size) OVER (ORDER BY id) AS BIGINT) - size AS b, CAST(sum(size) OVER (ORDER BY id) AS BIGINT) AS e FROM r),
    total AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM r),
    fa AS (SELECT start, CAST(sum(size) OVER (ORDER BY start) AS BIGINT) - size AS b, CAST(sum(size) OVER (ORDER BY start) AS BIGINT) AS e
           FROM (SELECT start, least(stop - start, (SELECT n FROM total)) AS size FROM free))
    SELECT ra.id, CAST(row_number() OVER (PARTITION BY ra.id ORDER BY fa.start) AS INTEGER) AS seq, fa.start + greatest(ra.b, fa.b) - fa.b AS start, fa.start + least(ra.e, fa.e) - fa.b AS stop
    FROM ra JOIN fa ON ra.b < fa.e AND fa.b < ra.e"""
)
def allocate_into_gaps(spark: SparkSession, folder: str) -> DataFrame:
    requests = fixtures.read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return extents.allocate(requests, extents.free_areas(written(_used(spark, folder), "used")))


_FAULTS = """, x AS (SELECT id, seq, start, stop FROM de UNION ALL SELECT 9000000 + id, 1, start + length // 2, stop FROM de WHERE id % 50 = 1
    UNION ALL SELECT 9500000 + id, 1, start, start + length // 3 FROM de WHERE id % 70 = 1)"""


def _faulty(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with injected extents inside others and at the same starts."""
    de = _contents(spark, folder)
    rows = de.select("id", "seq", "start", "stop")
    half = de.where("id % 50 = 1").select((F.col("id") + 9_000_000).alias("id"), "seq", (F.col("start") + F.expr("length div 2")).alias("start"), "stop")
    third = de.where("id % 70 = 1").select((F.col("id") + 9_500_000).alias("id"), "seq", "start", (F.col("start") + F.expr("length div 3")).alias("stop"))
    return rows.unionByName(half).unionByName(third)


@query(FA_SQL + _FAULTS + "SELECT a.id AS a_id, b.id AS b_id FROM x a JOIN x b ON a.start < b.stop AND b.start < a.stop AND a.id < b.id WHERE a.stop > a.start AND b.stop > b.start")
def overlapping_extents(spark: SparkSession, folder: str) -> DataFrame:
    return extents.overlapping_pairs(_faulty(spark, folder)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(
    FA_SQL
    + _USED
    + """, x AS (SELECT id, start, stop FROM used UNION ALL SELECT 9000000 + id, start + length // 2, stop + length // 3 FROM used WHERE id % 50 = 1),
    r AS (SELECT start, coalesce(max(stop) OVER (ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM x WHERE stop > start)
    SELECT reach AS start, start AS stop FROM r WHERE start > reach UNION ALL SELECT coalesce(max(stop), 0), 9223372036854775807 FROM x"""
)
def faulty_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Free areas of the contents in use although injected extents overlap others: no used space is free."""
    used = _used(spark, folder)
    begin, end = F.col("start") + F.expr("length div 2"), F.col("stop") + F.expr("length div 3")
    longer = used.where("id % 50 = 1").select((F.col("id") + 9_000_000).alias("id"), "seq", begin.alias("start"), end.alias("stop"))
    return extents.free_areas(used.select("id", "seq", "start", "stop").unionByName(longer), checked=False)


@query(FA_SQL + _FAULTS + "SELECT start, count(*) AS extents FROM x WHERE stop > start GROUP BY start HAVING count(*) > 1")
def duplicate_starts(spark: SparkSession, folder: str) -> DataFrame:
    return extents.duplicate_starts(_faulty(spark, folder))


_PARTS = ", parts AS (SELECT id, k + 1 AS seq, start + k * 1000 AS start, least(start + (k + 1) * 1000, stop) AS stop FROM (SELECT *, unnest(range(0, (length + 999) // 1000)) AS k FROM de))"


@query(
    FA_SQL
    + _PARTS
    + """, o AS (SELECT id, start, CAST(sum(stop - start) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS upto, stop - start AS n FROM parts)
    SELECT id, greatest(upto - n, 500) - 500 AS at, start + greatest(upto - n, 500) - (upto - n) AS start, start + least(upto, 2800) - (upto - n) AS stop
    FROM o WHERE upto - n < 2800 AND upto > 500"""
)
def read_window(spark: SparkSession, folder: str) -> DataFrame:
    return extents.read_window(content.multipart(_contents(spark, folder), 1000), 500, 2300)


_WRITES = """, w AS (SELECT file_id, op_seq, pos AS start, pos + size AS stop FROM ops WHERE op = 'WRITE' AND size > 0),
    ww AS (SELECT *, max(stop) OVER (PARTITION BY file_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
    wi AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM ww),
    runs AS (SELECT file_id, min(start) AS start, max(stop) AS stop FROM wi GROUP BY file_id, island)"""


def _writes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ops(spark, folder).where("op = 'WRITE'")
    return rows.select("file_id", "op_seq", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop"))


@query(FD_SQL + _WRITES + "SELECT file_id, start, stop FROM runs")
def interval_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return extents.coalesce_adjacent(_writes(spark, folder), ["file_id"])


@query(
    FD_SQL
    + _WRITES
    + """, h AS (SELECT file_id, min(start) + 3 AS start, min(start) + 40 AS stop FROM w GROUP BY file_id)
    SELECT * FROM (SELECT r.file_id, r.start, least(r.stop, h.start) AS stop FROM runs r JOIN h ON r.file_id = h.file_id
    UNION ALL SELECT r.file_id, greatest(r.start, h.stop), r.stop FROM runs r JOIN h ON r.file_id = h.file_id) WHERE stop > start"""
)
def interval_subtract(spark: SparkSession, folder: str) -> DataFrame:
    writes = _writes(spark, folder)
    low = writes.where("stop > start").groupBy("file_id").agg(F.min("start").alias("_low"))
    holes = low.select("file_id", (F.col("_low") + 3).alias("start"), (F.col("_low") + 40).alias("stop"))
    return extents.subtract(extents.coalesce_adjacent(writes, ["file_id"]), holes, ["file_id"]).select("file_id", "start", "stop")


@query(FD_SQL + _WRITES + "SELECT file_id, start, least(stop, 50) AS stop FROM runs WHERE start < 50")
def interval_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return extents.truncate(extents.coalesce_adjacent(_writes(spark, folder), ["file_id"]), F.lit(50))


@query(
    FD_SQL
    + _WRITES
    + """, d AS (SELECT file_id, greatest(start, 10) AS start, least(stop, 60) AS stop FROM runs WHERE start < 60 AND stop > 10)
    SELECT file_id, start, stop, false AS is_hole FROM d
    UNION ALL SELECT * FROM (SELECT file_id, coalesce(lag(stop) OVER (PARTITION BY file_id ORDER BY start), 10) AS start, start AS stop, true FROM d) WHERE stop > start
    UNION ALL SELECT file_id, max(stop), 60, true FROM d GROUP BY file_id HAVING max(stop) < 60
    UNION ALL SELECT DISTINCT file_id, 10, 60, true FROM runs WHERE file_id NOT IN (SELECT file_id FROM d)"""
)
def interval_read(spark: SparkSession, folder: str) -> DataFrame:
    return extents.holes_in_window(extents.coalesce_adjacent(_writes(spark, folder), ["file_id"]), ["file_id"], 10, 60)


# --- operation log ------------------------------------------------------------------------------


@query(
    FD_SQL
    + """, cut AS (SELECT *, min(CASE WHEN op = 'TRUNCATE' THEN pos END) OVER (PARTITION BY file_id ORDER BY op_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM ops),
    w AS (SELECT file_id, op_seq, pos AS start, least(pos + size, coalesce(c, pos + size)) AS stop FROM cut WHERE op = 'WRITE'),
    e AS (SELECT * FROM w WHERE stop > start),
    b AS (SELECT DISTINCT file_id, x FROM (SELECT file_id, start AS x FROM e UNION ALL SELECT file_id, stop FROM e)),
    i AS (SELECT file_id, x AS start, lead(x) OVER (PARTITION BY file_id ORDER BY x) AS stop FROM b)
    SELECT i.file_id, i.start, i.stop, max(e.op_seq) AS op_seq FROM i JOIN e ON i.file_id = e.file_id AND e.start < i.stop AND i.start < e.stop
    WHERE i.stop IS NOT NULL GROUP BY 1, 2, 3"""
)
def overlay_last_writer(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.overlay(_ops(spark, folder))


_HANDLES = """, s AS (SELECT *, sum(CASE op WHEN 'OPEN' THEN 1 WHEN 'RELEASE' THEN -1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY op_seq) AS s FROM ops),
    h AS (SELECT file_id, op_seq, op, pos, size, CAST(s - least(0, min(s) OVER (PARTITION BY file_id ORDER BY op_seq)) AS BIGINT) AS handles FROM s)"""
_SIZED = (
    _HANDLES
    + """, v AS (SELECT *, coalesce(lag(handles) OVER (PARTITION BY file_id ORDER BY op_seq), 0) AS before FROM h),
    z AS (SELECT *, op IN ('WRITE', 'TRUNCATE') AND before > 0 AS valid FROM v),
    y AS (SELECT *, sum(CASE WHEN valid AND op = 'TRUNCATE' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY op_seq) AS cuts FROM z),
    sized AS (SELECT *, greatest(0, max(CASE WHEN valid AND op = 'TRUNCATE' THEN pos WHEN valid THEN pos + size ELSE 0 END) OVER (PARTITION BY file_id, cuts ORDER BY op_seq)) AS file_size FROM y),
    t AS (SELECT *, op = 'RELEASE' AND before = 1 AS closes FROM sized),
    u AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM t),
    q AS (SELECT *, max(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, session) AS changed FROM u)"""
)
_QUEUE = FD_SQL + _SIZED + "SELECT file_id, op_seq, CAST(file_size AS BIGINT) AS file_size FROM q WHERE closes AND changed = 1"


@query(FD_SQL + _HANDLES + "SELECT file_id, op_seq, handles FROM h")
def handle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.handle_counts(_ops(spark, folder)).select("file_id", "op_seq", "handles")


@query(_QUEUE)
def persist_queue(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.persist_queue(_ops(spark, folder))


@query(_QUEUE)
def stream_persist(spark: SparkSession, folder: str) -> DataFrame:
    """The same closings from a stream: the log is written as files and read back by a streaming query."""
    import uuid

    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    ops = _ops(spark, folder)
    ops.write.parquet(f"{base}/log")
    oplog.drain(oplog.persist_stream(spark.readStream.schema(ops.schema).parquet(f"{base}/log")), f"{base}/out", f"{base}/state")
    return spark.read.schema("file_id long, op_seq long, file_size long").parquet(f"{base}/out")


@query(
    FD_SQL
    + _SIZED
    + """SELECT file_id, CASE WHEN bool_or(valid) THEN CAST(max_by(file_size, op_seq) AS BIGINT) ELSE file_id * 7 END AS size FROM sized GROUP BY file_id"""
)
def visible_sizes(spark: SparkSession, folder: str) -> DataFrame:
    ops = _ops(spark, folder)
    stored = ops.select("file_id").distinct().withColumn("size", F.col("file_id") * 7)
    return oplog.visible_sizes(ops, stored)


# --- tree ---------------------------------------------------------------------------------------


@query(FA_SQL + "SELECT id, \"parentId\", name, time, \"dataId\" FROM te WHERE deleted = 0 AND id IN (SELECT 1000000 + o_orderkey FROM orders)")
def entry_by_id(spark: SparkSession, folder: str) -> DataFrame:
    wanted = fixtures.read(spark, folder, "orders").select((F.col("o_orderkey") + fixtures.FIRST_FILE).alias("id"))
    return tree.entry(_entries(spark, folder), wanted).select("id", "parentId", "name", "time", "dataId")


@query(FA_SQL + "SELECT id, \"parentId\", name FROM te WHERE deleted = 0 AND \"dataId\" IS NOT NULL")
def child_lookup(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    documents = entries.where(~is_dir())
    right = documents.select("parentId", "name")
    # Names are told apart by case.
    wrong = documents.select("parentId", F.upper("name").alias("name"))
    return tree.child(entries, right.unionByName(wrong)).select("id", "parentId", "name")


@query(FA_SQL + "SELECT id, \"parentId\", name FROM te WHERE deleted = 0 AND name <> ''")
def children_list(spark: SparkSession, folder: str) -> DataFrame:
    return tree.children(_entries(spark, folder)).select("id", "parentId", "name")


@query(FA_SQL + "SELECT id, path FROM paths")
def live_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tree.paths(_entries(spark, folder)).select("id", "path")


_URLS = """WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages WHERE url IS NOT NULL),
    v AS (SELECT page_id, list_filter(parts, lambda x: x <> '') AS parts FROM u), w AS (SELECT page_id, '/' || array_to_string(parts, '/') AS path FROM v)"""


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as paths: the host is the top directory."""
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    pages = fixtures.read(spark, folder, "pages").where("url IS NOT NULL")
    return pages.select("page_id", F.concat(F.lit("/"), F.array_join(parts, "/")).alias("path"))


@query(
    FA_SQL
    + """, want AS (SELECT '/' || lang || '//' || source || '/doc_' || doc_id || '.txt/' AS path FROM f UNION ALL SELECT '/' || lang || '/none' FROM l UNION ALL SELECT '/')
    SELECT want.path, paths.id FROM want LEFT JOIN paths ON replace(CASE WHEN want.path = '/' THEN '/' ELSE rtrim(want.path, '/') END, '//', '/') = CASE WHEN paths.id = 0 THEN '/' ELSE rtrim(paths.path, '/') END"""
)
def resolve_paths(spark: SparkSession, folder: str) -> DataFrame:
    files = fixtures.files(spark, folder)
    docs = files.select(F.concat(F.lit("/"), "lang", F.lit("//"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt/")).alias("path"))
    misses = files.select(F.concat(F.lit("/"), "lang", F.lit("/none")).alias("path")).distinct()
    root = spark.range(1).select(F.lit("/").alias("path"))
    return tree.resolve(_entries(spark, folder), docs.unionByName(misses).unionByName(root)).select("path", "id")


@query(FA_SQL + r"SELECT id, path FROM paths WHERE lower(name) LIKE 'doc\_%7.t_t' ESCAPE '\'")
def find_name_like(spark: SparkSession, folder: str) -> DataFrame:
    return tree.find(_entries(spark, folder), patterns.name_like(F.col("name"), "DOC_*7.t?t"))


@query(_URLS + "SELECT page_id, path FROM w WHERE regexp_full_match(path, '(?i).*/de/.*5.*')")
def find_path_glob(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).where(patterns.path_like(F.col("path"), "/DE/*5"))


_RULES = ["# left out", "", "*/en/", "*.example.com/de/*1", "m.*/fr/?"]


@query(_URLS + "SELECT page_id, path FROM w WHERE NOT (regexp_full_match(path, '/[^/]*/en/.*') OR regexp_full_match(path, '/[^/]*\\.example\\.com/de/[^/]*1') OR regexp_full_match(path, '/m\\.[^/]*/fr/.'))")
def ignore_rules(spark: SparkSession, folder: str) -> DataFrame:
    relative = F.expr("substring(path, 2)")
    return _urls(spark, folder).where(~patterns.ignored(relative, patterns.parse_rules(_RULES)))


_LISTING = """, z AS (SELECT te.*, te."dataId" IS NULL AS is_dir, CASE WHEN te."dataId" IS NOT NULL THEN coalesce(de.length, 0) END AS size FROM te LEFT JOIN de ON te."dataId" = de.id WHERE deleted = 0 AND name <> ''),
    listing AS (SELECT *, CAST(row_number() OVER (PARTITION BY "parentId" ORDER BY is_dir DESC, name, id) AS INTEGER) AS place FROM z)"""


@query(FA_SQL + _LISTING + "SELECT id, \"parentId\", name, is_dir, size, place FROM listing")
def dir_listing(spark: SparkSession, folder: str) -> DataFrame:
    return tree.listing(_entries(spark, folder), _contents(spark, folder)).select("id", "parentId", "name", "is_dir", "size", "place")


@query(
    FA_SQL
    + _LISTING
    + """SELECT "parentId", name, "at" FROM (SELECT "parentId", name, place + 2 AS "at" FROM listing
    UNION ALL SELECT DISTINCT "parentId", '.', 1 FROM listing UNION ALL SELECT DISTINCT "parentId", '..', 2 FROM listing) WHERE "at" > 1 AND "at" <= 6"""
)
def dir_page(spark: SparkSession, folder: str) -> DataFrame:
    return tree.page(tree.listing(_entries(spark, folder), _contents(spark, folder)), 1, 5)


@query(
    FA_SQL
    + """SELECT count(*) FILTER ("dataId" IS NOT NULL AND deleted = 0) AS files, count(*) FILTER ("dataId" IS NOT NULL AND deleted <> 0) AS deleted_files,
    count(*) FILTER ("dataId" IS NULL AND deleted = 0) AS dirs, count(*) FILTER ("dataId" IS NULL AND deleted <> 0) AS deleted_dirs,
    (SELECT count(*) FROM de WHERE seq = 1) AS contents, (SELECT max(stop) FROM de) AS storage_end, (SELECT CAST(sum(stop - start) AS BIGINT) FROM de) AS live_bytes FROM te"""
)
def repo_stats(spark: SparkSession, folder: str) -> DataFrame:
    return maintenance.stats(_entries(spark, folder), _contents(spark, folder))


@query(
    FA_SQL
    + _GAPS
    + """SELECT count(*) FILTER ("dataId" IS NOT NULL AND deleted = 0) AS files, count(*) FILTER ("dataId" IS NOT NULL AND deleted <> 0) AS deleted_files,
    count(*) FILTER ("dataId" IS NULL AND deleted = 0) AS dirs, count(*) FILTER ("dataId" IS NULL AND deleted <> 0) AS deleted_dirs,
    (SELECT count(*) FROM used) + (SELECT count(*) FROM de WHERE stop = start AND id IN (SELECT "dataId" FROM te WHERE deleted = 0)) AS contents,
    (SELECT max(stop) FROM used) AS storage_end, (SELECT CAST(sum(stop - start) AS BIGINT) FROM used) AS live_bytes,
    (SELECT count(*) FROM gaps) AS gaps, (SELECT CAST(coalesce(sum(stop - start), 0) AS BIGINT) FROM gaps) AS free_bytes FROM te"""
)
def repo_report(spark: SparkSession, folder: str) -> DataFrame:
    return maintenance.report(_entries(spark, folder), written(_used(spark, folder), "used"))


_SUBTREE = """, a AS (SELECT id AS ancestor, id, 0 AS depth FROM te WHERE deleted = 0 AND "dataId" IS NULL
    UNION ALL SELECT a.ancestor, te.id, a.depth + 1 FROM a JOIN te ON te."parentId" = a.id AND te.id <> te."parentId" AND te.deleted = 0)"""


@query(
    FA_SQL
    + _SUBTREE
    + """SELECT a.ancestor AS id, count(*) FILTER (te."dataId" IS NOT NULL) AS files, count(*) FILTER (te."dataId" IS NULL AND depth > 0) AS dirs, CAST(sum(coalesce(de.length, 0)) AS BIGINT) AS bytes
    FROM a JOIN te ON a.id = te.id LEFT JOIN de ON te."dataId" = de.id GROUP BY 1"""
)
def subtree_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tree.subtree_stats(_entries(spark, folder), _contents(spark, folder))


@query(
    """SELECT n_regionkey AS region, n_nationkey AS nation, c_custkey AS customer, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(grouping(n_regionkey, n_nationkey, c_custkey) AS BIGINT) AS level
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY ROLLUP (n_regionkey, n_nationkey, c_custkey)"""
)
def subtree_rollup_fixed_depth(spark: SparkSession, folder: str) -> DataFrame:
    t = {n: fixtures.read(spark, folder, n) for n in ("nation", "customer", "orders", "lineitem")}
    # Leaves are summed per order first, so that only one row per order takes part in the joins above.
    leaves = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("_n"), F.sum(F.col("l_quantity").cast("long")).alias("_b"))
    per_customer = t["orders"].join(leaves, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    rows = per_customer.join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), "_n", "_b")
    return named.rollup("region", "nation", "customer").agg(F.sum("_n").alias("files"), F.sum("_b").alias("bytes"), F.grouping_id().alias("level"))


@query(FA_SQL + "SELECT te.id, te.\"dataId\" FROM te WHERE deleted = 0 AND \"dataId\" IN (SELECT id FROM de)")
def entries_for_content(spark: SparkSession, folder: str) -> DataFrame:
    return tree.entries_for_content(_entries(spark, folder), _contents(spark, folder)).select("id", "dataId")


@query(FA_SQL + _PARTS + "SELECT de.id, de.length AS logical, CAST(coalesce((SELECT sum(p.stop - p.start) FROM parts p WHERE p.id = de.id), 0) AS BIGINT) AS stored, hash FROM de")
def logical_vs_storage_size(spark: SparkSession, folder: str) -> DataFrame:
    return maintenance.storage_sizes(content.multipart(_contents(spark, folder), 1000))


@query(
    FA_SQL + "SELECT id, CASE WHEN id <> 0 AND deleted = 0 AND id NOT IN (SELECT \"parentId\" FROM te WHERE deleted = 0) THEN 1800000000000 ELSE deleted END AS deleted FROM te"
)
def soft_delete_childless(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return maintenance.mark_deleted(entries, maintenance.deletable(entries), NOW).select("id", "deleted")


@query(
    FA_SQL
    + _SUBTREE
    + """SELECT id, CASE WHEN deleted = 0 AND id IN (SELECT a.id FROM a WHERE a.ancestor = 2) THEN 1800000000000 ELSE deleted END AS deleted FROM te"""
)
def recursive_delete(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return maintenance.delete_recursively(entries, entries.where("id = 2"), NOW).select("id", "deleted")


_EXPIRED = """, d AS (SELECT id, "parentId", "dataId", CASE WHEN id = 101 THEN 1600000000000 ELSE deleted END AS deleted FROM te),
    gone AS (SELECT id FROM d WHERE deleted <> 0 AND deleted <= 1700000000000 + 500 AND id <> 0 UNION SELECT d.id FROM d JOIN gone ON d."parentId" = gone.id WHERE d.id <> d."parentId" AND d.id <> 0)"""


def _expired(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of which one whole directory was deleted earlier, its files being live."""
    return _entries(spark, folder).withColumn("deleted", F.when(F.col("id") == 101, F.lit(1_600_000_000_000)).otherwise(F.col("deleted")))


@query(FA_SQL + _EXPIRED + "SELECT id FROM gone")
def reclaim_closure(spark: SparkSession, folder: str) -> DataFrame:
    return maintenance.purged(_expired(spark, folder), 30, 1_700_000_000_500 + 30 * maintenance.DAY_MILLIS)


@query(FA_SQL + _EXPIRED + "SELECT de.id FROM de WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.\"dataId\" = de.id AND d.id NOT IN (SELECT id FROM gone))")
def reclaimed_contents(spark: SparkSession, folder: str) -> DataFrame:
    contents = _contents(spark, folder)
    _, kept = maintenance.reclaim(_expired(spark, folder), contents, 30, 1_700_000_000_500 + 30 * maintenance.DAY_MILLIS)
    return contents.select("id").join(kept.select(F.col("id").alias("_k")), F.col("id") == F.col("_k"), "left_anti")


@query(FA_SQL + "SELECT id FROM de WHERE id NOT IN (SELECT \"dataId\" FROM te WHERE \"dataId\" IS NOT NULL AND deleted = 0)")
def orphan_contents(spark: SparkSession, folder: str) -> DataFrame:
    return maintenance.orphan_contents(_entries(spark, folder).where(is_live()), _contents(spark, folder))


@query("SELECT o_orderkey AS \"dataId\" FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_references(spark: SparkSession, folder: str) -> DataFrame:
    orders = fixtures.read(spark, folder, "orders").select(F.col("o_orderkey").alias("dataId"))
    return maintenance.orphan_references(orders, fixtures.read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id")))


_BANNED = _SUBTREE + """, banned AS (SELECT DISTINCT te."dataId" AS id FROM a JOIN te ON a.id = te.id WHERE a.ancestor = 102 AND te."dataId" IS NOT NULL)"""


@query(FA_SQL + _BANNED + "SELECT id, CASE WHEN id IN (SELECT id FROM banned) THEN 0 ELSE start END AS start, CASE WHEN id IN (SELECT id FROM banned) THEN 0 ELSE stop END AS stop FROM de")
def blacklist_effect(spark: SparkSession, folder: str) -> DataFrame:
    _, after = maintenance.blacklist(_entries(spark, folder), _contents(spark, folder), 102, False, NOW)
    return after.select("id", "start", "stop")


@query(
    FA_SQL
    + _BANNED
    + """SELECT id, CASE WHEN deleted = 0 AND "dataId" IN (SELECT id FROM banned) AND id NOT IN (SELECT a.id FROM a WHERE a.ancestor = 102) THEN 1800000000000 ELSE deleted END AS deleted FROM te"""
)
def blacklist_copies(spark: SparkSession, folder: str) -> DataFrame:
    after, _ = maintenance.blacklist(_entries(spark, folder), _contents(spark, folder), 102, True, NOW)
    return after.select("id", "deleted")


@query(
    FA_SQL
    + """SELECT id, CASE WHEN length = 0 THEN 'OK' WHEN id % 11 = 0 THEN 'BLACKLISTED' WHEN id % 13 = 0 THEN 'BAD SIZE' WHEN id % 17 = 0 THEN 'NO HASH' WHEN id % 19 = 0 THEN 'UNREADABLE'
    WHEN id % 23 = 0 THEN 'BAD HASH' ELSE 'OK' END AS verdict FROM de"""
)
def integrity_check(spark: SparkSession, folder: str) -> DataFrame:
    de, i = _contents(spark, folder), F.col("id")
    full = F.col("length") > 0
    stop = F.when(full & (i % 11 == 0), F.col("start")).when(full & (i % 11 != 0) & (i % 13 == 0), F.col("stop") + 1).otherwise(F.col("stop"))
    faulty = de.withColumn("stop", stop).withColumn("hash", F.when(i % 17 != 0, F.col("hash")))
    actual = de.where(i % 19 != 0).select("id", F.when(i % 23 == 0, "?").otherwise(F.col("hash")).alias("actual_hash"))
    return maintenance.check(faulty, actual)


@query(
    FA_SQL
    + """, x AS (SELECT CASE WHEN id % 97 = 5 AND "dataId" IS NOT NULL THEN id + 1 ELSE id END AS id, CASE WHEN id % 89 = 7 AND "dataId" IS NOT NULL THEN 77 ELSE "parentId" END AS "parentId",
    CASE WHEN id % 83 = 9 AND "dataId" IS NOT NULL THEN name || '?' ELSE name END AS name, deleted, "dataId" FROM te),
    par AS (SELECT id, bool_and("dataId" IS NULL) AS d, bool_and(deleted = 0) AS live FROM x WHERE id < 1000000 GROUP BY id)
    SELECT 'unique id' AS rule, CAST(id AS VARCHAR) AS key FROM x GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'parent exists', CAST(id AS VARCHAR) FROM x WHERE "parentId" NOT IN (SELECT id FROM x)
    UNION ALL SELECT 'valid name', CAST(id AS VARCHAR) FROM x WHERE id <> 0 AND contains(name, '?')"""
)
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    is_file = ~is_dir()
    faulty = _entries(spark, folder).select(
        F.when((F.col("id") % 97 == 5) & is_file, F.col("id") + 1).otherwise(F.col("id")).alias("id"),
        F.when((F.col("id") % 89 == 7) & is_file, F.lit(77)).otherwise(F.col("parentId")).cast("long").alias("parentId"),
        F.when((F.col("id") % 83 == 9) & is_file, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"),
        "time",
        "deleted",
        "dataId",
    )
    return checks.tree_violations(faulty)


_MOVES = """, m AS (SELECT id AS request, id, 101 AS "parentId", CASE WHEN id % 3 = 0 THEN 'moved_' || id ELSE 'doc_' || (id % 40) || '.txt' END AS name, "parentId" AS op, name AS "on" FROM te
      WHERE deleted = 0 AND "dataId" IS NOT NULL),
    j AS (SELECT m.*, row_number() OVER (PARTITION BY name ORDER BY request) AS turn FROM m)"""


@query(FA_SQL + _MOVES + "SELECT request, CASE WHEN op = 101 AND \"on\" = name THEN 'OK' WHEN turn > 1 THEN 'EEXIST' ELSE 'OK' END AS outcome FROM j")
def rename_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("moved_"), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("doc_"), (F.col("id") % 40).cast("string"), F.lit(".txt"))
    )
    moves = entries.where(is_live() & ~is_dir()).select(
        F.col("id").alias("request"), "id", F.lit(101).cast("long").alias("parentId"), name.alias("name")
    )
    return edits.rename(entries, moves)[1]


_ASKED = """, m AS (SELECT id AS request, id, CASE id % 7 WHEN 0 THEN 101 WHEN 1 THEN 999999999 WHEN 2 THEN 1000000 WHEN 3 THEN 0 ELSE "parentId" END AS np,
      CASE id % 7 WHEN 3 THEN 'en' WHEN 4 THEN 'a/b' WHEN 5 THEN name ELSE 'to_' || id // 2 END AS nn, "parentId" AS op, name AS old, "dataId" AS data, deleted FROM te),
    live AS (SELECT * FROM te WHERE deleted = 0)"""


def _asked(entries: DataFrame) -> DataFrame:
    """Requests for every entry that end in all ways: missing parents, parents that are files, bad, own, taken and free names."""
    k, parent = F.col("id") % 7, F.col("parentId")
    to = F.when(k == 0, F.lit(101)).when(k == 1, F.lit(999_999_999)).when(k == 2, F.lit(fixtures.FIRST_FILE)).when(k == 3, F.lit(0)).otherwise(parent)
    name = F.when(k == 3, F.lit("en")).when(k == 4, F.lit("a/b")).when(k == 5, F.col("name")).otherwise(F.concat(F.lit("to_"), F.expr("id div 2").cast("string")))
    return entries.select(F.col("id").alias("request"), "id", to.cast("long").alias("parentId"), name.alias("name"))


@query(
    FA_SQL
    + _ASKED
    + """, j AS (SELECT m.request, m.id, m.data, p.id AS pid, p."dataId" AS pdata, nn, np = op AND nn = old AS own, t.id AS tid, t."dataId" AS tdata,
        EXISTS (SELECT 1 FROM live c WHERE c."parentId" = t.id AND c.id <> c."parentId") AS filled, row_number() OVER (PARTITION BY np, nn ORDER BY request) AS turn
      FROM m LEFT JOIN live p ON m.np = p.id LEFT JOIN live t ON t."parentId" = m.np AND t.name = m.nn AND t.id <> 0 WHERE m.deleted = 0)
    SELECT request, CASE WHEN id = 0 OR pid IS NULL THEN 'ENOENT' WHEN pdata IS NOT NULL THEN 'ENOTDIR' WHEN contains(nn, '/') THEN 'EINVAL' WHEN own THEN 'OK'
      WHEN data IS NOT NULL AND tid IS NOT NULL AND tdata IS NULL THEN 'EISDIR' WHEN filled THEN 'ENOTEMPTY' WHEN turn > 1 THEN 'EEXIST' ELSE 'OK' END AS outcome FROM j"""
)
def rename_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return edits.rename(entries, _asked(entries.where(is_live())), NOW)[1]


@query(
    FA_SQL
    + _ASKED
    + """, j AS (SELECT m.request, CASE WHEN contains(nn, '/') OR nn = '' THEN 'EINVAL' WHEN p."dataId" IS NOT NULL THEN 'ENOTDIR' WHEN p.id IS NULL THEN 'ENOENT'
        WHEN EXISTS (SELECT 1 FROM live t WHERE t."parentId" = m.np AND t.name = m.nn) OR row_number() OVER (PARTITION BY np, nn ORDER BY request) > 1 THEN 'EEXIST' ELSE 'OK' END AS outcome
      FROM m LEFT JOIN live p ON m.np = p.id)
    SELECT request, outcome, CASE WHEN outcome = 'OK' THEN 6000000 + row_number() OVER (PARTITION BY outcome ORDER BY request) - 1 END AS id FROM j"""
)
def make_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    asked = _asked(entries).select("request", "parentId", "name", F.lit(NOW).alias("time"), F.lit(None).cast("long").alias("dataId"))
    return edits.make(entries, asked, 6_000_000)[1]


@query(FA_SQL + 'SELECT id, CASE WHEN deleted = 0 THEN id * 3 ELSE time END AS time, CASE WHEN deleted = 0 AND "dataId" IS NOT NULL THEN 7 ELSE "dataId" END AS "dataId" FROM te')
def update_entries(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    live = entries.where(is_live())
    timed = edits.update(entries, live.select("id", (F.col("id") * 3).alias("time")), "time")
    return edits.update(timed, live.where(~is_dir()).select("id", F.lit(7).cast("long").alias("dataId")), "dataId").select("id", "time", "dataId")


@query(
    FA_SQL
    + """, d AS (SELECT id, "parentId", name, "dataId", CASE WHEN id = 101 THEN 1600000000000 ELSE deleted END AS deleted FROM te),
    q AS (SELECT id, CASE WHEN id = 0 THEN '/' ELSE '[not found]/' || name || '/' END AS path FROM d WHERE deleted = 0 AND (id = 0 OR "parentId" NOT IN (SELECT id FROM d WHERE deleted = 0))
      UNION ALL SELECT d.id, q.path || d.name || '/' FROM d JOIN q ON d."parentId" = q.id WHERE d.id <> d."parentId" AND d.deleted = 0)
    SELECT q.id, CASE WHEN d."dataId" IS NULL THEN q.path ELSE rtrim(q.path, '/') END AS path FROM q JOIN d ON q.id = d.id"""
)
def broken_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tree.paths(_expired(spark, folder), broken=True).select("id", "path")


@query(
    FA_SQL
    + _SUBTREE
    + """, o AS (SELECT a.id, 7000000 + row_number() OVER (ORDER BY a.id) - 1 AS new_id FROM a WHERE a.ancestor = 2)
    SELECT o.new_id AS id, CASE WHEN te.id = 2 THEN 0 ELSE q.new_id END AS "parentId", CASE WHEN te.id = 2 THEN 'copy' ELSE te.name END AS name, te."dataId"
    FROM o JOIN te ON te.id = o.id LEFT JOIN o q ON te."parentId" = q.id"""
)
def copy_subtree(spark: SparkSession, folder: str) -> DataFrame:
    return tree.copy_subtree(_entries(spark, folder), 2, 0, "copy", 7_000_000).select("id", "parentId", "name", "dataId")


_PLAN = """, src AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, doc_id * 1000 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS time, length AS size, doc_id FROM f),
    ref AS (SELECT ltrim(path, '/') AS path, paths.id, time, coalesce(de.length, 0) AS size, "dataId" FROM paths LEFT JOIN de ON "dataId" = de.id WHERE "dataId" IS NOT NULL),
    tgt AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN 1000000 + doc_id ELSE 8000000 + doc_id END AS id, doc_id % 30 = 0 AS is_dir FROM src WHERE doc_id % 5 <> 1),
    pl AS (SELECT src.path, coalesce(src.time = ref.time AND src.size = ref.size, false) AS same, tgt.id AS tid, tgt.is_dir, ref.id AS rid, ref."dataId" AS data
           FROM src LEFT JOIN ref ON src.path = ref.path LEFT JOIN tgt ON src.path = tgt.path)"""


@query(
    FA_SQL
    + _PLAN
    + """SELECT path, CASE WHEN tid IS NULL THEN CASE WHEN same THEN 'COPY REFERENCE' ELSE 'CREATE' END WHEN is_dir THEN 'REPLACE DIRECTORY, ' || CASE WHEN same THEN 'COPY REFERENCE' ELSE 'CREATE' END
    WHEN same AND tid = rid THEN 'KEEP' WHEN same THEN 'REPLACE BY REFERENCE' ELSE 'UPDATE' END AS action, CASE WHEN same THEN data END AS "dataId" FROM pl"""
)
def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    files, contents = fixtures.files(spark, folder), _contents(spark, folder)
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    touched = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    source = files.select(path.alias("path"), (F.col("doc_id") * 1000 + touched).alias("time"), F.col("length").alias("size"), "doc_id")
    reference = tree.with_sizes(tree.paths(_entries(spark, folder)).where(~is_dir()), contents).select(F.expr("substring(path, 2)").alias("path"), "id", "time", "size", "dataId")
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id") + 8_000_000)
    target = source.where("doc_id % 5 <> 1").select("path", own.alias("id"), (F.col("doc_id") % 30 == 0).alias("is_dir"))
    return ingest.ingest_plan(source.select("path", "time", "size"), target, reference).select("path", "action", "dataId")


@query(
    FA_SQL
    + """, a AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name FROM te WHERE "dataId" IS NOT NULL), b AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN 'new_' || name ELSE name END AS name FROM te WHERE "dataId" IS NOT NULL),
    n AS (SELECT (SELECT count(*) FROM a) AS source_names, (SELECT count(*) FROM b) AS reference_names, (SELECT count(*) FROM a JOIN b ON a.name = b.name) AS common)
    SELECT *, greatest(source_names, reference_names) * 10 <= common * 16 + 10 AS accepted FROM n"""
)
def reference_similarity(spark: SparkSession, folder: str) -> DataFrame:
    files = _entries(spark, folder).where(~is_dir())
    changed = files.select(F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"))
    renamed = files.select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("new_"), "name")).otherwise(F.col("name")).alias("name"))
    return ingest.similarity(changed, renamed)


@query(FA_SQL + "SELECT \"parentId\", id, name FROM (SELECT *, row_number() OVER (PARTITION BY \"parentId\" ORDER BY name DESC, id DESC) AS n FROM te WHERE deleted = 0 AND \"dataId\" IS NULL AND name <> '' AND regexp_full_match(name, 'src.*')) WHERE n = 1")
def latest_reference(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.latest_per_parent(_entries(spark, folder), "src*")


@query(
    """SELECT doc_id, n_chars * n_chars * n_chars AS size,
    CASE WHEN n_chars * n_chars * n_chars < 10000 THEN format('{:,} B', n_chars * n_chars * n_chars)
         WHEN n_chars * n_chars * n_chars < 1000000 THEN format('{:,.2f} kB', round(n_chars * n_chars * n_chars / 1000, 2))
         WHEN n_chars * n_chars * n_chars < 1000000000 THEN format('{:,.2f} MB', round(n_chars * n_chars * n_chars / 1000000, 2))
         WHEN n_chars * n_chars * n_chars < 1000000000000 THEN format('{:,.2f} GB', round(n_chars * n_chars * n_chars / 1000000000, 2))
         ELSE format('{:,.2f} TB', round(n_chars * n_chars * n_chars / 1000000000000, 2)) END AS readable FROM documents"""
)
def readable_sizes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    return fixtures.read(spark, folder, "documents").select("doc_id", size.alias("size"), readable_bytes(size).alias("readable"))


@query("SELECT event_id, '/archive/' || strftime(ts, '%Y') || '/' || strftime(ts, '%Y.%m.%d_%H-%M') || '_[x]' AS target FROM events")
def target_date_path(spark: SparkSession, folder: str) -> DataFrame:
    target = patterns.target_paths(r"/archive/[yyyy]/[yyyy.MM.dd_HH-mm]_\[x\]", F.col("ts"))
    return fixtures.read(spark, folder, "events").select("event_id", target.alias("target"))


@query(
    """WITH t AS (SELECT event_id, event_id * 7919 - 1000000 AS ms FROM events), p AS (SELECT *, ((ms % 1000) + 1000) % 1000 AS rest FROM t)
    SELECT event_id, (ms - rest) // 1000 AS seconds, rest * 1000000 AS nanos, CASE WHEN ms >= 0 THEN ms END AS again, CASE WHEN event_id = 0 THEN 1 ELSE event_id END AS marked FROM p"""
)
def time_conversions(spark: SparkSession, folder: str) -> DataFrame:
    parts = seconds_nanos(F.col("event_id") * 7919 - 1_000_000)
    rows = fixtures.read(spark, folder, "events").select("event_id", parts.alias("p")).select("event_id", "p.seconds", "p.nanos")
    return rows.withColumn("again", millis_of(F.col("seconds"), F.col("nanos"))).withColumn("marked", non_zero(F.col("event_id")))


@query(FA_SQL + "SELECT doc_id AS id, hash, length FROM f")
def restore_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Contents go through the store and back: chunks, areas, store pieces, reads, and each file's bytes again."""
    docs = fixtures.read(spark, folder, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    contents = _contents(spark, folder)
    parts = content.multipart(contents, 10_000)
    firsts = docs.withColumn("id", F.col("doc_id") + 1).join(contents.select("id"), "id", "left_semi")
    store = content.to_areas(content.chunked(firsts), parts.select("id", "seq", "start", "stop")).select("start", "bytes")
    whole = content.assemble(content.read_contents(parts, store), contents.select("id", "length"))
    again = whole.select(F.col("id").alias("_c"), F.md5("data").alias("hash"), F.octet_length("data").cast("long").alias("length"))
    files = _entries(spark, folder).where(~is_dir()).select((F.col("id") - fixtures.FIRST_FILE).alias("id"), "dataId")
    return files.join(again, F.col("dataId") == F.col("_c")).select("id", "hash", "length")
