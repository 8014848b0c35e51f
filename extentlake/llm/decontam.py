"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark text.

A text is normalised by lower-casing A-Z and keeping the words, runs of ASCII digits, letters and
non-ASCII characters, one blank apart.  A benchmark item's windows are all runs of ``window``
consecutive words; an item of fewer words, but not none, is one window.  The automaton holds every
distinct window of the benchmark, so one scan of a document finds all occurrences of all items.
Offsets in the normalised text lead back to words and from there to the original text.

The automaton is built once per Python worker from a broadcast list of windows.  The list's bytes
are checked: a benchmark above ``block_bytes`` is cut into blocks of runs of its items' words, each with an automaton
of its own; each row is then scanned by one block after the other and carries its findings along, so
nothing that is broadcast grows with the benchmark.

Null or word-less documents have no hits; items of null text or without words have no windows.  Items
without an id count as one item, whose id is null and comes last in the list.  Repeated items
and repeated windows are legal: an occurrence counts for every item that has the window.  An empty
benchmark leaves every document clean, and no documents give no rows.  Repeated rows and keys are rows like others.  A very long text is
scanned whole, as one cell.  Only the named columns are read; ``clean`` keeps all others, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Words of a benchmark window.
WINDOW = 10
#: Bytes of normalised benchmark text that one automaton may hold.
BLOCK_BYTES = 8 << 20
#: Windows of an item that stay together: a longer item is cut into runs of words that overlap by all but one word of a window.
RUN = 4096

#: Maps A-Z to a-z and all other ASCII but digits and a-z to a blank; other bytes stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def normalised(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode().translate(_FOLD).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item's words, as normalised text."""
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def _sorted_ids(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


class Automaton:
    """An Aho-Corasick automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        import ahocorasick

        owners: dict[bytes, set[str | None]] = defaultdict(set)
        for item, text in items:
            for window in windows(normalised(text), size):
                owners[window].add(item)
        self.machine = ahocorasick.Automaton()
        for window, ids in owners.items():
            # Blanks at both ends keep a match from starting or ending inside a word.
            padded = b" " + window + b" "
            self.machine.add_word(padded.decode("latin-1"), (len(padded), window.count(b" ") + 1, tuple(_sorted_ids(ids))))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which words lie in an occurrence of a window, and the items those windows belong to."""
        hit = np.zeros(len(words) + 1, dtype=np.int32)
        found: set[str | None] = set()
        if self.empty or not words:
            return hit[:-1] > 0, found
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts = None
        for end, (length, n, ids) in self.machine.iter(text):
            if starts is None:
                # Where each word's leading blank stands in the normalised text.
                starts = np.fromiter(accumulate((len(w) + 1 for w in words), initial=0), dtype=np.int64)
            first = int(np.searchsorted(starts, end - length + 1))
            hit[first] += 1
            hit[first + n] -= 1
            found.update(ids)
        return np.cumsum(hit[:-1]) > 0, found


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """The code point ranges of the original text that runs of hit words cover."""
    raw = text.encode()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = [m.span() for m in _WORD.finditer(raw)]
    spans = []
    for a, b in edges.reshape(-1, 2):
        start, end = at[a][0], at[b - 1][1]
        first = len(raw[:start].decode())
        spans.append({"start": first, "end": first + len(raw[start:end].decode())})
    return spans


_built: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str | None, str | None]], size: int) -> Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, size)
    return _built[key]


def _runs(hit: np.ndarray) -> list[dict]:
    """Runs [start, end) of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    return [{"start": int(a), "end": int(b)} for a, b in edges]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(rows: DataFrame, items: list[tuple[str | None, str | None]], size: int, last: bool) -> DataFrame:
    """``rows`` (key, text and, behind an earlier block, items and runs of hit words) with the findings of one more block;
    key, n_words, n_hit, items and spans behind the last."""
    key = hashlib.sha256(repr((items, size)).encode()).hexdigest()
    held = rows.sparkSession.sparkContext.broadcast(items)
    ids_type = T.StructField("items", T.ArrayType(T.StringType()))
    if last:
        added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), ids_type, T.StructField("spans", FOUND)]
        types = [pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS]
    else:
        added = [ids_type, T.StructField("runs", FOUND)]
        types = [pa.list_(pa.string()), _SPANS]
    kept = 1 if last else 2
    schema = T.StructType([*rows.schema.fields[:kept], *added])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _automaton(key, held.value, size)
        none = [[]] * batch.num_rows
        before = [c.to_pylist() for c in batch.columns[2:]] or [none, none]
        out = []
        for text, ids, runs in zip(batch.column(1).to_pylist(), *before):
            words = normalised(text)
            hit, found = machine.scan(words)
            for run in runs:
                hit[run["start"] : run["end"]] = True
            found = _sorted_ids(found.union(ids))
            if last:
                out.append((len(words), int(hit.sum()), found, original_spans(text, hit) if hit.any() else []))
            else:
                out.append((found, _runs(hit)))
        columns = [pa.array(c, type=t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], names=schema.names)

    return map_rows(rows, schema, scan)


def _blocks(
    benchmark: DataFrame, item: str, item_text: str, window: int, block_bytes: int
) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items in blocks whose windows together hold about ``block_bytes``, at least one block."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[str | None, str]] = []
        for own, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = normalised(text)
            starts = range(0, max(1, len(words) - window + 1), RUN) if words else ()
            found += ((own, b" ".join(words[at : at + RUN + window - 1]).decode()) for at in starts)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["item", "text"])

    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    items = map_rows(named, "item string, text string", cut)
    # A word is in as many windows as a window has words.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] * window
    count = max(1, -(-size // block_bytes))
    for b in range(count):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b) if count > 1 else items
        yield sorted(((r["item"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each row of ``docs``: its key, n_words, n_hit, the items found (as sorted strings) and the
    code point spans of the original text that are hit.

    Rows are only mapped, whatever the number of blocks: repeated and null keys stay as they are.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = list(_blocks(benchmark, item, item_text, window, block_bytes))
    for b, items in enumerate(blocks):
        rows = _scan(rows, items, window, b == len(blocks) - 1)
    return rows.withColumnRenamed("key", key)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of ``benchmark`` occurs."""
    at = docs.columns.index(text)
    for items in _blocks(benchmark, item, item_text, window, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(items)
        key = hashlib.sha256(repr((items, window)).encode()).hexdigest()

        def keep(batch: pa.RecordBatch, held=held, key=key) -> pa.RecordBatch:
            machine = _automaton(key, held.value, window)
            return batch.filter(pa.array([not machine.scan(normalised(t))[1] for t in batch.column(at).to_pylist()]))

        docs = map_rows(docs, docs.schema, keep)
    return docs
