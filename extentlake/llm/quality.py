"""Quality scores by co-training a text classifier and a page-metadata classifier.

The views are the text (shares of hashed words and character statistics) and the metadata (source, language,
length).  Each has a logistic regression.  All documents are the unlabelled side: they are dealt by hash to pools of about
``POOL``.  In each round both views score a pool, and the documents each is surest of, good and bad, join the other's
training set of that pool with those labels.  The regressions of all pools are averaged by their numbers of documents.
At the end each view is calibrated on labelled documents that were kept apart, and a regression on both calibrated views
gives the score of every document.

The labels are a bounded sample: those ``LABELLED`` with the smallest key hashes.  Only their feature vectors and
the sums of the pools' weights come to the driver.  Pools and scores cover every document and its whole text.

A null text has the features of an empty one; null metadata are a value of their own.  With no labels, as with empty tables, or
labels of one kind, there is nothing to tell apart: the score is the share of good labels, or 0.5.
Labels of unknown documents are ignored; equal labels of one key count once, for that of its documents with the least hash of
the text, and contradicting ones count both.  Equally sure documents are taken in a fixed order.  Repeated rows get equal
scores.  A very long text is one cell.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, partitions
from .linear import balanced, logistic, margins, sigmoid

#: Labels that are used, at most, and documents of one unlabelled pool, about; all documents are in a pool.
LABELLED, POOL = 3000, 16_000
#: The weights of the pools are summed in units of this, so that sums do not depend on the order.
UNIT = 2.0**-32
#: Rounds, and the share of the pool that a view passes on in each.
ROUNDS, SHARE = 4, 0.05
#: Hash bins of words, sources, languages and lengths.
WORD_BINS, SOURCE_BINS, LANG_BINS, LENGTH_BINS = 1 << 10, 64, 16, 24
#: Share of the good calibration documents that the proposed threshold keeps.
KEPT = 0.995

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 5 if _c >= 128 else 0 if chr(_c).islower() else 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3 if chr(_c).isspace() else 4
STATISTICS = 14


class _Bins(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % WORD_BINS
        return value


_bins = _Bins()


def text_view(text: str | None) -> np.ndarray:
    """Statistics and word shares of a whole text."""
    raw = (text or "").encode()
    words = raw.lower().split()
    out = np.zeros(STATISTICS + WORD_BINS, np.float32)
    if not words:
        return out
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / len(raw)
    out[:6] = kinds
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    bins = np.fromiter(map(_bins.__getitem__, words), np.int64, len(words))
    counts = np.bincount(bins, minlength=WORD_BINS)
    out[6] = np.log1p(len(words))
    out[7] = lengths.mean()
    out[8] = lengths.std()
    out[9] = len(set(words)) / len(words)
    out[10] = counts.max() / len(words)
    out[11] = (bins[1:] == bins[:-1]).mean() if len(words) > 1 else 0
    out[12] = sum(not w.isalnum() and w.isascii() for w in words) / len(words)
    out[13] = raw.count(b"\n") / len(words)
    out[STATISTICS:] = np.sqrt(counts / len(words)) * 4
    return out


def meta_view(source: str | None, lang: str | None, length: int | None) -> np.ndarray:
    out = np.zeros(SOURCE_BINS + LANG_BINS + LENGTH_BINS, np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCE_BINS] = 1
    out[SOURCE_BINS + zlib.crc32(repr(lang).encode()) % LANG_BINS] = 1
    out[SOURCE_BINS + LANG_BINS + (0 if length is None else min(LENGTH_BINS - 1, 1 + max(0, int(length)).bit_length()))] = 1
    return out


@dataclass
class Scorer:
    """Two calibrated views and their combination; ``prior`` instead if nothing was learned."""

    text: np.ndarray | None
    meta: np.ndarray | None
    platt: np.ndarray | None
    mixed: np.ndarray | None
    prior: float
    threshold: float

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text view's, the metadata view's and the combined score."""
        if self.text is None:
            flat = np.full(len(x), self.prior)
            return flat, flat, flat
        z = np.stack([margins(x, self.text)[:, 0], margins(m, self.meta)[:, 0]], axis=1)
        calibrated = np.stack([z[:, v] * self.platt[v, 0] + self.platt[v, 1] for v in (0, 1)], axis=1)
        return sigmoid(calibrated[:, 0]), sigmoid(calibrated[:, 1]), sigmoid(margins(calibrated, self.mixed)[:, 0])


def _apart(y: np.ndarray) -> np.ndarray:
    """Every fourth row of either label is for calibration."""
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[::4]] = True
    return apart


def _known(y: np.ndarray) -> bool:
    """Whether there are labels enough of both kinds to learn from."""
    return len(y) >= 8 and y.min() < y.max()


def _train(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return logistic(rows, labels, balanced(labels), l2=1e-3)


def cotrain(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], first: list[np.ndarray]) -> list[np.ndarray]:
    """Both views' weights from labelled rows and a pool of unlabelled ones; ``first`` are those of the labelled rows alone."""
    extra: list[tuple[list[int], list[float]]] = [([], []), ([], [])]
    free = np.ones(len(pools[0]), bool)
    share = max(1, int(SHARE * len(free)))
    good = float(y.mean())
    weights = first
    for _ in range(ROUNDS):
        for v in (0, 1):
            left = np.flatnonzero(free)
            if not len(left):
                break
            z = margins(pools[v], weights[v])[left, 0]
            order = np.argsort(z, kind="stable")
            n_good = min(max(1, round(share * good)), len(left))
            n_bad = min(max(1, round(share * (1 - good))), len(left) - n_good)
            # The surest of one view teach the other.
            for rows, label in ((left[order[len(order) - n_good :]], 1.0), (left[order[:n_bad]], 0.0)):
                extra[1 - v][0].extend(rows.tolist())
                extra[1 - v][1].extend([label] * len(rows))
                free[rows] = False
        weights = [_train(np.vstack([views[v], pools[v][extra[v][0]]]), np.concatenate([y, extra[v][1]])) for v in (0, 1)]
    return weights


def combined(x: np.ndarray, m: np.ndarray, y: np.ndarray, weights: list[np.ndarray], good: float) -> Scorer:
    """The scorer of two views' weights, calibrated on the labelled rows that were kept apart."""
    z = np.stack([margins(rows, w)[:, 0] for rows, w in zip((x, m), weights)], axis=1)
    platt = np.stack([logistic(z[:, v : v + 1], y, l2=1e-3, rounds=300)[:, 0] for v in (0, 1)])
    calibrated = np.stack([z[:, v] * platt[v, 0] + platt[v, 1] for v in (0, 1)], axis=1)
    mixed = logistic(calibrated, y, l2=1e-3, rounds=300)
    final = sigmoid(margins(calibrated, mixed)[:, 0])
    threshold = min(0.5, float(np.quantile(final[y > 0], 1 - KEPT)))
    return Scorer(weights[0], weights[1], platt, mixed, good, threshold)


_VIEWS = "label double, x binary, m binary"


WIDTHS = (STATISTICS + WORD_BINS, SOURCE_BINS + LANG_BINS + LENGTH_BINS)


def _viewed(rows: DataFrame) -> DataFrame:
    """Labels and both views of rows (label, text, source, lang, length)."""

    def view(batch: pa.RecordBatch) -> pa.RecordBatch:
        label, text, source, lang, length = (c.to_pylist() for c in batch.columns)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(label, pa.float64()),
                pa.array([text_view(t).tobytes() for t in text], pa.binary()),
                pa.array([meta_view(*a).tobytes() for a in zip(source, lang, length)], pa.binary()),
            ],
            names=["label", "x", "m"],
        )

    return map_rows(rows, _VIEWS, view)


def _matrices(rows: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(-1, WIDTHS[k]) for k in (0, 1)]


def _views(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels and both views of rows, in a fixed order."""
    found = sorted((r["label"], bytes(r["x"]), bytes(r["m"])) for r in _viewed(rows).collect())
    # Equal labels would stand together in the order of their features: mix them by content.
    found.sort(key=lambda r: zlib.crc32(r[1] + r[2]))
    return np.array([r[0] for r in found]), *_matrices([r[1:] for r in found])


def _pooled(rows: DataFrame, tasks: list[tuple], pool: int) -> list[list[np.ndarray]]:
    """For each task (labelled views, labels, first weights) the mean of all pools' weights."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(tasks)
    count = max(1, -(-rows.count() // pool))
    # The label's place holds the pool.  Few pools would fall on one task by their hashes: ranges deal them evenly.
    number = F.pmod(F.xxhash64("key", "text", "source", "lang"), F.lit(count)).cast("double")
    viewed = _viewed(rows.select(number.alias("label"), "text", "source", "lang", "length"))
    dealt = viewed.repartitionByRange(min(count, 4 * partitions(spark)), "label").sortWithinPartitions("label")

    def learn(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        pools = _matrices(sorted(found))
        flat = [w.ravel() for views, y, first in held.value for w in cotrain(views, y, pools, first)]
        sums = np.rint(np.concatenate(flat).astype(np.float64) * (len(found) / UNIT)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = None, []
        for batch in batches:
            for number, x, m in zip(*(c.to_pylist() for c in batch.columns)):
                # Very many equal rows have one number: they are cut into pools of the same size.
                if found and (number != own or len(found) >= 2 * pool):
                    yield learn(found)
                    found = []
                own = number
                found.append((x, m))
        if found:
            yield learn(found)

    learned = dealt.mapInArrow(run, "n long, sums array<long>")
    # One row of each weight comes back, whatever the number of pools; the first is the number of documents.
    parts = learned.select(F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    total = {r["at"]: int(r["value"]) for r in parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not total:
        return [first for _, _, first in tasks]
    mean = np.array([total[i] for i in range(1, len(total))], dtype=np.float64) * UNIT / total[0]
    out, at = [], 0
    for _, _, first in tasks:
        out.append([])
        for w in first:
            out[-1].append(mean[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
    return out


def _narrow(docs: DataFrame, key: str) -> DataFrame:
    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")

    return docs.select(
        F.col(key).alias("key"), F.col("text"), column("source").alias("source"), column("lang").alias("lang"), F.length("text").cast("long").alias("length")
    )


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], *, key: str = "doc_id", labelled: int = LABELLED, pool: int = POOL) -> list[Scorer]:
    """A scorer of each target column (1 or 0) of ``labels``."""
    rows = _narrow(docs, key)
    packed = sum((F.col(t).cast("long") * (1 << i) for i, t in enumerate(targets)), F.lit(0))
    known = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), packed.cast("double").alias("label")).where("label IS NOT NULL")
    picked = known.orderBy(F.xxhash64("_key"), "label").limit(labelled)
    columns = ["text", "source", "lang", "length"]
    # At most as long as its limit: of the documents of one key, that with the least hash of its text counts.
    matched = rows.join(F.broadcast(picked), F.col("key") == F.col("_key"))
    one = matched.groupBy("_key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *columns)).alias("row"))
    packs, x, m = _views(one.select("label", *(f"row.{c}" for c in columns)))
    labels_of = [(packs.astype(np.int64) >> i & 1).astype(float) for i in range(len(targets))]
    tasks = []
    for y in labels_of:
        if _known(y):
            views, own = [rows_of[~_apart(y)] for rows_of in (x, m)], y[~_apart(y)]
            tasks.append((views, own, [_train(v, own) for v in views]))
    weights = iter(_pooled(rows, tasks, pool) if tasks else [])
    found = []
    for y in labels_of:
        if _known(y):
            found.append(combined(x[_apart(y)], m[_apart(y)], y[_apart(y)], next(weights), float(y.mean())))
        else:
            found.append(Scorer(None, None, None, None, float(y.mean()) if len(y) else 0.5, 0.0))
    return found


def score(docs: DataFrame, scorers: list[Scorer], *, key: str = "doc_id") -> DataFrame:
    """(key, scores): for each scorer the text view's, the metadata view's and the combined score."""
    held = docs.sparkSession.sparkContext.broadcast(scorers)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, text, source, lang, length = batch.columns
        x = np.stack([text_view(t) for t in text.to_pylist()])
        m = np.stack([meta_view(*a) for a in zip(source.to_pylist(), lang.to_pylist(), length.to_pylist())])
        # (rows, scorers, 3)
        found = np.stack([np.stack(s.scores(x, m), axis=1) for s in held.value], axis=1).astype(np.float64)
        return pa.RecordBatch.from_arrays([keys, pa.array(found.tolist(), pa.list_(pa.list_(pa.float64())))], names=[key, "scores"])

    return map_rows(_narrow(docs, key).select(F.col("key").alias(key), "text", "source", "lang", "length"), schema, run)
