"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits.  One binary classifier per bit, a logistic regression on
hashed byte n-grams of the whole text, predicts that bit of the text's codeword.  Decoding compares
the predictions with every codeword: the losses of the bits are added with weights that say how far
a bit was right for that language's training texts, and the language of least loss wins.  The relative
distance to the second best is the score; below ``AMBIGUOUS`` a text is flagged.

The classifiers are fitted on a bounded sample of labelled rows, the ``PER_LABEL`` rows of each label
with the smallest key hashes, so that the sample does not depend on partitioning.  The sample's
n-gram counts, not its texts, come to the driver.

A null text and one without any letter are ``und`` with score 0.  Null labels are not learned, nor are those beyond the
``MAX_LABELS`` most frequent (of equally frequent ones the first by name).  With no labelled rows, as in an empty table,
every text is ``und``; with one label every text with letters has that label.  Of equally near codewords the first label's wins.
Repeated rows count once in the sample and get equal results.  Very long texts are counted in pieces.  Extra columns are carried on; those named
like the added ones (``lang_pred``, ``score``, ``ambiguous``) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows
from .linear import logistic, margins

#: Labelled rows of each label that the classifiers are fitted on, at most.
PER_LABEL = 300
#: Labels that are learned, at most: the most frequent.  Together with PER_LABEL the bound of the sample.
MAX_LABELS = 200
#: Hash bins of the n-grams.
BINS = 1 << 12
#: Lengths of the byte n-grams.
GRAMS = (1, 2, 3, 4)
#: Scores below this are ambiguous.
AMBIGUOUS = 0.02
UNDETERMINED = "und"

_PIECE = 1 << 20
_ODD = np.uint32(2654435761)
#: A-Z to a-z, other ASCII that is no letter to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def profile(text: str | None) -> np.ndarray | None:
    """The square roots of the shares of each n-gram bin in a text; None if it has no letter."""
    import regex

    if not text or not regex.search(r"\p{L}", text):
        return None
    raw = np.frombuffer(b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" ", np.uint8)
    counts = np.zeros(BINS, np.int64)
    shift = np.uint32(32 - BINS.bit_length() + 1)
    for at in range(0, len(raw), _PIECE):
        part = raw[at : at + _PIECE + max(GRAMS) - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            end = min(len(part) - n + 1, _PIECE)
            if end <= 0:
                break
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(n)
            if n in GRAMS:
                counts += np.bincount((code[:end] * _ODD) >> shift, minlength=BINS)
    return np.sqrt(counts / counts.sum(), dtype=np.float64).astype(np.float32)


def codewords(labels: int, seed: int = 0) -> np.ndarray:
    """A (labels, bits) matrix of +1/-1: all two-way splits of up to five labels, else the one of many
    random codes whose nearest codewords lie furthest apart."""
    if labels <= 1:
        return np.ones((labels, 1), np.float32)
    if labels <= 5:
        splits = np.arange(1, 1 << (labels - 1))
        return np.where((splits[None, :] >> np.arange(labels)[:, None]) & 1, -1, 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(labels)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (labels, bits))
        apart = bits - np.abs(code @ code.T) * 1.0
        np.fill_diagonal(apart, bits)
        mixed = np.abs(code.sum(axis=0)).max() < labels
        if mixed and apart.min() > distance:
            best, distance = code, apart.min()
    return best


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each row of profiles and its score."""
        if len(self.labels) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        bits = margins(x, self.weights)
        loss = np.stack(
            [(self.trust[c] * np.log1p(np.exp(-np.clip(self.code[c] * bits, -30, 30)))).sum(axis=1) for c in range(len(self.labels))],
            axis=1,
        )
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(axis=1), (two[:, 1] - two[:, 0]) / np.maximum(two.sum(axis=1), 1e-12)


def fit(
    labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL
) -> Model | None:
    """Fit on the rows of ``labelled`` with text and label."""
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")
    )
    frequent = usable.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).select("label")
    order = Window.partitionBy("label").orderBy("order", "key", "h")
    # Rows that repeat key, label and text are one; at most per_label rows of each of MAX_LABELS labels are chosen.
    chosen = (
        usable.select("key", "label", "h")
        .join(F.broadcast(frequent), "label")
        .distinct()
        .withColumn("order", F.xxhash64("key"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_label)
        .select("key", "label", "h")
    )
    sample = usable.join(F.broadcast(chosen), ["key", "label", "h"]).dropDuplicates(["key", "label", "h"]).select("text", "label")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(label, p.tobytes()) for t, label in zip(*(c.to_pylist() for c in batch.columns)) if (p := profile(t)) is not None]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["label", "counts"]
        )

    rows = sorted((r["label"], bytes(r["counts"])) for r in map_rows(sample, "label string, counts binary", count).collect())
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    code = codewords(len(labels))
    if len(labels) == 1:
        return Model(labels, code, np.zeros((BINS + 1, 1), np.float32), np.ones_like(code))
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows])
    at = np.array([labels.index(r[0]) for r in rows])
    share = (1 / np.bincount(at))[at]
    weights = logistic(x * 10, (code[at] > 0).astype(np.float32), share)
    weights[:-1] *= 10
    right = code[at] * margins(x, weights) > 0
    trust = np.stack([right[at == c].mean(axis=0) for c in range(len(labels))]) + 1e-3
    return Model(labels, code, weights, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(df: DataFrame, model: Model | None, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and ambiguous."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    names = ("lang_pred", "score", "ambiguous")
    kept = [i for i, c in enumerate(df.columns) if (keep_text or i != at) and c.lower() not in names]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *added])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        if own is not None:
            profiles = [profile(t) for t in batch.column(at).to_pylist()]
            lettered = [i for i, p in enumerate(profiles) if p is not None]
            if lettered:
                best, score = own.decode(np.stack([profiles[i] for i in lettered]))
                scores[lettered] = np.clip(score, 0, 1)
                for i, b in zip(lettered, best):
                    langs[i] = own.labels[b]
        unsure = [lang != UNDETERMINED and s < AMBIGUOUS for lang, s in zip(langs, scores)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
            names=[*(batch.schema.names[i] for i in kept), *names],
        )

    return map_rows(df, schema, run)
