"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes
log-count ratios.

Characters are Unicode's, A-Z folded, any ASCII white space one blank. A feature is an n-gram of 4 to 6
characters, hashed into a table; its value is the log-count ratio r of its presence in toxic against clean
texts, as in naive Bayes, and a logistic regression learns one weight for each. Features whose
ratio is not significantly different from 0 are left out. A text's score is the logistic function of the intercept plus
the sum of weight times r over the distinct features that occur in it.

Null and empty texts get the intercept's score. Texts of any length are scored whole. Scores depend on
nothing but the text. Without labelled rows of both kinds the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_arrow, release, row_blocks, text_bytes
from .sampling import remainder, sigmoid, training_rows

BITS = 22
SIZES = (4, 5, 6)
PER_CLASS = 1500
THRESHOLD = 0.3
#: Bytes of text whose n-grams are in a worker's memory at once.
BLOCK = 1 << 19
FOLDS, HELD_OUT = 4, 2
#: Least ratio in units of its standard error.
MIN_Z = 3.0

_FOLDED = np.arange(128, dtype=np.uint32)
_FOLDED[65:91] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32


def _folded(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    ascii = out < 128
    out[ascii] = _FOLDED[out[ascii]]
    return out


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block of UTF-8 and their offsets by row; what isn't UTF-8 is U+FFFD."""
    raw = data.tobytes()
    try:
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        return _folded(codes), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    except UnicodeDecodeError:
        rows = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:])]
        return _folded(np.concatenate(rows)), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def grams(codes: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of one size after the other, and whether each lies within one text."""
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(codes))
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        if n <= len(codes):
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        else:
            h = h[:0]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield ((mixed ^ (mixed >> np.uint32(13)) ^ np.uint32(n * 0x3779)) >> np.uint32(32 - BITS)).astype(np.int32), left[: len(h)] >= n


@dataclass
class Model:
    buckets: np.ndarray  # of the features, sorted
    weights: np.ndarray  # weight * r of each
    intercept: float

    def among(self) -> np.ndarray:
        """Which buckets are features."""
        out = np.zeros(1 << BITS, dtype=bool)
        out[self.buckets] = True
        return out


def present(data: np.ndarray, offs: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a block's n-grams for which ``among`` is true."""
    data, offs = characters(data, offs)
    keys = [np.zeros(0, np.int64)]
    for h, inside in grams(data, offs):
        at = np.flatnonzero(among[h] & inside)
        row = np.searchsorted(offs, at, "right") - 1
        keys.append((row.astype(np.int64) << BITS) | h[at])
    found = np.unique(np.concatenate(keys))
    return found >> BITS, found & ((1 << BITS) - 1)


def train(texts: pa.Array, labels: np.ndarray, counts: dict[int, int], rounds: int = 150, l2: float = 1e-3) -> Model:
    n = [int((labels == v).sum()) for v in (0, 1)]
    if not all(n):
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    blocks = [(k, *text_bytes(texts.slice(k, 200))) for k in range(0, len(texts), 200)]
    every = np.ones(1 << BITS, dtype=bool)
    df = np.zeros((2, 1 << BITS), dtype=np.int32)
    for k, data, offs in blocks:
        row, h = present(data, offs, every)
        for v in (0, 1):
            df[v] += np.bincount(h[labels[k + row] == v], minlength=1 << BITS).astype(np.int32)
    clean, bad = (x + np.float32(0.5) for x in df.astype(np.float32))
    ratio = np.log(bad / (n[1] + 1)) - np.log(clean / (n[0] + 1))
    chosen = np.abs(ratio) >= MIN_Z * np.sqrt(1 / bad + 1 / clean)
    del df, clean, bad
    rows, cols = [], []
    for k, data, offs in blocks:
        row, h = present(data, offs, chosen)
        rows.append(row + k)
        cols.append(h)
    row, col = np.concatenate(rows), np.concatenate(cols)
    ids, col = np.unique(col, return_inverse=True)
    r = ratio[ids]
    y, x = labels.astype(float), r[col]
    w, b = np.zeros(len(ids)), 0.0
    g2, b2 = np.full(len(ids), 1e-8), 1e-8
    for _ in range(rounds):  # full-batch gradient with Adagrad steps
        p = sigmoid(np.bincount(row, w[col] * x, len(y)) + b)
        e = (p - y) / len(y)
        g = np.bincount(col, e[row] * x, len(ids)) + l2 * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= 0.1 * g / np.sqrt(g2)
        b -= 0.1 * e.sum() / np.sqrt(b2)
    prior = np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(n[1] / n[0])
    return Model(ids.astype(np.int64), w * r, float(b + prior))


def score_block(data: np.ndarray, offs: np.ndarray, model: Model, among: np.ndarray) -> np.ndarray:
    row, h = present(data, offs, among)
    return sigmoid(np.bincount(row, model.weights[np.searchsorted(model.buckets, h)], len(offs) - 1) + model.intercept)


def add_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each text."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        among = model.among()
        for batch in batches:
            for block in row_blocks(batch, text, BLOCK):
                score = score_block(*text_bytes(block.column(text)), model, among)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(score)], names=[*keep, out])

    return in_arrow(df, run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows, counts = training_rows(docs, labels, "toxic", per_class, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = train(rows.column("text").combine_chunks(), rows.column("label").to_numpy(), counts)
    release()
    return model


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = add_score(docs.select("doc_id", "text"), fit(docs, labels, per_class))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay."""
    name = "_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return add_score(docs, fit(docs, labels, per_class), out=name).where(F.col(name) < THRESHOLD).drop(name)
