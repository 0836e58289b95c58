"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-Proximal) updates, scored as sparse dot products.

Tokens are runs of bytes without white space. Besides its own hash a token has a shape (the sequence of
byte classes, runs collapsed), and a token equal to its left neighbour is replaced by one mark, so that
n-grams generalise beyond words seen in training. Features are token uni- and bigrams and shape uni-,
bi- and trigrams, hashed into one table; a feature's value is its share of the text's tokens. Only the
text is used.

Null and empty texts have no features and get the intercept's score; texts of any length are scored
whole. Scores depend on nothing but the text, so repeated rows agree. Without labelled rows the score
is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, in_arrow, mix, powers, row_blocks, row_sum, spans, text_bytes
from .sampling import remainder, sigmoid, training_rows

BUCKETS = 1 << 20
PER_CLASS = 3000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_MARK = U64(0x5EED)


def features(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and row offsets of each kind of feature of a block of texts."""
    starts, ends = spans(~_SPACE[data], offs)
    n, rows = len(starts), np.searchsorted(starts, offs)
    up, down = powers(len(data) + 2)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    token = mix((total[ends] - total[starts]) * down[starts])
    kind = _CLASS[data]
    change = np.ones(len(data), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    step = np.cumsum(change)
    np.cumsum(np.where(change, (kind.astype(U64) + U64(1)) * up[step], U64(0)), out=total[1:])
    shape = mix((total[ends] - total[starts]) * down[step[starts]] + U64(7)) if n else token
    same = np.zeros(n, dtype=bool)
    same[1:] = token[1:] == token[:-1]
    same[rows[:-1][rows[:-1] < n]] = False
    token = np.where(same, _MARK, token)
    shape = np.where(same, _MARK, shape)
    first = np.zeros(n + 2, dtype=bool)  # tokens with no left neighbour; two ahead for trigrams
    first[rows[:-1]] = True
    first = first[:n]
    second = np.zeros(n, dtype=bool)
    second[1:] = first[:-1]

    def gram(parts: list[np.ndarray], salt: int) -> np.ndarray:
        h = np.full(len(parts[0]), U64(salt))
        for p in parts:
            h = mix(h * U64(0x9E3779B97F4A7C15) + p)
        return (h >> U64(44)).astype(np.int64)

    def per_row(keep: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(keep)])[rows]

    two, three = ~first, ~(first | second)
    at2, at3 = np.flatnonzero(two), np.flatnonzero(three)
    return [
        (gram([token], 1), rows),
        (gram([token[at2 - 1], token[at2]], 2), per_row(two)),
        (gram([shape], 3), rows),
        (gram([shape[at2 - 1], shape[at2]], 4), per_row(two)),
        (gram([shape[at3 - 2], shape[at3 - 1], shape[at3]], 5), per_row(three)),
    ]


def ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights after FTRL-Proximal updates over the samples (feature numbers and values) in turn; the
    last weight is the intercept's."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            i, x = samples[k]
            w = weights(i)
            g = (sigmoid(w @ x) - labels[k]) * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    return weights(np.arange(BUCKETS + 1)).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Fit the weights; the intercept is moved from the sample's share of labels to that of all rows."""
    samples = []
    for text in texts:
        data, offs = text_bytes(pa.array([text.as_py()], pa.string()))
        kinds = features(data, offs)
        size = max(1, len(kinds[0][0]))
        i, c = np.unique(np.concatenate([f for f, _ in kinds]), return_counts=True)
        samples.append((np.append(i, BUCKETS), np.append(4 * c / size, 1.0)))
    w = ftrl(samples, labels)
    here = [max(1, int((labels == v).sum())) for v in (0, 1)]
    w[-1] += np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(here[1] / here[0])
    return w


def score_block(data: np.ndarray, offs: np.ndarray, w: np.ndarray) -> np.ndarray:
    total = np.zeros(len(offs) - 1)
    size = None
    for f, rows in features(data, offs):
        size = np.diff(rows) if size is None else size
        total += row_sum(w[f].astype(np.float64), rows)
    return sigmoid(4 * total / np.maximum(1, size) + w[-1])


def add_score(df: DataFrame, w: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each text."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(w)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, text):
                score = score_block(*text_bytes(block.column(text)), shared.value)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(score)], names=[*keep, out])

    return in_arrow(df, run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    rows, counts = training_rows(docs, labels, "quality", per_class, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    if not rows.num_rows:
        return np.zeros(BUCKETS + 1, np.float32)
    return train(rows.column("text"), rows.column("label").to_numpy(), counts)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = add_score(docs.select("doc_id", "text"), fit(docs, labels, per_class))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
