"""Bounded, reproducible samples of labelled documents for training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts beyond this many bytes are learnt from only if a label has no others.
MAX_BYTES = 32 << 10
#: Bytes of such texts, for each label; one text is learnt from whatever its size is.
LONG_BYTES = 16 << 20


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column, max_bytes: int = MAX_BYTES, long_bytes: int = LONG_BYTES
) -> tuple[pa.Table, dict[int, int]]:
    """Texts and labels of at most ``per_class`` documents of each label among the rows to learn from, and how
    many rows each label has in all.

    Chosen are those with the smallest id hashes among the documents of at most ``max_bytes``. A label that has
    none of these is learnt from its shortest texts, of ``long_bytes`` together, or from one. Rows without a
    label or an id, and labelled ids without a document, are left out; of an id's contradictory labels the
    largest counts, of its texts the shortest, then the least."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    length = F.octet_length(F.coalesce("text", F.lit("")))
    sized = marked.join(docs.groupBy("doc_id").agg(F.min(length).alias("size")), "doc_id")
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    ids = []  # at most 2 * per_class
    for value in (0, 1):
        own = sized.where(F.col("label") == value)
        some = own.where(F.col("size") <= max_bytes).orderBy(*order).limit(per_class).collect()
        if not some:
            left = long_bytes
            for r in own.orderBy("size", *order).limit(per_class).collect():
                if some and r["size"] > left:
                    break
                some.append(r)
                left -= r["size"]
        ids += some
    # a proven bound for the broadcast, and with the bounds of bytes for what the driver reads
    chosen = docs.sparkSession.createDataFrame(ids, sized.schema)
    rows = docs.select("doc_id", "text", length.alias("size")).join(F.broadcast(chosen), ["doc_id", "size"])
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return one.orderBy(*order).select("doc_id", "text", "label").toArrow(), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
