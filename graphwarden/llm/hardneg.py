"""Hard negatives for contrastive training, read from Hilbert-ordered blocks with zone maps.

Rows that take part are sorted by label and by their place on a Hilbert curve through the components' ranges,
and packed into blocks of ``BLOCK`` rows in Parquet. Columns beside a block's vectors hold its zone map: the
least and greatest value of each dimension, and of the label. An anchor asks for windows of scores (integer inner
products): its positives are the best ones of its label, and each positive opens a window of the scores from
80 % of its own up to it among all other labels. Interval arithmetic over the zone map bounds the scores that a
block can hold for an anchor; only blocks that can reach a window are read. Three tables are met in tiles
(a range of blocks, a range of windows), each of bounded size, so neither the anchors nor the blocks are ever
broadcast or held by one task, and a hot label or vector is many blocks: equal places on the curve are dealt out
by the id's hash.

Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors of different
length are compared as if zeros followed the shorter one. Values beyond ``clip`` (floor(sqrt(2**62 / dimensions)),
over a million for 64 dimensions unscaled) count as that, which keeps all scores within 64 bits. Ties go to the
smaller id. Rows that share an id take part each; none of them is a positive of another. Columns other than
vec_id, label and embedding are ignored. An empty table, and one without anchors, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_arrow, text_bytes
from .storage import discard, materialize

BLOCK = 256
#: Rows in a range of blocks; windows in a range of windows; bits of a component on the curve.
RANGE, WINDOWS, BITS = 1 << 17, 1 << 16, 4
SCALE, TOP, FLIP, EVERY = 256, 5, 7, 100
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label (moved on by one where the id is divisible by ``FLIP``) and embedding of the rows that count."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    cut = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    cut = cut.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
    return cut.select("vec_id", F.when(F.col("vec_id") % FLIP == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "x")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Scaled and floored components, zeros behind shorter vectors; float64 holds them all."""
    flat, offs = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offs = offs - offs[0]
    size = np.diff(offs)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1], size)] = np.floor(SCALE * flat)
    return out


def ranges(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, and the least and greatest scaled value of each dimension: as many rows as
    dimensions reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(0), np.zeros(0)
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                dims = max(len(low), int(np.diff(b.column("x").offsets.to_numpy()).max()))
                x = _matrix(b.column("x"), dims)
                low = np.minimum(np.pad(low, (0, dims - len(low))), x.min(axis=0))
                high = np.maximum(np.pad(high, (0, dims - len(high))), x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(low))], pa.int32()), pa.array([float(n), *low]), pa.array([0.0, *high])], names=["dim", "low", "high"])

    each = in_arrow(rows, run, "dim int, low double, high double")
    found = sorted(each.groupBy("dim").agg(F.sum("low").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    n = sum(int(r.n) for r in found if r.dim < 0)
    return n, np.array([r.low for r in found if r.dim >= 0] or [0.0]), np.array([r.high for r in found if r.dim >= 0] or [0.0])


def hilbert(x: np.ndarray, bits: int) -> list[bytes]:
    """Places of points (rows of integers below 2**bits) on the Hilbert curve, as byte strings of that order:
    Skilling's transform (2004), of all points at once."""
    x = x.astype(np.uint32).T.copy()
    dims = len(x)
    for k in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << k), np.uint32((1 << k) - 1)
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << k)) != 0, np.uint32((1 << k) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(k)) & np.uint32(1) for k in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices: in doubles where no sum can pass 2**53."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _stacked(column, kind) -> np.ndarray:
    """A column of binaries of one length as rows of numbers."""
    data, offs = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind).reshape(len(offs) - 1, -1)


class Best:
    """The best ``TOP`` rows found so far for each window, by score, then id."""

    def __init__(self, n: int):
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, LOW, np.int64)  # what a further row must reach

    def add(self, window: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if len(window) == 0:
            return
        w, s, i = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, id)))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        first = np.searchsorted(w, w)
        rank = np.arange(len(w)) - first
        keep = rank < TOP
        self.window, self.score, self.id = w[keep], s[keep], i[keep]
        full = rank == TOP - 1
        self.least[w[full]] = s[full]


def packed(rows: DataFrame, n: int, low: np.ndarray, high: np.ndarray, parts: int) -> DataFrame:
    """The Hilbert-ordered blocks: part, block, labels' least and greatest, per-dimension zone map, ids, labels,
    vectors; and of the rows that are anchors their places and the ``TOP``-th best score of their label within
    the block (a lower bound of what a positive must reach)."""
    dims = len(low)
    clip = math.isqrt((1 << 62) // dims)
    low, high = np.maximum(low, -clip), np.minimum(high, clip)
    span = np.maximum(high - low, 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.clip(_matrix(b.column("x"), dims), -clip, clip)
            cell = np.minimum(((x - low) / span * (1 << BITS)), (1 << BITS) - 1)
            place = hilbert(np.maximum(cell, 0), BITS)
            vector = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(place, pa.binary()), vector], names=["vec_id", "label", "place", "vector"])

    keyed = in_arrow(rows, placed, "vec_id long, label long, place binary, vector binary")
    order = ["label", "place", F.xxhash64("vec_id")]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(part: int, k: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> list:
        at = np.flatnonzero(ids % EVERY == 0)
        scores = product(x[at], x)
        scores[(labels[at][:, None] != labels) | (ids[at][:, None] == ids)] = LOW
        seed = np.partition(scores, -TOP, axis=1)[:, -TOP] if len(ids) >= TOP else np.full(len(at), LOW)
        zone = [x.min(axis=0).astype(np.int32), x.max(axis=0).astype(np.int32)]
        return [part, part << 32 | k, int(labels.min()), int(labels.max()), *(z.tobytes() for z in zone), ids.tobytes(), labels.tobytes(), x.astype(np.int32).tobytes(), at.astype(np.int64).tobytes(), seed.astype(np.int64).tobytes(), len(at)]

    names = ["part", "block", "label_low", "label_high", "low", "high", "ids", "labels", "vectors", "anchors", "seeds", "n_anchors"]
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 7, pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, None

        def ready(held, last: bool):
            nonlocal k
            out, at, (ids, labels, x) = [], 0, held
            while len(ids) - at >= (1 if last else 2 * BLOCK):
                to = min(at + BLOCK, len(ids))
                turn = np.flatnonzero(labels[at + BLOCK // 4 : to] != labels[at + BLOCK // 4 - 1 : to - 1])
                if len(turn):  # blocks of one label, but for labels of few rows
                    to = at + BLOCK // 4 + int(turn[0])
                out.append(block(part, k, ids[at:to], labels[at:to], x[at:to]))
                k, at = k + 1, to
            table = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)
            return table, tuple(v[at:] for v in held)

        for b in batches:
            if b.num_rows:
                new = (b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _stacked(b.column("vector"), np.int32))
                held = new if held is None else tuple(np.concatenate(v) for v in zip(held, new))
                table, held = ready(held, last=False)
                yield table
        if held is not None:
            yield ready(held, last=True)[0]

    schema = "part int, block long, label_low long, label_high long, low binary, high binary, ids binary, labels binary, vectors binary, anchors binary, seeds binary, n_anchors int"
    return in_arrow(ranged, cut, schema)


ANCHORS = "part int, wid long, anchor_id long, label long, vector binary, positive_id long, positive_score long, least long, most long"


def first_windows(blocks: DataFrame) -> DataFrame:
    """A window for each anchor: any score that can belong to one of its positives. ``wid`` is the anchor's place
    (block and row) times 8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at, ids = np.frombuffer(r["anchors"], np.int64), np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["vectors"], np.int32).reshape(len(ids), -1)[at]
                wid, none = ((r["block"] >> 32) * (1 << 20) + (r["block"] & 0xFFFFFFFF)) * BLOCK * 8 + at * 8, pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), r["part"], np.int32)), pa.array(wid), pa.array(ids[at]), pa.array(np.frombuffer(r["labels"], np.int64)[at]), pa.array([v.tobytes() for v in x], pa.binary()), none, none, pa.array(np.frombuffer(r["seeds"], np.int64)), pa.array(np.full(len(at), HIGH))],
                    names=["part", "wid", "anchor_id", "label", "vector", "positive_id", "positive_score", "least", "most"],
                )

    some = blocks.where("n_anchors > 0").select("part", "block", "ids", "labels", "vectors", "anchors", "seeds")
    return in_arrow(some, run, ANCHORS)


def reach(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each row of x with any vector of a zone, by interval arithmetic."""
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def _fits(windows: dict, s: slice | np.ndarray, zones: dict, own: bool) -> np.ndarray:
    """Which windows (rows) can hold scores of which blocks (columns)."""
    below, above = reach(windows["vector"][s], zones["low"], zones["high"])
    label = windows["label"][s][:, None]
    if own:
        other = (zones["label_low"] <= label) & (label <= zones["label_high"])
    else:
        other = (zones["label_low"] != label) | (zones["label_high"] != label)
    return other & (above >= windows["least"][s][:, None]) & (below <= windows["most"][s][:, None])


def _windows(table: pa.Table) -> dict:
    return {k: table[k].to_numpy() for k in ("wid", "anchor_id", "label", "least", "most")} | {"vector": _stacked(table["vector"], np.int32)}


def _zones(table: pa.Table) -> dict:
    return {k: table[k].to_numpy() for k in ("block", "label_low", "label_high")} | {k: _stacked(table[k], np.int32) for k in ("low", "high")}


STEP = 1024  # windows at a time


def search(blocks: DataFrame, windows: DataFrame, own: bool, parts: int, width: int) -> DataFrame:
    """The first ``TOP`` rows (score, then id) of each window (own: of the anchor's label, the anchor apart;
    otherwise of other labels) with wid, anchor_id, positive_id, positive_score, id, score and rank."""
    chunks, wide = -(-parts // width), 64
    chunk = F.floor(F.col("part") / width).cast("int")
    windows = windows.withColumn("chunk", chunk)

    def needed(zone_rows: pa.Table, window_rows: pa.Table) -> pa.Table:
        if len(zone_rows) == 0 or len(window_rows) == 0:
            return pa.table({"chunk": pa.array([], pa.int32()), "block": pa.array([], pa.int64())})
        zones, asked = _zones(zone_rows), _windows(window_rows)
        use = np.zeros(len(zone_rows), bool)
        for j in range(0, len(use), 4096):
            some = {k: v[j : j + 4096] for k, v in zones.items()}
            for i in range(0, len(window_rows), STEP):
                use[j : j + 4096] |= _fits(asked, slice(i, i + STEP), some, own).any(axis=0)
        return pa.table({"chunk": pa.array(np.full(int(use.sum()), window_rows["chunk"][0].as_py(), np.int32)), "block": zones["block"][use]})

    zones = blocks.select(F.floor(F.col("part") / wide).cast("int").alias("zone"), "block", "label_low", "label_high", "low", "high")
    zones = zones.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = windows.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit((parts - 1) // wide)))).select("zone", "chunk", "wid", "anchor_id", "label", "vector", "least", "most")
    need = zones.groupBy("zone", "chunk").cogroup(asked.groupBy("zone", "chunk")).applyInArrow(needed, "chunk int, block long")
    need = materialize(need, "zones-met")

    def best(block_rows: pa.Table, window_rows: pa.Table) -> pa.Table:
        found = []
        if len(block_rows) and len(window_rows):
            zones, asked = _zones(block_rows), _windows(window_rows)
            ids, labels = ([np.frombuffer(v, np.int64) for v in block_rows[k].to_pylist()] for k in ("ids", "labels"))
            vectors = [np.frombuffer(v, np.int32).reshape(len(i), -1) for v, i in zip(block_rows["vectors"].to_pylist(), ids)]
            for i in range(0, len(window_rows), STEP):
                some = {k: v[i : i + STEP] for k, v in asked.items()}
                fits, top = _fits(some, slice(None), zones, own), Best(len(some["wid"]))
                above = reach(some["vector"], zones["low"], zones["high"])[1]
                for j in np.argsort(-above.max(axis=0), kind="stable"):  # blocks of high scores first: windows fill early
                    w = np.flatnonzero(fits[:, j] & (above[:, j] >= top.least))
                    score = product(some["vector"][w], vectors[j])
                    same = labels[j] == some["label"][w][:, None]
                    inside = (same & (ids[j] != some["anchor_id"][w][:, None])) if own else ~same
                    inside &= (score >= np.maximum(some["least"][w], top.least[w])[:, None]) & (score <= some["most"][w][:, None])
                    row, col = np.nonzero(inside)
                    top.add(w[row], score[row, col], ids[j][col])
                found.append((i + top.window, top.id, top.score))
        at, id, score = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        kept = window_rows.select(["wid", "anchor_id", "positive_id", "positive_score"]).take(pa.array(at))
        return kept.append_column("id", pa.array(id)).append_column("score", pa.array(score))

    read = blocks.join(need, "block").select("part", "chunk", "block", "label_low", "label_high", "low", "high", "ids", "labels", "vectors")
    tiles = blocks.select("part", "block").join(need, "block").select(F.col("part").alias("tile"), "chunk").distinct()
    sent = windows.join(tiles, "chunk").select("tile", "chunk", "wid", "anchor_id", "positive_id", "positive_score", "label", "vector", "least", "most")
    schema = "wid long, anchor_id long, positive_id long, positive_score long, id long, score long"
    each = read.groupBy("part", "chunk").cogroup(sent.groupBy("tile", "chunk")).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("wid").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= TOP)


def mine(rows: DataFrame) -> DataFrame:
    """Per anchor (rows whose id is divisible by ``EVERY``), each of its first ``TOP`` positives, and each of the
    first ``TOP`` rows of other labels with 80 * positive_score <= 100 * negative_score <= 100 * positive_score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark: SparkSession = rows.sparkSession
    schema = T.StructType.fromDDL("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    valid = taking_part(rows)
    n, low, high = ranges(valid)
    if n == 0:
        return spark.createDataFrame([], schema)
    parts = max(-(-n // RANGE), min(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = materialize(packed(valid, n, low, high, parts), "hilbert-blocks")
    most, last = blocks.groupBy("part").agg(F.sum("n_anchors").alias("n")).agg(F.max("n"), F.max("part")).first()
    if not most:
        return spark.createDataFrame([], schema)
    parts = last + 1  # as many as were really made
    width = max(1, min(64, WINDOWS // most))
    anchors = materialize(first_windows(blocks), "anchors")
    found = search(blocks, anchors, True, parts, width)
    positives = materialize(found.select("wid", F.col("rank").alias("slot"), F.col("id").alias("pid"), F.col("score").alias("ps")), "positives")
    # scores below 0 have no window: 80 % of them is more than they are; 4 ps / 5 is rounded up
    opened = anchors.join(positives.where("ps >= 0"), "wid").select(
        "part", (F.col("wid") + F.col("slot")).alias("wid"), "anchor_id", "label", "vector", F.col("pid").alias("positive_id"), F.col("ps").alias("positive_score"),
        F.expr("ps - ps div 5").alias("least"), F.col("ps").alias("most"),
    )
    opened = materialize(opened, "windows")
    discard(anchors)
    discard(positives)
    out = search(blocks, opened, False, parts, max(1, width // TOP))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
