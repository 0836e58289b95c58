"""Media columns of progressive JPEG files.

``encode`` stores a payload losslessly: 192 bytes make one unit of three blocks, and a byte b is the
quantised coefficient b + 2, so that no coefficient that carries data is ever zero. ``decode`` reads the
files' scans into coefficient arrays, takes the payload from them, inverse-transforms them in numpy,
brings chroma to full resolution and yields the RGB tensor (or a feature of it).

A null or empty text is a payload of 192 blanks. Texts of any length work (a picture gets wider where
one column of blocks would be too high). Equal texts have equal results; ids don't matter and extra
columns are passed through. Damaged files raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .blocks import in_arrow, quoted, row_blocks, text_bytes

UNIT = 192
BLOCK = 512 << 10


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts filled up with blanks to a positive multiple of a unit."""
    size = np.diff(offs)
    units = np.maximum(1, -(-size // UNIT))
    bounds = np.concatenate([[0], np.cumsum(units * UNIT)])
    out = np.full(int(bounds[-1]), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(bounds[:-1] - offs[:-1], size)] = data
    return out, bounds


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with each text's file (binary) in its place and its size in bytes without padding (n_bytes); all other
    columns pass through."""
    keep = [c for c in df.columns if c not in (text, media, "n_bytes")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, text, BLOCK):
                data, offs = text_bytes(block.column(text))
                payload, bounds = padded(data, offs)
                files = jpeg.write(payload.astype(np.int32).reshape(-1, 3, 64) + 2, np.diff(bounds) // UNIT)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(np.diff(offs)), pa.array(files, pa.binary())], names=[*keep, "n_bytes", media])

    return in_arrow(df.select(*quoted([*keep, text])), run, schema)


def decode(df: DataFrame, media: str = "media", tensors: bool = False) -> DataFrame:
    """``df`` with width, height, payload (binary), feature (size and mean of each channel) and, if asked
    for, rgb: the height x width x 3 tensor's bytes."""
    extra = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]
    extra += [T.StructField("rgb", T.BinaryType())] * tensors
    keep = [c for c in df.columns if c not in {f.name for f in extra}]
    schema = T.StructType([df.schema[c] for c in keep] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, media, 2 * BLOCK):
                coefficients, pictures = jpeg.read(*text_bytes(block.column(media)))
                payloads = [payload(p, coefficients) for p in pictures]
                rgb = pixels(pictures, coefficients)
                columns = [
                    pa.array([p.width for p in pictures], pa.int32()), pa.array([p.height for p in pictures], pa.int32()),
                    pa.array(payloads, pa.binary()), pa.array([feature(x) for x in rgb]),
                ]
                if tensors:
                    columns.append(pa.array([x.tobytes() for x in rgb], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *columns], names=[f.name for f in schema])

    return in_arrow(df, run, schema)


def payload(p: jpeg.Picture, coefficients: np.ndarray) -> bytes:
    """The bytes that a picture's coefficients carry, unit by unit."""
    parts = list(p.parts.values())
    n = p.units[0] * p.units[1]
    x = np.stack([coefficients[c.base : c.base + n] for c in parts], axis=1).reshape(-1)
    x = x[x != 0]
    if x.size % UNIT or x.min(initial=2) < 2 or x.max(initial=2) > 257:
        raise ValueError("the picture carries no payload")
    return (x - 2).astype(np.uint8).tobytes()


def pixels(pictures: list[jpeg.Picture], coefficients: np.ndarray) -> list[np.ndarray]:
    """RGB tensors. Pictures of one column of units without subsampling are transformed together."""
    plain = [all((c.h, c.v) == (1, 1) for c in p.parts.values()) and len(p.parts) == 3 and p.units[0] == 1 and (p.quant[c.quant] == 1).all() and p.width == 8 and p.height % 8 == 0 for p in pictures for c in [next(iter(p.parts.values()))]]
    if not all(plain) or not pictures:
        return [jpeg.tensor(p, coefficients) for p in pictures]
    s = jpeg.samples(coefficients, np.ones(64, np.int32))
    order = [np.concatenate([np.arange(x.base, x.base + p.units[1]) for p in pictures for x in [list(p.parts.values())[c]]]) for c in range(3)]
    rgb = jpeg.rgb([s[o].reshape(-1, 8) for o in order])
    bounds = np.concatenate([[0], np.cumsum([p.height for p in pictures])])
    return [rgb[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def feature(rgb: np.ndarray) -> str:
    """Width, height and the channels' means, rounded down."""
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) // (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]},{mean[1]},{mean[2]}"


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes and digests of what was read back, the RGB tensor included."""
    read = decode(encode(docs.select("doc_id", "text")), tensors=True)
    tail = F.substring("payload", -16, 16)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"),
    )
