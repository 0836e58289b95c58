"""Vectorised text primitives: an Arrow string column is one byte array with offsets, and words,
hashes and shingles are computed for a whole block of documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words after folding: digits, a-z and everything beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash multiplier and of its inverse, modulo 2**64."""
    if _powers.get("n", np.zeros(1))[0] < n:
        n = max(n, BLOCK_BYTES + (1 << 16))
        for key, base in (("up", _MULT), ("down", _INV)):
            out = np.full(n, base, dtype=U64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
        _powers["n"] = np.array([n])
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever signs are in it."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` for columns of any name and with bounded memory: batches of at most ``BATCH_BYTES``
    (for this, the session's setting is lowered where it is higher; the README says so), and a worker gives
    what it freed back to the system when its task ends, since it stays for other tasks."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        conf.set(key, f"{BATCH_BYTES}b")

    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    names, out = df.columns, [x.name for x in fields]
    places = [f"c{k}" for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in f(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays([block.column(x) for x in out], names=places)
        release()

    typed = T.StructType([T.StructField(p, x.dataType, x.nullable) for p, x in zip(places, fields)])
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, typed).toDF(*out)


class Seen:
    """What a task has met lately: of equal values that come near each other only the first is new. It forgets
    everything whenever it holds ``most`` values, so it is a saving, never a guarantee."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.values = most, set()

    def new(self, values: Iterable) -> list[bool]:
        out = []
        for v in values:
            out.append(v not in self.values)
            if len(self.values) >= self.most:
                self.values.clear()
            self.values.add(v)
        return out


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, never across the border of two rows."""
    if len(member) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    border = offs[:-1][offs[:-1] < len(member)]
    first[border] = member[border]
    last = member.copy()
    last[:-1] &= ~member[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = member[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a block after folding A-Z: byte spans in the
    block, a 64-bit hash each, and the words' offsets by row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        folded = FOLD[data]
        self.starts, self.ends = spans(IS_WORD[folded], offs)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((folded.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.rows = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


_COMBINE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row and their offsets; a row of fewer words, but not
    none, is one shingle."""
    n, counts = len(hashes), np.diff(rows)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    left = np.minimum(k, np.repeat(rows[1:], counts) - np.arange(n))
    total = np.zeros(n, dtype=U64)
    for j in range(k):
        part = padded[j : j + n] * _COMBINE[j]
        total += part if j == 0 else np.where(left > j, part, U64(0))
    row_of = np.repeat(np.arange(len(counts)), counts)
    keep = (left == k) | ((counts[row_of] < k) & (np.arange(n) == rows[:-1][row_of]))
    return mix(total[keep] + left[keep].astype(U64)), out_rows


def row_min(values: np.ndarray, rows: np.ndarray, empty) -> np.ndarray:
    """The least value of each row; ``empty`` for rows without values."""
    out = np.full(len(rows) - 1, empty, dtype=values.dtype)
    full = rows[1:] > rows[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, rows[:-1][full])
    return out


def row_sum(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[rows[1:]] - total[rows[:-1]]


def digests(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """Pairs of 64-bit hashes as 16-byte binaries."""
    raw = np.empty((len(hi), 2), dtype=">u8")
    raw[:, 0], raw[:, 1] = hi, lo
    offs = np.arange(len(hi) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(hi), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw.tobytes())])


def minhash(values: np.ndarray, rows: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values of each row's set of 64-bit hashes: rows x n, unsigned 32-bit."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)
    x = (values >> U64(32)).astype(np.uint32)
    out = np.empty((len(rows) - 1, n), dtype=np.uint32)
    full = rows[1:] > rows[:-1]
    at = rows[:-1][full]
    out[~full] = np.uint32(0xFFFFFFFF)
    tmp = np.empty_like(x)
    for i in range(n):
        np.multiply(x, a[i], out=tmp)
        tmp += b[i]
        if len(at):
            out[full, i] = np.minimum.reduceat(tmp, at)
    return out
