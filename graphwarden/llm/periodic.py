"""Periodic runs of words, found by online dyadic square catching.

Whenever a block of h = 1, 2, 4, ... words of a text is complete, a catcher is set up that holds the block's
words. Each word appended after it advances the catcher by one: the suffix of h words that ends there is
compared with the block; if both are equal, the block repeats at the distance q (h <= q < 2h), and so a square
of period q is being written there. A catcher ends after h such words, when blocks of twice its size take over.
Squares grow to both sides as far as words q apart are equal; those that grow to the same stretch are merged
into one run. A run of at least four periods holds a block of h words with its copy q words later, so no run
is missed. Suffixes are compared by prefix hashes, in numpy: one step advances the catchers of all blocks of
one size, of all texts of a batch. What is found is compared word by word before it is returned, so hashes
decide nothing.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period q and at least max(6, 4 q) words
that no neighbouring word extends keeping that period. Null and empty texts, and texts of white space, have
no words and no runs; rows with equal texts get equal runs; texts of any length are handled whole, in memory
in proportion to one text (at least ``blocks.BLOCK_BYTES``). All columns, of whatever name, pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import U64, in_arrow, mix, powers, row_blocks

LEAST, PERIODS = 6, 4
#: Comparisons made at once: catchers are advanced in slices of so many words.
SLICE = 1 << 20


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a block of texts and their offsets by row."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, offs = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[offs - offs[0]]


class Suffixes:
    """Prefix hashes of word numbers: any two suffixes can be compared at any length."""

    def __init__(self, ids: np.ndarray):
        up, self.down = powers(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, dtype=U64)
        np.cumsum(mix(ids.astype(U64) + U64(1)) * up[: len(ids)], out=self.total[1:])

    def windows(self, h: int) -> np.ndarray:
        """Hashes of the h words from each word on."""
        n = len(self.total) - h
        return (self.total[h:] - self.total[:n]) * self.down[:n]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.total[a + n] - self.total[a]) * self.down[a] == (self.total[b + n] - self.total[b]) * self.down[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, ``most`` at most, are equal from a and b on (or before them)."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def caught(hashes: np.ndarray, h: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Catchers over all completed blocks of h words of texts (their first words, and those behind their last):
    text, block and distance of every suffix that equals its block."""
    texts = np.flatnonzero(end - begin >= PERIODS * h)
    count = (end - begin)[texts] // h
    text = np.repeat(texts, count)
    block = begin[text] + h * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    found = []
    for at in range(0, len(block), max(1, SLICE // h)):
        one, row = block[at : at + max(1, SLICE // h)], text[at : at + max(1, SLICE // h)]
        for step in range(0, h, SLICE):
            ahead = np.arange(h + step, min(2 * h, h + step + SLICE))
            place = one[:, None] + ahead
            inside = place + h <= end[row][:, None]
            k, t = np.nonzero((hashes[np.minimum(place, len(hashes) - 1)] == hashes[one][:, None]) & inside)
            found.append((row[k], one[k], ahead[t]))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))


def _exact(ids: np.ndarray, text: int, start: int, end: int, q: int) -> list[tuple[int, int, int, int]]:
    """A stretch that hashes took for one of period q, compared word by word: itself, or what is left of it if
    hashes collided, where it is long enough."""
    same = ids[start : end - q] == ids[start + q : end]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))).tolist()
    pairs = zip(edges[::2], edges[1::2])
    return [(text, start + a, start + b + q, q) for a, b in pairs if b + q - a >= max(LEAST, PERIODS * q)]


def find(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Runs of texts, given as numbers of words and their offsets by text: rows (text, start, length, period),
    starts counted from the text's first word, sorted by text, start and period."""
    begin, end = offs[:-1], offs[1:]
    runs = np.zeros((0, 4), np.int64)  # text, start, end, period; places in ids
    longest = int((end - begin).max(initial=0))
    if longest < LEAST:
        return runs
    suffixes, h = Suffixes(ids), 1
    while PERIODS * h <= longest:
        text, block, q = caught(suffixes.windows(h), h, begin, end)
        if len(runs) and len(block):  # squares within a run of a period that divides theirs add nothing
            order = np.lexsort((runs[:, 2], runs[:, 1]))
            starts, best = runs[order, 1], np.maximum.accumulate(runs[order, 2] * len(order) + np.arange(len(order)))
            near = np.searchsorted(starts, block, "right") - 1
            over = runs[order[best[near] % len(order)]]
            known = (near >= 0) & (over[:, 2] >= block + q + h) & (q % over[:, 3] == 0)
            text, block, q = text[~known], block[~known], q[~known]
        if len(block):
            order = np.lexsort((block, q))
            text, block, q = text[order], block[order], q[order]
            first = np.ones(len(block), bool)  # neighbouring blocks of the same square
            first[1:] = (q[1:] != q[:-1]) | (block[1:] != block[:-1] + h)
            text, block, q = text[first], block[first], q[first]
            left = suffixes.common(block, block + q, block - begin[text], back=True)
            right = suffixes.common(block + h, block + h + q, end[text] - (block + h + q), back=False)
            grown = np.unique(np.stack([text, block - left, block + h + q + right, q], axis=1), axis=0)
            size = grown[:, 2] - grown[:, 1]
            grown = grown[size >= np.maximum(LEAST, PERIODS * grown[:, 3])]
            exact = [x for g in grown.tolist() for x in _exact(ids, *g)]
            if exact:  # of equal stretches the one of the smallest period stays: its period divides the others
                runs = np.concatenate([runs, np.array(exact, np.int64)])
                runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
                again = np.zeros(len(runs), bool)
                again[1:] = (runs[1:, 1:3] == runs[:-1, 1:3]).all(axis=1)
                runs = runs[~again]
        h *= 2
    out = np.stack([runs[:, 0], runs[:, 1] - begin[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept(n: int, offs: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those after the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    start = offs[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change)[:n] == 0


def joined(flat: pa.Array, offs: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])
    lists = pa.ListArray.from_arrays(pa.array(before[offs], pa.int32()), flat.filter(pa.array(keep)))
    return pc.binary_join(lists, " ")


def numbered(flat: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words."""
    if len(flat) == 0:
        return np.zeros(0, np.int64)
    return flat.dictionary_encode().indices.to_numpy().astype(np.int64)


RUNS = T.ArrayType(T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")]), False)


def _over(docs: DataFrame, text: str, added: list[T.StructField], dropped: tuple[str, ...], values) -> DataFrame:
    """``docs`` without the columns ``dropped``, with those that ``values`` gives for a block of texts."""
    names = [c for c in docs.columns if c not in dropped and c not in {f.name for f in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, text):
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), *values(block)], names=[*names, *(f.name for f in added)])

    return in_arrow(docs, run, T.StructType([*(docs.schema[c] for c in names), *added]))


def with_runs(docs: DataFrame, text: str = "text", out: str = "runs") -> DataFrame:
    """``docs`` with the runs of each text: an array of (start, length, period), counted in words."""

    def values(block: pa.RecordBatch) -> list[pa.Array]:
        flat, offs = words(block.column(text))
        runs = find(numbered(flat), offs)
        fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=[pa.field(k, pa.int64(), False) for k in ("start", "length", "period")])
        at = np.searchsorted(runs[:, 0], np.arange(block.num_rows + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), fields, type=pa.list_(pa.field("element", fields.type, False)))]

    return _over(docs, text, [T.StructField(out, RUNS, False)], (), values)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one period left of each run. A text without runs stays as it is, white space included; one
    with runs becomes its kept words joined by one space."""
    order = docs.columns

    def values(block: pa.RecordBatch) -> list[pa.Array]:
        flat, offs = words(block.column(text))
        runs = find(numbered(flat), offs)
        changed = np.isin(np.arange(block.num_rows), runs[:, 0])
        return [pc.if_else(pa.array(changed), joined(flat, offs, kept(len(flat), offs, runs)), block.column(text))]

    out = _over(docs, text, [T.StructField(text, T.StringType())], (), values)
    return out.select(*(f"`{c.replace('`', '``')}`" for c in order))


def repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of a document's n words stands at each place once a tenth of all documents, chosen by crc32 of the id,
    repeats from some word on; None where nothing changes. A missing id counts as empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def report(docs: DataFrame) -> DataFrame:
    """Per document, after ``repeated``: doc_id, n_runs, start, length, period and exponent_milli of the run with
    the greatest length in periods (the first of these, then the one of the least period; null without runs),
    digests of all runs and of the words that collapsing keeps."""
    named = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [T.StructField(k, T.LongType()) for k in named] + [T.StructField(k, T.StringType()) for k in ("runs_sha256", "collapsed_sha256")]

    def values(block: pa.RecordBatch) -> list[pa.Array]:
        flat, offs = words(block.column("text"))
        place = np.arange(len(flat))
        for k, doc in enumerate(block.column("doc_id").to_pylist()):
            at = repeated(doc, int(offs[k + 1] - offs[k]))
            if at is not None:
                place[offs[k] : offs[k + 1]] = offs[k] + at
        flat = flat.take(pa.array(place))
        runs = find(numbered(flat), offs)
        by_row = np.searchsorted(runs[:, 0], np.arange(block.num_rows + 1))
        rows = []
        for text, a, b in zip(joined(flat, offs, kept(len(flat), offs, runs)), by_row[:-1], by_row[1:]):
            own = runs[a:b, 1:].tolist()
            best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else None
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            rows.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.as_buffer()).hexdigest()))
        return [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(7)]

    return _over(docs.select("doc_id", "text"), "text", fields, ("text",), values)
