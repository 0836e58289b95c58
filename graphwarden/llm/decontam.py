"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised word sequences of all test items. A document's words are streamed
through it while the length of the longest match that ends at each word is tracked; a window (ten
consecutive words of an item, or the whole of a shorter item) ends wherever that length reaches the
window's. Words that can't be part of a window are skipped beforehand: a window's neighbouring words
are neighbours in some item too, so only runs of known neighbours are streamed.

Benchmarks are dealt into shards of about ``SHARD_BYTES`` of whole items, whose automata are built by the
executors and written; each is read and broadcast for a pass of its own over the documents. Of several shards,
each pass is written before the next one begins: the driver, an executor and a Python worker hold one automaton
at a time. Passes are narrow: no text is shuffled, and the work grows with documents times shards. An item
longer than a shard is a shard of its own size.

A null or empty text has no words. An item without words has no window; items that share an id count
once, an item without an id is named "null". Repeated documents, null ids and extra columns don't
matter: rows are independent. A column named like a result is replaced by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, Words, in_arrow, mix, quoted, row_blocks, text_bytes
from .storage import discard, materialize

WINDOW = 10
SHARD_BYTES = 1 << 20
_BITS = 20


class SuffixAutomaton:
    """Generalised suffix automaton over words given as 64-bit hashes, with the items of each state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, words in items:
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.short[at].append((len(words), name))
        self.found: dict[int, tuple[int, frozenset[str], list[tuple[int, str]]]] = {}

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(-1 if copy is None else self.link[copy])
        self.len.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's words and w: its target, cut off from longer words if it has any."""
        q = self.next[p][w]
        if self.len[q] == self.len[p] + 1:
            return q
        part = self._state(self.len[p] + 1, q)
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def ends(self, state: int) -> tuple[int, frozenset[str], list[tuple[int, str]]]:
        """What can end in a state: the least length that contains a full window (0: none), the items
        with that window, and shorter whole items with their lengths."""
        known = self.found.get(state)
        if known is None:
            at, short = state, []
            while at > 0:
                short += self.short[at]
                at = self.link[at]
            at = state
            while at > 0 and self.len[self.link[at]] >= self.window:
                at = self.link[at]
            whole = at > 0 and self.len[at] >= self.window
            known = self.found[state] = (self.window if whole else 0, frozenset(self.items[at]) if whole else frozenset(), short)
        return known

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges covered by windows, and the items whose windows occur."""
        ranges: list[tuple[int, int]] = []
        names: set[str] = set()
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w not in self.next[state]:
                continue
            state, length = self.next[state][w], length + 1
            window, items, short = self.ends(state)
            if window and length >= window:
                ranges.append((i + 1 - window, i + 1))
                names |= items
            for n, name in short:
                if n <= length:
                    ranges.append((i + 1 - n, i + 1))
                    names.add(name)
        return ranges, names


class _Set:
    """Membership of 64-bit hashes: a bitmap first, then the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(U64))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.values & U64((1 << _BITS) - 1)).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.bits[(x & U64((1 << _BITS) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
            out[at] = self.values[place] == x[at]
        return out


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])


class Index:
    """A shard of the benchmark, ready to be broadcast."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, offs = text_bytes(pa.array([t for _, t in items], pa.string()))
        w = Words(data, offs)
        rows = [w.hash[a:b] for a, b in zip(w.rows[:-1], w.rows[1:])]
        self.automaton = SuffixAutomaton([(name, [int(x) for x in row]) for (name, _), row in zip(items, rows)], window)
        sizes = [min(len(r), window) for r in rows if len(r)]
        self.least = min(sizes, default=0)
        self.words = _Set(w.hash)
        self.neighbours = _Set(np.concatenate([_pairs(r) for r in rows if len(r) > 1] or [np.zeros(0, U64)]))

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a block lie in a window, and the items by row."""
        n = len(w.hash)
        hit, items = np.zeros(n, dtype=bool), {}
        if not self.least or not n:
            return hit, items
        if self.least == 1:
            member = self.words.has(w.hash)
            starts, stops = _runs(member, w.rows)
        else:
            joined = np.zeros(n, dtype=bool)
            joined[:-1] = self.neighbours.has(_pairs(w.hash))
            joined[w.rows[1:][w.rows[1:] > 0] - 1] = False  # a row's last word has no neighbour
            starts, stops = _runs(joined, w.rows)
            keep = stops - starts >= self.least - 1
            starts, stops = starts[keep], stops[keep] + 1
        for a, b in zip(starts.tolist(), stops.tolist()):
            ranges, names = self.automaton.scan(w.hash[a:b].tolist())
            if names:
                items.setdefault(int(np.searchsorted(w.rows, a, "right")) - 1, set()).update(names)
                for x, y in ranges:
                    hit[a + x : a + y] = True
        return hit, items


def _runs(member: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], member.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):  # cut at rows' borders
        inner = np.unique(rows[1:-1])
        inner = inner[(inner > 0) & (inner < len(member))]
        inner = inner[member[inner - 1] & member[inner]] if len(inner) else inner
        starts, stops = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([stops, inner]))
    return starts, stops


class Shards:
    """The shards' automata, built by the executors and written; iterating broadcasts (pickled) one after the other,
    one of no items if there is none."""

    def __init__(self, bench: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES):
        self.context, self.window = bench.sparkSession.sparkContext, window
        items = bench.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-total // shard_bytes))

        def build(t: pa.Table) -> pa.Table:
            found = sorted(zip(t.column("name").to_pylist(), t.column("text").to_pylist()))
            return pa.table({"shard": t.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(Index(found, window))], pa.binary())})

        dealt = items.withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
        self.built = materialize(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")
        self.numbers = [r["shard"] for r in self.built.select("shard").orderBy("shard").collect()]

    def __len__(self) -> int:
        return max(1, len(self.numbers))

    def __iter__(self) -> Iterator[Broadcast]:
        for k in self.numbers:
            yield self.context.broadcast(bytes(self.built.where(F.col("shard") == k).first()["automaton"]))
        if not self.numbers:
            yield self.context.broadcast(pickle.dumps(Index([], self.window)))


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words in a window), items (ids of items with windows in the text,
    unordered) and hits (byte ranges of the maximal runs of hit words)."""
    parts = Shards(bench, window, shard_bytes)
    out = _contamination(docs, parts)
    discard(parts.built)
    return out


def _contamination(docs: DataFrame, parts: Shards) -> DataFrame:
    """One pass for each shard. Of several, each pass is written before the next begins, so that a task has one
    Python worker with one automaton, and the broadcast of the one before is gone."""
    own = ("n_words", "n_hit", "items", "hits")
    out = docs.drop(*own).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(_HITS).alias("hits"))
    keep = [c for c in out.columns if c not in own]
    for shared in parts:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for batch in batches:
                for block in row_blocks(batch, "text"):
                    yield _scan(block, keep, index)

        before, out = out, in_arrow(out, run, out.schema)
        if len(parts) > 1:
            out = materialize(out, "marked")
            shared.destroy()
            if hasattr(before, "_written_at"):
                discard(before)
    return out


def _scan(block: pa.RecordBatch, keep: list[str], index: Index) -> pa.RecordBatch:
    w = Words(*text_bytes(block.column("text")))
    hit, items = index.hits(w)
    before = block.column("n_hit").to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(before):  # what earlier shards found
        a, b = w.rows[row], w.rows[row + 1]
        base = w.offs[row]
        for span in block.column("hits")[int(row)].as_py():
            hit[a:b] |= (w.starts[a:b] - base >= span["start"]) & (w.ends[a:b] - base <= span["end"])
    names = [sorted(set(old or ()) | items.get(i, set())) for i, old in enumerate(block.column("items").to_pylist())] if items or before.any() else [[]] * block.num_rows
    starts, stops = _runs(hit, w.rows)
    rows = np.searchsorted(w.rows, starts, "right") - 1
    base = w.offs[rows]
    lists = np.searchsorted(rows, np.arange(block.num_rows + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(w.starts[starts] - base, pa.int64()), pa.array(w.ends[stops - 1] - base if len(stops) else np.zeros(0, np.int64), pa.int64())], ["start", "end"])
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.rows])
    return pa.RecordBatch.from_arrays(
        [*(block.column(c) for c in keep), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(lists), pairs)],
        names=[*keep, "n_words", "n_hit", "items", "hits"],
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the runs of hit words, however long; documents with more than ``max_coverage``
    of their words hit are removed. Cutting a run out can bring the halves of another window together,
    so changed texts are scanned again until nothing is hit. Other columns stay; ``n_chars`` follows."""
    columns = docs.columns
    parts = Shards(bench, window, shard_bytes)
    if len(parts) > 1:
        return _in_rounds(docs, parts, max_coverage)
    shared = next(iter(parts))
    discard(parts.built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(shared.value)
        for batch in batches:
            for block in row_blocks(batch, "text"):
                yield clean(block, index)

    def clean(block: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        w = Words(*text_bytes(block.column("text")))
        hit = index.hits(w)[0]
        if not hit.any():
            return block
        texts = block.column("text").to_pylist()
        counts = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.rows])
        keep = np.ones(block.num_rows, dtype=bool)
        for row in np.flatnonzero(counts):
            a, b = w.rows[row], w.rows[row + 1]
            if counts[row] > max_coverage * (b - a):
                keep[row] = False
                continue
            raw = texts[row].encode()
            spans = _spans(w, hit, a, b, w.offs[row])
            while spans:
                raw = _without(raw, spans)
                again = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                spans = _spans(again, index.hits(again)[0], 0, len(again.hash), 0)
            texts[row] = raw.decode()
        arrays = {c: block.column(c) for c in columns}
        arrays["text"] = pa.array(texts, pa.string())
        if "n_chars" in arrays:
            old = arrays["n_chars"]
            arrays["n_chars"] = pa.array([len(t) if n else o for t, n, o in zip(texts, counts, old.to_pylist())], old.type)
        return pa.RecordBatch.from_arrays(list(arrays.values()), names=columns).filter(pa.array(keep))

    return in_arrow(docs, run, docs.schema)


def _in_rounds(docs: DataFrame, parts: Shards, max_coverage: float) -> DataFrame:
    """The same over several shards: all shards mark the texts before any is cut, and only cut texts go into the
    next round."""
    columns = docs.columns
    # whatever their names are, the columns travel as one
    rows = docs.select(F.struct(*quoted(columns)).alias("row"), "text")
    marked = _contamination(rows, parts)
    out = [marked.where("n_hit = 0").select("row", "text", F.lit(False).alias("cut"))]
    todo = marked.where((F.col("n_hit") > 0) & (F.col("n_hit") <= max_coverage * F.col("n_words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, "text"):
                hits = block.column("hits").to_pylist()
                texts = [_without(t.encode(), [(h["start"], h["end"]) for h in spans]).decode() for t, spans in zip(block.column("text").to_pylist(), hits)]
                yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    while not todo.isEmpty():
        cut = in_arrow(todo.select("row", "text", "hits"), run, T.StructType([marked.schema["row"], marked.schema["text"]]))
        again = _contamination(cut, parts)
        out.append(again.where("n_hit = 0").select("row", "text", F.lit(True).alias("cut")))
        todo = again.where("n_hit > 0")
    discard(parts.built)
    every = reduce(DataFrame.unionAll, out)
    value = {c: F.col("row").getField(c) for c in columns}
    value["text"] = F.col("text")
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(value["n_chars"])
    return every.select(*(x.alias(c) for c, x in value.items()))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)]))


def _spans(w: Words, hit: np.ndarray, a: int, b: int, base: int) -> list[tuple[int, int]]:
    starts, stops = _runs(hit[a:b], np.array([0, b - a]))
    return [(int(w.starts[a + x] - base), int(w.ends[a + y - 1] - base)) for x, y in zip(starts, stops)]


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
