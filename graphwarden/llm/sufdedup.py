"""Exact removal of repeated passages with bucket-pointer refinement.

A ``Rule`` names the unit (bytes, or words between ASCII white space) and how many units make a repeat:
every unit covered by a string of ``span`` units that also starts anywhere else, in any text, is removed.

1. *Anchors* make the problem local: of the q-grams in a window of span units the one with the least hash
   (the leftmost of equal ones) is the window's anchor. Equal windows have equal anchors at the same
   offset, so each window belongs to one q-gram bucket, and only windows of a bucket can be equal.
   Neighbouring windows with one anchor form a *context*: the units that they span.
2. Equal contexts are counted by a cryptographic digest (BLAKE2b; pre-aggregated, so copies cost one row
   for each task). All windows of a context that occurs twice are repeats.
3. Where a bucket holds several different contexts, one text of each is fetched. A bucket with more
   contexts than one task should hold (``HOT``) is first refined over the cluster: its windows are
   halved by their anchors' offsets, and each half is dealt anew by the units that all its windows share
   besides the anchor. A half of one offset holds equal windows only, so this ends.
4. Bucket-pointer refinement sorts the positions of each bucket's contexts: q-gram buckets are refined by
   sorting on the bucket pointers of later offsets; each refinement writes its pointers and depths back
   at once, and the refinements after it, of the same pass too, look up what was written. Neighbours in
   the order are compared unit by unit.

Words are told apart by 64-bit hashes; the white space between them doesn't matter. Null and empty texts
have no units; texts shorter than a span keep all. Results depend on the texts alone: repeated rows and
null ids are ordinary copies, and extra columns don't matter. Texts of any length work; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, Seen, in_arrow, mix, powers, quoted, row_blocks, spans, text_bytes
from .storage import discard, materialize


@dataclass(frozen=True)
class Rule:
    """Repeats of ``span`` units, found by q-grams of ``gram`` units; ``words`` instead of bytes."""

    span: int
    gram: int
    words: bool = False

    @property
    def offsets(self) -> int:
        """How many offsets an anchor can have in a window."""
        return self.span - self.gram + 1

    @property
    def least_bytes(self) -> int:
        return 2 * self.span - 1 if self.words else self.span


#: Repeats of 400 bytes, and passages of over 50 words.
BYTES, PASSAGES = Rule(400, 64), Rule(51, 8, True)
HOT = 256
BLOCK = 1 << 19
REFINE_BYTES = 1 << 19
SLICES = 4

_rng = np.random.default_rng(400)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _sums(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    terms = _TABLE[values] if values.dtype == np.uint8 else values
    np.cumsum(terms * powers(len(values) + 1)[0][: len(values)], out=total[1:])
    return total


def units(data: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's units (bytes, or word hashes), their offsets by row, and where each begins and ends."""
    if not rule.words:
        at = np.arange(len(data) + 1)
        return data, offs, at[:-1], at[1:]
    starts, ends = spans(_SOLID[data], offs)
    total = _sums(data)
    return mix((total[ends] - total[starts]) * powers(len(data) + 1)[1][starts]), np.searchsorted(starts, offs), starts, ends


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U64).max, dtype=U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(values: np.ndarray, offs: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """A block's contexts: row, first and last window start, anchor (offsets in the row), the anchor's
    hash, and where the context begins in the block."""
    span, gram = rule.span, rule.gram
    empty = {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "at", "begin")} | {"h": np.zeros(0, U64)}
    if len(values) < span:
        return empty
    total = _sums(values)
    grams = mix((total[gram:] - total[:-gram]) * powers(len(values) + 1)[1][: len(values) - gram + 1])
    bits = U64(32)  # of the hash as many decide, whatever the block's length is; then the leftmost place
    keys = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U64)
    anchor = (_least(keys, rule.offsets) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    start = np.arange(len(anchor))
    valid = start + span <= offs[1:][row]
    start, anchor, row = start[valid], anchor[valid], row[valid]
    if not len(start):
        return empty
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at, row = start[first], start[last], anchor[first], row[first]
    base = offs[row]
    return {"row": row, "lo": lo - base, "hi": hi - base, "at": at - base, "h": grams[at], "begin": lo}


def _binary(raw: bytes, size: int) -> pa.Array:
    n = len(raw) // size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(raw)])


_ANCHOR = pa.schema([("kind", pa.int32()), ("r", pa.int32()), ("dig", pa.binary()), ("h", pa.int64()), ("ctx", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])


def _anchor_block(block: pa.RecordBatch, r: int, rule: Rule) -> pa.RecordBatch:
    """Kind 0: the different contexts of each text and how often they occur in it. Kind 1: windows known
    to be repeats because their context occurs twice in the text or the text twice in the task."""
    values, offs, _, _ = units(*text_bytes(block.column("text")), rule)
    c = contexts(values, offs, rule)
    item, raw, salt = values.dtype.itemsize, memoryview(np.ascontiguousarray(values)).cast("B"), bytes([r])
    sums = b"".join(
        blake2b(raw[a:b], digest_size=16, salt=salt).digest()
        for a, b in zip((c["begin"] * item).tolist(), ((c["begin"] + c["hi"] - c["lo"] + rule.span) * item).tolist())
    )
    d = np.frombuffer(sums, U64).reshape(-1, 2)
    by = np.lexsort((c["lo"], d[:, 1], d[:, 0], c["row"]))
    c, d = {k: v[by] for k, v in c.items()}, d[by]
    n = len(by)
    new = np.ones(n, dtype=bool)
    new[1:] = (c["row"][1:] != c["row"][:-1]) | (d[1:] != d[:-1]).any(1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    again = np.flatnonzero(np.repeat(count > 1, count))
    again = again[np.lexsort((c["lo"][again], c["row"][again]))]
    row, lo, hi = (c[k][again] for k in ("row", "lo", "hi"))
    start = np.ones(len(again), dtype=bool)  # windows that follow each other are one range
    start[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(again))[: len(begin)] - 1
    dig = block.column("dig")
    k0, k1 = len(first), len(begin)
    h = mix(c["h"][first] + U64(r)).view(np.int64)
    parts = [
        [np.zeros(k0), np.full(k0, r), dig.take(pa.array(c["row"][first])), h, _binary(d[first].tobytes(), 16), c["lo"][first], c["hi"][first], c["at"][first], count],
        [np.ones(k1), np.full(k1, r), dig.take(pa.array(row[begin])), np.zeros(k1), pa.nulls(k1, pa.binary()), lo[begin], hi[end], np.zeros(k1), np.ones(k1)],
    ]
    arrays = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x).astype(f.type.to_pandas_dtype())) for x in pair]) for f, pair in zip(_ANCHOR, zip(*parts))]
    return pa.RecordBatch.from_arrays(arrays, schema=_ANCHOR)


def _whole(block: pa.RecordBatch, r: int, rule: Rule) -> pa.RecordBatch:
    """Rows of kind 1: all windows of each text."""
    count = np.diff(units(*text_bytes(block.column("text")), rule)[1])
    at = np.flatnonzero(count >= rule.span)
    n = len(at)
    columns = [np.ones(n), np.full(n, r), block.column("dig").take(pa.array(at)), np.zeros(n), pa.nulls(n, pa.binary()), np.zeros(n), count[at] - rule.span, np.zeros(n), np.ones(n)]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(f.type.to_pandas_dtype())) for f, x in zip(_ANCHOR, columns)], schema=_ANCHOR)


def _packed(df: DataFrame, keep: list[str], once: bool = False) -> DataFrame:
    """The kept columns and each text compressed (column z); ``once``: equal texts near each other in a task only once."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        seen = Seen()
        for batch in batches:
            for block in row_blocks(batch, "text"):
                if once:
                    block = block.filter(pa.array(seen.new(block.column("dig").to_pylist())))
                z = pa.array([pack.compress((x or "").encode()) for x in block.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), z], names=[*keep, "z"])

    return in_arrow(df.select(*quoted({c: None for c in [*keep, "dig", "text"]})), run, schema)


_CONTEXT = "r int, h long, nc long, n long, dig binary, lo int, hi int, at int, first int, last int, ctx binary, body binary"
_CONTEXT_TYPES = {
    "r": pa.int32(), "h": pa.int64(), "nc": pa.int64(), "n": pa.int64(), "dig": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "at": pa.int32(), "first": pa.int32(), "last": pa.int32(),
    "ctx": pa.binary(), "body": pa.binary(),
}


def _contexts_out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _CONTEXT_TYPES.values())], names=list(_CONTEXT_TYPES))


def _fetch(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen contexts with their bytes (column body); first and last are the anchor offsets of the bucket."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for dig, z, wanted in zip(batch.column("dig").to_pylist(), batch.column("z").to_pylist(), batch.column("wanted").to_pylist()):
            raw = unpack.decompress(z) if z else b""
            data = np.frombuffer(raw, np.uint8)
            held = {}
            for w in wanted:
                r = w["r"]
                if r not in held:
                    held[r] = units(data, np.array([0, len(data)]), rules[r])[2:]
                body = raw[held[r][0][w["lo"]] : held[r][1][w["hi"] + rules[r].span - 1]]
                out.append((r, w["h"], w["nc"], w["n"], dig, w["lo"], w["hi"], w["at"], 0, rules[r].offsets - 1, None, body))
                size += len(body)
            if size > BLOCK:
                yield _contexts_out(out)
                out, size = [], 0
        if out:
            yield _contexts_out(out)


def _halves(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of large buckets, their windows halved by anchor offset; each half belongs to the bucket of the
    units that all windows of such offsets share."""
    for batch in batches:
        out: list[tuple] = []
        for c in batch.to_pylist():
            rule, raw = rules[c["r"]], c["body"]
            values, _, starts, ends = units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), rule)
            middle = (c["first"] + c["last"]) // 2
            for first, last in ((c["first"], middle), (middle + 1, c["last"])):
                lo, hi = max(c["lo"], c["at"] - last), min(c["hi"], c["at"] - first)
                if first > last or lo > hi:
                    continue
                begin, end = lo - c["lo"], hi + rule.span - c["lo"]
                body, own = raw[starts[begin] : ends[end - 1]], values[begin:end].tobytes()
                shared = values[c["at"] - first - c["lo"] : c["at"] + rule.span - last - c["lo"]].tobytes()
                key = blake2b(shared, digest_size=8, key=f"{c['r']} {first} {last} {c['h']}".encode()).digest()
                ctx = blake2b(own, digest_size=16).digest()
                out.append((c["r"], int.from_bytes(key, "little", signed=True), 0, c["n"], c["dig"], lo, hi, c["at"], first, last, ctx, body))
        if out:
            yield _contexts_out(out)


def equal_windows(values: np.ndarray, offs: np.ndarray, span: int, tag: np.ndarray | None = None) -> np.ndarray:
    """Which of the positions with ``span`` units in their row have an equal window elsewhere. Only positions of
    equal ``tag`` (a number from 0 on) are compared.

    Bucket-pointer refinement: ``order`` holds the positions by bucket, ``pointer`` each position's bucket (its
    last place in the order) and ``depth`` how many units the bucket's members are known to share."""
    n = len(values)
    if n < span:
        return np.zeros(n, dtype=bool)
    left = (np.repeat(offs[1:], np.diff(offs)) - np.arange(n)).astype(np.int32)
    bits = 0 if tag is None else int(tag.max()).bit_length()
    q = 1 if values.dtype != np.uint8 else max(1, min(7, (63 - bits) // 9))
    first = np.zeros(n, dtype=U64)  # q units, nothing after the row's end
    for k in range(q):
        there = np.flatnonzero(left > k)
        first[there] |= (values[there + k].astype(U64) + U64(q > 1)) << U64(9 * (q - 1 - k))
    if values.dtype == np.uint8 and 9 * q + bits <= 64:
        keys = [first if tag is None else (tag.astype(U64) << U64(9 * q)) | first]
        order = np.argsort(keys[0]).astype(np.int32)
    else:
        keys = [first] if tag is None else [first, tag]
        order = np.lexsort(keys).astype(np.int32)
    depth = np.full(n, q, dtype=np.int32)
    pointer = np.empty(n, dtype=np.int32)

    def point(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Write the pointers of the buckets that begin where ``new`` is set; returns who shares a bucket."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(new)))
        pointer[order[places]] = np.repeat(places[begin + size - 1], size)
        return np.repeat(size > 1, size)

    new = np.ones(n, dtype=bool)
    for key in keys:
        key = key[order]
        new[1:] &= key[1:] == key[:-1]
    new[1:] = ~new[1:]
    del keys, key
    every = np.arange(n, dtype=np.int32)
    places = every[point(every, new)]
    while True:
        places = places[depth[order[places]] < span]
        if not len(places):
            break
        bucket = pointer[order[places]]
        cuts = np.unique(np.searchsorted(bucket, bucket[np.linspace(0, len(bucket) - 1, SLICES + 1).astype(int)[1:-1]], "right"))
        still = []
        for part in np.split(places, cuts):
            if not len(part):
                continue
            at = order[part]
            known, goes_on = depth[at], depth[at] < left[at]
            after = np.where(goes_on, at + known, 0)
            later = np.where(goes_on, pointer[after], -1)  # a row's end comes first
            known = np.where(goes_on, known + depth[after], span)
            own = pointer[at]
            by = np.argsort((own.astype(np.int64) << 32) + later)
            at, later, own = at[by], later[by], own[by]
            order[part] = at
            depth[at] = known[by]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
            still.append(part[point(part, new)])
        places = np.concatenate(still)
    pair = np.flatnonzero((left[order[:-1]] >= span) & (left[order[1:]] >= span))
    for k in [span - q, *range(0, span - q, q)]:
        a, b = order[pair] + k, order[pair + 1] + k
        pair = pair[first[a] == first[b]]
    if tag is not None:
        pair = pair[tag[order[pair]] == tag[order[pair + 1]]]
    hit = np.zeros(n, dtype=bool)
    hit[order[pair]] = hit[order[pair + 1]] = True
    return hit


_SPANS = pa.schema([("r", pa.int32()), ("dig", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])


def _repeats_in(t: pa.Table, rule: Rule) -> pa.RecordBatch:
    """Repeats among the windows of whole buckets of contexts, as ranges of window starts."""
    values, offs, _, _ = units(*text_bytes(t.column("body")), rule)
    lo, at, h = (t.column(k).to_numpy().astype(np.int64) for k in ("lo", "at", "h"))
    row = np.repeat(np.arange(len(lo)), np.diff(offs))
    place = lo[row] + np.arange(len(values)) - offs[:-1][row]
    bucket = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    tag = bucket[row] * (2 * rule.span + 1) + at[row] - place + rule.span
    hit = np.flatnonzero(equal_windows(values, offs, rule.span, tag) & (t.column("n").to_numpy() == 1)[row])
    row, start = row[hit], place[hit]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    pick = pa.array(row[first])
    return pa.RecordBatch.from_arrays(
        [t.column("r").combine_chunks().take(pick), t.column("dig").combine_chunks().take(pick), pa.array(start[first].astype(np.int32)), pa.array(start[last].astype(np.int32))], schema=_SPANS
    )


def _refine(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rule and bucket: the repeats of buckets, about ``REFINE_BYTES`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return _repeats_in(pa.Table.from_batches(held).combine_chunks(), rules[held[0].column("r")[0].as_py()])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        r, h = batch.column("r").to_numpy(), batch.column("h").to_numpy()
        cuts = [0, *np.flatnonzero((h[1:] != h[:-1]) | (r[1:] != r[:-1])) + 1, len(h)]
        _, offs = text_bytes(batch.column("body"))
        at = 0
        for a, b in zip(cuts[:-1], cuts[1:]):  # a bucket is never divided
            goes_on = a == 0 and (r[0], h[0]) == before
            if (held or a > at) and not goes_on:
                now = r[a - 1] if a else before[0]
                if size >= REFINE_BYTES or r[a] != now:
                    if a > at:
                        held.append(batch.slice(at, a - at))
                        at = a
                    yield flush()
                    held, size = [], 0
            size += int(offs[b] - offs[a])
        held.append(batch.slice(at))
        before = (r[-1], h[-1])
    if held:
        yield flush()


def _repeats(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ranges of window starts that are repeats: dig, spans array<struct<r, lo, hi>>; r is the rule's place."""

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()  # a text that is met again after it was forgotten counts as another task's would
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK):
                new = seen.new(block.column("dig").to_pylist())
                again = block.filter(pa.array([not x for x in new]))
                block = block.filter(pa.array(new))
                for r, rule in enumerate(rules):
                    if again.num_rows:  # all windows of a text that comes twice are repeats
                        yield _whole(again, r, rule)
                    yield _anchor_block(block, r, rule)

    rows = docs.select("text", digest(F.col("text")).alias("dig")).where(F.octet_length("text") >= min(r.least_bytes for r in rules))
    found = materialize(in_arrow(rows, anchors_of, "kind int, r int, dig binary, h long, ctx binary, lo int, hi int, at int, n long"), "anchors")
    anchors = found.where("kind = 0")
    by_ctx = anchors.groupBy("ctx").agg(F.sum("n").alias("n"), F.min("h").alias("h"))
    by_gram = materialize(by_ctx.groupBy("h").agg(F.count(F.lit(1)).alias("nc")).where("nc > 1"), "grams")
    wanted = by_ctx.join(by_gram, "h", "left").where("n > 1 OR nc IS NOT NULL").select("ctx", F.col("n").alias("total"), F.coalesce("nc", F.lit(0)).alias("nc"))
    joined = materialize(anchors.select("ctx", "r", "dig", "h", "lo", "hi", "at").join(wanted, "ctx"), "repeats")
    out = ["r", "dig", "lo", "hi"]
    parts = [joined.where("total > 1").select(*out), found.where("kind = 1").select(*out)]
    # one text of each context in a bucket with several
    several = joined.where("nc > 1").groupBy("ctx").agg(F.min(F.struct("dig", "lo", "hi", "at", "r")).alias("c"), F.min("h").alias("h"), F.max("nc").alias("nc"), F.max("total").alias("n"))
    chosen = several.groupBy(F.col("c.dig").alias("dig")).agg(F.collect_list(F.struct("c.r", "h", "nc", "n", "c.lo", "c.hi", "c.at")).alias("wanted"))
    texts = _packed(rows, ["dig"], once=True)
    hot = materialize(in_arrow(texts.join(chosen, "dig").dropDuplicates(["dig"]), lambda b: _fetch(rules, b), _CONTEXT), "contexts")
    temporary = [found, by_gram, joined, hot]
    cold = []
    while True:
        cold.append(hot.where(F.col("nc") <= HOT))
        hot = hot.where(F.col("nc") > HOT)
        if hot.isEmpty():
            break
        temporary.append(halves := materialize(in_arrow(hot, lambda b: _halves(rules, b), _CONTEXT), "halves"))
        counts = halves.groupBy("h", "ctx").agg(F.sum("n").alias("total"))
        parts.append(halves.where("n = 1").join(counts.where("total > 1"), ["h", "ctx"], "left_semi").select(*out))
        several = counts.groupBy("h").agg(F.count(F.lit(1)).alias("several")).where("several > 1")
        one = halves.dropDuplicates(["h", "ctx"]).join(counts, ["h", "ctx"]).join(several, "h")
        temporary.append(hot := materialize(one.withColumns({"nc": F.col("several"), "n": F.col("total")}).select(*_CONTEXT_TYPES), "contexts"))
    cold_rows = reduce(DataFrame.unionAll, cold).repartition(F.col("h")).sortWithinPartitions("r", "h")
    parts.append(in_arrow(cold_rows, lambda b: _refine(rules, b), "r int, dig binary, lo int, hi int"))
    every = materialize(reduce(DataFrame.unionAll, parts).distinct(), "spans")
    for df in temporary:
        discard(df)
    return every.groupBy("dig").agg(F.collect_list(F.struct("r", "lo", "hi")).alias("spans"))


def _covered(n: int, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + span, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats_removed(docs: DataFrame, rule: Rule = BYTES, marks: tuple[Rule, ...] = ()) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes, binary)
    in place of text, and marked: for each rule of ``marks`` how many units its repeats cover; these stay.

    With words, a run goes from the first byte of its first word to the last byte of its last."""
    extra = ("n_bytes", "n_removed", "n_spans", "kept", "marked")
    keep = [c for c in docs.columns if c not in ("text", "dig", "z", "spans", *extra)]
    types = [*(T.StructField(c, T.LongType()) for c in extra[:3]), T.StructField("kept", T.BinaryType()), T.StructField("marked", T.ArrayType(T.LongType()))]
    return _removed(docs, keep, (rule, *marks), T.StructType([*(docs.schema[c] for c in keep), *types]), None)


def _removed(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...], schema: T.StructType, shape: Callable[[pa.RecordBatch], pa.RecordBatch] | None) -> DataFrame:
    """``repeats_removed`` with each batch put into another shape before it leaves its worker."""
    extra = ("n_bytes", "n_removed", "n_spans", "kept", "marked")
    marked = docs.select(*quoted([*keep, "text"]), digest(F.col("text")).alias("dig"))
    both = _packed(marked, [*keep, "dig"]).join(_repeats(docs, rules), "dig", "left").select(*quoted([*keep, "z", "spans"]))
    arrow = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int64())]

    def one(raw: bytes, found: tuple[np.ndarray, ...]) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        rows = []
        for r, each in enumerate(rules):
            mine = found[0] == r
            if not mine.any():
                rows.append(None)
                continue
            values, _, starts, ends = units(data, np.array([0, len(data)]), each)
            rows.append((_covered(len(values), found[1][mine], found[2][mine], each.span), starts, ends))
        counts = [0 if x is None else int(x[0].sum()) for x in rows[1:]]
        if rows[0] is None:
            return len(raw), 0, 0, raw, counts
        gone, starts, ends = rows[0]
        begin = np.flatnonzero(gone & np.append(True, ~gone[:-1]))
        end = np.flatnonzero(gone & np.append(~gone[1:], True))
        cut = _covered(len(data), starts[begin], ends[end], 0)
        return len(raw), int(cut.sum()), len(begin), data[~cut].tobytes(), counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        nothing = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for block in row_blocks(batch, "z", BLOCK >> 1):
                lists = block.column("spans")
                rows = [one(unpack.decompress(z), tuple(x.to_numpy() for x in lists[k].values.flatten()) if lists[k].is_valid else nothing) for k, z in enumerate(block.column("z").to_pylist())]
                made = [pa.array(x, t) for x, t in zip(zip(*rows), arrow)]
                out = pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *made], schema=pa.schema([*(block.schema.field(c) for c in keep), *zip(extra, arrow)]))
                yield out if shape is None else shape(out)

    return in_arrow(both, run, schema)


def deduplicate(docs: DataFrame, rule: Rule = PASSAGES) -> DataFrame:
    """``docs`` with repeats cut out of the text; characters cut in half go as well, and texts of which
    only white space is left by the cuts are removed. All columns stay; n_chars follows."""
    schema, columns = docs.schema, docs.columns
    # whatever their names are, the other columns travel as one
    rows = docs.select(F.struct(*quoted(c for c in columns if c != "text"), F.col("text").isNull().alias("null text")).alias("row"), "text")

    def shape(block: pa.RecordBatch) -> pa.RecordBatch:
        gone = block.column("n_removed").to_pylist()
        *rest, null = block.column("row").flatten()
        texts = [None if n else x.decode("utf-8", "ignore") for x, n in zip(block.column("kept").to_pylist(), null.to_pylist())]
        left = iter(rest)
        arrays = {c: pa.array(texts, pa.string()) if c == "text" else next(left) for c in columns}
        if "n_chars" in arrays:
            old = arrays["n_chars"]
            arrays["n_chars"] = pa.array([len(t) if g else o for t, g, o in zip(texts, gone, old.to_pylist())], old.type)
        keep = [not g or bool(t.strip()) for t, g in zip(texts, gone)]
        return pa.RecordBatch.from_arrays(list(arrays.values()), names=columns).filter(pa.array(keep))

    return _removed(rows, ["row"], (rule,), schema, shape)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 by repeats of 400 bytes, and
    n_passage_words: its words in passages of over 50 words that repeat (only reported: the 400 bytes decide).
    Both rules share one pass over the texts, one table of anchors and every shuffle."""
    both = repeats_removed(docs.select("doc_id", "text"), BYTES, (PASSAGES,))
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("marked")[0].alias("n_passage_words"))
