"""N-gram Jaccard join: MinHash LSH forest with exact verification.

1. Each text is reduced to the set of its word 5-gram hashes. Texts with the same words are one
   *set*, found by a digest and counted.
2. The forest: each of ``TREES`` tries holds a label of ``DEEPEST`` MinHash values (16 bits each) for each
   set. Labels are range-sorted over the cluster: a sorted list of labels is a trie, in which the sets that
   share a prefix stand side by side, and a prefix held by very many sets is spread over tasks and scanned
   as a stream. Each set's matched prefix is shortened from the whole label on until any partner that a set
   of its size can have meets it in some trie with the target probability: sets of one to three shingles
   can only have equal ones and keep the whole label, those of six and seven match on 5 and 6 values, most
   others on 4. Where a prefix of ``HALF`` values is *crowded* (held by more than ``CROWD`` sets), nothing is
   shortened: its sets match on whole labels there and stand in ``DEEP`` times as many further tries, which
   deal the same values anew. Two sets that share a crowded prefix do so both, and meet with the target
   probability again. Two sets meet where they share the longer one of their two prefixes; at each length,
   each set is linked to the first one of its prefix.
3. Sets that meet directly or through others form a candidate group. The pairs of a group that share a prefix
   of ``HALF`` values in some trie are verified exactly, in groups of any size. How their texts get together
   depends on the size alone: the texts of a group are fetched once, compressed; in a group of more blocks than
   ``SPREAD``, which may be a mere chain of neighbours, they go to each shared prefix, and a pair that shares
   several counts in the first of them. Large groups and prefixes are cut into blocks, and each pair of blocks
   is a task. Only degrees and spanning links leave a task, never all pairs.

Class: connected component over verified links (Jaccard >= 0.8); its id is the least doc_id in it.
n_links: the other documents linked with this one, copies included.

A text of fewer than five words, but not none, is one shingle. Null, empty and wordless texts have no
shingles: each is a class of its own without links. Null ids never win as a class id unless a class
has no other; repeated rows are copies. Extra columns are ignored, very long texts are used whole, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, Seen, Words, digests, in_arrow, minhash, mix, quoted, row_blocks, row_sum, shingles, text_bytes
from .components import components
from .storage import discard, materialize

WORDS = 5
THRESHOLD = (4, 5)  # 0.8
TREES, DEEPEST, RECALL = 20, 8, 0.9999
CROWD, DEEP = 256, 4
BLOCK_SETS, BLOCK_TEXT, BLOCK = 256, 4 << 20, 1 << 19
SPREAD = 20
_COLUMNS = 1 << 15
_NO_ID = (1 << 63) - 1


def prefix_depth(similarity: float = 0.8, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest label prefix with which a pair of this similarity still meets with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int) -> float:
    """The least Jaccard similarity of at least the threshold that a set of n shingles can have with any set."""
    low, high = THRESHOLD
    # a partner has m shingles and t common ones, and t is at least low / (low + high) of n + m
    partners = range(-(-low * n // high), high * n // low + 1)
    common = [(n + m, -(-low * (n + m) // (low + high))) for m in partners]
    return min(t / (both - t) for both, t in common)


#: By number of shingles: the matched prefix. From 20 on, some partner is at the threshold itself.
DEPTHS = np.array([prefix_depth(least_similarity(n)) for n in range(1, 21)], dtype=np.int32)
HALF = 4  # values in each of a label's two 64-bit halves; no matched prefix is shorter


def set_depths(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The matched prefix of each row's set of shingle hashes. Rows of many shingles, distinct or not, get the
    shortest one, which is never wrong."""
    n = np.diff(bounds)
    small = np.flatnonzero(n < len(DEPTHS))
    rows = np.repeat(np.arange(len(small)), n[small])
    v = values[np.repeat(bounds[:-1][small] - (np.cumsum(n[small]) - n[small]), n[small]) + np.arange(len(rows))]
    by = np.lexsort((v, rows))
    v, rows = v[by], rows[by]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (rows[1:] != rows[:-1])
    distinct = n.copy()
    distinct[small] = np.bincount(rows[new], minlength=len(small))
    return DEPTHS[np.clip(distinct, 1, len(DEPTHS)) - 1]


def word_digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's word sequence."""
    at = np.arange(len(w.hash)) - np.repeat(w.rows[:-1], w.counts)
    place = mix(at.astype(U64) + U64(1)) | U64(1)
    return mix(row_sum(mix(w.hash ^ U64(0xA5A5)) * place, w.rows)), mix(row_sum(w.hash * mix(place) + place, w.rows) + U64(1))


def _digest_column(w: Words) -> pa.Array:
    d = digests(*word_digests(w))
    return pa.array(d.to_pylist(), pa.binary(), mask=w.counts == 0) if (w.counts == 0).any() else d


def with_set(df: DataFrame, text: str = "text", out: str = "cls", trees: int = 0) -> DataFrame:
    """``df`` with the digest of each text's words (null: no words) and, if trees are asked for, the forest's
    labels (column labels: two packed 64-bit halves for each trie) and the length of the matched prefix
    (column depth)."""
    keep = [c for c in df.columns if c != text or not trees]
    extra = [T.StructField(out, T.BinaryType())] + [T.StructField("labels", T.BinaryType()), T.StructField("depth", T.IntegerType())] * bool(trees)
    schema = T.StructType([df.schema[c] for c in keep] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, text, BLOCK):
                w = Words(*text_bytes(block.column(text)))
                columns = [*(block.column(c) for c in keep), _digest_column(w)]
                if trees:
                    grams = shingles(w.hash, w.rows, WORDS)
                    values = minhash(*grams, trees * DEEPEST)
                    halves = np.empty((block.num_rows, trees, 2), dtype="<u8")
                    for t in range(trees):
                        # a constant of the trie keeps the tries apart and prefixes as they are
                        digits = (mix(values[:, t * DEEPEST : (t + 1) * DEEPEST].astype(U64)) >> U64(48)).reshape(-1, 2, HALF)
                        halves[:, t] = mix(np.array([t + 1], U64))
                        for j in range(HALF):
                            halves[:, t] ^= digits[:, :, j] << U64(16 * (HALF - 1 - j))
                    bounds = np.arange(block.num_rows + 1, dtype=np.int32) * trees * 16
                    columns.append(pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(halves.tobytes())]))
                    columns.append(pa.array(set_depths(*grams)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return in_arrow(df, run, schema)


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set and trie; label and low are the halves of the label."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            data, offs = text_bytes(part.column("labels"))
            halves = np.frombuffer(data.tobytes(), "<i8").reshape(-1, 2)
            n = np.diff(offs) // 16
            rows = pa.array(np.repeat(np.arange(part.num_rows), n))
            tree = np.arange(len(halves)) - np.repeat(offs[:-1], n) // 16
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.astype(np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), part.column("depth").take(rows), part.column("cls").take(rows)],
                names=["tree", "label", "low", "depth", "cls"],
            )


def deals(values: int, rounds: int = DEEP) -> np.ndarray:
    """Further tries: in each round all values are dealt into labels, in an order of its own."""
    rng = np.random.default_rng(values)
    return np.concatenate([rng.permutation(values).reshape(-1, DEEPEST) for _ in range(rounds)])


def _deep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set and further trie, matched on the whole label."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            trees = len(part.column("labels")[0].as_py()) // 16
            halves = np.frombuffer(text_bytes(part.column("labels"))[0].tobytes(), "<u8").reshape(-1, trees, 2) ^ mix(np.arange(1, trees + 1, dtype=U64))[:, None]
            digits = np.stack([(halves >> U64(16 * (HALF - 1 - j))) & U64(0xFFFF) for j in range(HALF)], axis=3).reshape(part.num_rows, -1)
            dealt = digits[:, deals(digits.shape[1])].reshape(part.num_rows, -1, 2, HALF)
            n = dealt.shape[1]
            out = np.zeros(dealt.shape[:3], dtype=U64) ^ mix(np.arange(trees + 1, trees + n + 1, dtype=U64))[:, None]
            for j in range(HALF):
                out ^= dealt[..., j] << U64(16 * (HALF - 1 - j))
            out = out.reshape(-1, 2).view("<i8")
            columns = [np.tile(np.arange(trees, trees + n, dtype=np.int32), part.num_rows), out[:, 0].copy(), out[:, 1].copy(), np.full(len(out), DEEPEST, dtype=np.int32)]
            cls = part.column("cls").take(pa.array(np.repeat(np.arange(part.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), cls], names=["tree", "label", "low", "depth", "cls"])


_ROWS = "tree int, label long, low long, depth int, cls binary"
_MET = pa.schema([("kind", pa.int32()), ("label", pa.int64()), ("low", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted labels, at each prefix length: the sets whose own prefix is no longer, each with the first
    of them that shares the prefix in this partition (kind 0), and the partition's first and last prefix with
    their first sets (kind: the length), which may go on in the next. Pairs that meet at a shorter length are
    left to it."""

    def border(level: int, label: int, low: int, cls: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((level, label, low, cls, cls), _MET)], schema=_MET)

    heads: dict[int, tuple[int, int, bytes, int]] = {}
    for batch in batches:
        every, cls = batch.column("depth").to_numpy(), batch.column("cls")
        for level in sorted(set(DEPTHS.tolist())):
            at = np.flatnonzero(every <= level)
            if not len(at):
                continue
            label, low = batch.column("label").to_numpy()[at], batch.column("low").to_numpy()[at]
            low = low >> (16 * (2 * HALF - level)) if level > HALF else np.zeros_like(low)
            depth = every[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | (low[1:] != low[:-1])
            if level in heads:
                new[0] = (label[0], low[0]) != heads[level][:2]
            else:
                yield border(level, label[0], low[0], cls[int(at[0])].as_py())
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            met = np.flatnonzero(~new)
            carried = first[met] < 0
            head_depth = np.where(carried, heads[level][3] if level in heads else 0, depth[first[met]])
            met, carried = (x[np.maximum(depth[met], head_depth) == level] for x in (met, carried))
            own = met[~carried]
            for member, b in ((own, cls.take(pa.array(at[first[own]]))), (met[carried], pa.array([heads[level][2]] * int(carried.sum()) if carried.any() else [], pa.binary()))):
                if len(member):
                    none = pa.nulls(len(member), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(member), np.int32)), none, none, cls.take(pa.array(at[member])), b], schema=_MET)
            if first[-1] >= 0:
                k = int(first[-1])
                heads[level] = int(label[k]), int(low[k]), cls[int(at[k])].as_py(), int(depth[k])
    for level, (label, low, head, _) in heads.items():
        yield border(level, label, low, head)


def verify(table: pa.Table) -> pa.Table:
    """Exact links within a block or between two blocks: for each linked set the number of documents
    linked to it and the least set that it is connected with here."""
    unpack = zstandard.ZstdDecompressor()
    ids = table.column("cls").to_pylist()
    order = sorted({c: k for k, c in enumerate(ids)}.items())  # one row of each set, by digest
    rows = np.array([k for _, k in order])
    part = table.take(pa.array(rows))
    block, copies = part.column("blk").to_numpy(), part.column("copies").to_numpy()
    w = Words(*text_bytes(pa.array([unpack.decompress(z) for z in part.column("z").to_pylist()], pa.binary())))
    values, bounds = shingles(w.hash, w.rows, WORDS)
    m = len(rows)
    row = np.repeat(np.arange(m), np.diff(bounds))
    by = np.lexsort((row, values))
    values, row = values[by], row[by]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    size = np.bincount(row, minlength=m)
    start = np.ones(len(values), dtype=bool)
    start[1:] = values[1:] != values[:-1]
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    row, column = row[shared], np.cumsum(start[shared])[: int(shared.sum())] - 1
    both = np.zeros((m, m), dtype=np.int32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        bits = np.zeros((m, min(_COLUMNS, (int(column[-1]) - low) // 64 * 64 + 64)), dtype=bool)
        bits[row[a:b], column[a:b] - low] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(m - 1):
            both[i, i + 1 :] += np.bitwise_count(packed[i] & packed[i + 1 :]).sum(1, dtype=np.int32)
    n, d = THRESHOLD
    link = d * both >= n * (size[:, None] + size[None, :] - both)
    link &= np.triu(np.ones((m, m), dtype=bool), 1)
    if len(table) and table.column("i")[0].as_py() != table.column("j")[0].as_py():
        link &= block[:, None] != block[None, :]
    tree = part.column("tree")[0].as_py() if m else -1
    if m:
        label = np.frombuffer(b"".join(part.column("labels").to_pylist()), "<i8").reshape(m, -1)[:, ::2]
        for i in np.flatnonzero(link.any(1)):
            if tree < 0:  # a whole group: pairs that share a prefix in some trie
                link[i] &= (label == label[i]).any(1)
            else:  # one prefix: pairs that share one in an earlier trie are counted there
                link[i] &= ~(label[:, :tree] == label[i, :tree]).any(1)
    link |= link.T
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(link, label[None, :], m).min(1, initial=m))
        least = least[least]
        if (least == label).all():
            break
        label = least
    found = link.any(1)
    at = np.flatnonzero(found)
    return pa.table({
        "cls": pa.array([order[k][0] for k in at], pa.binary()),
        "head": pa.array([order[label[k]][0] for k in at], pa.binary()),
        "links": pa.array((link[at] * copies[None, :]).sum(1), pa.int64()),
        "multi": pa.array((part.column("nblk").to_numpy()[at] > 1) | (tree >= 0)),
    })


def _key() -> Column:
    return F.coalesce("doc_id", F.lit(_NO_ID))


def _blocks(rows: DataFrame, by: str) -> DataFrame:
    """For each group: its sets (n) and the blocks that they are cut into (nblk)."""
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return counted.withColumn("nblk", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_TEXT)).cast("int"))


def _texts(docs: DataFrame, key: Column) -> DataFrame:
    """Compressed texts by the key and the text's hash, equal ones near each other in a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        seen = Seen()
        for batch in batches:
            for block in row_blocks(batch, "text"):
                block = block.filter(pa.array(seen.new(zip(block.column("th").to_pylist(), block.column("k").to_pylist()))))
                z = [pack.compress(x.encode()) for x in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("th"), block.column("k"), pa.array(z, pa.binary())], names=["th", "k", "z"])

    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("th"), key.alias("k"))
    return in_arrow(rows, run, "th long, k long, z binary")


def _forest(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all tries (label, low, depth, cls), and the written table of crowded prefixes."""
    columns = ["label", "low", "depth", "cls"]
    labels = in_arrow(sets.select("labels", "depth", "cls"), _label_rows, _ROWS)
    crowded = materialize(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("label", F.lit(True).alias("crowded")), "crowded")
    if crowded.isEmpty():
        return labels.select(*columns), crowded
    placed = labels.join(crowded, "label", "left").withColumn("depth", F.when(F.col("crowded"), F.lit(DEEPEST)).otherwise(F.col("depth")))
    dense = labels.join(crowded, "label", "left_semi").select("cls").distinct()
    deep = in_arrow(sets.join(dense, "cls", "left_semi").select("labels", "cls"), _deep_rows, _ROWS)
    return placed.select(*columns).unionAll(deep.select(*columns)), crowded


def _class_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, cls) and, for each set: class_id, class_size, n_links of its documents,
    and kept_cls, the set of the document that gives the class its id."""
    sig = with_set(docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("size")), trees=TREES)
    sig = materialize(sig, "sets")
    key = _key()
    sets = materialize(
        sig.where("cls IS NOT NULL").groupBy("cls").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct(key.alias("k"), "th")).alias("rep"), F.max("size").alias("size"), F.max("labels").alias("labels"), F.max("depth").alias("depth")
        ), "sets",
    )
    labels, crowded = _forest(sets)
    sorted_ = labels.repartitionByRange("label", "low", "cls").sortWithinPartitions("label", "low", "cls")
    met = materialize(in_arrow(sorted_, _meetings, "kind int, label long, low long, a binary, b binary"), "meetings")
    border = met.where("kind > 0").select("kind", "label", "low", "a").distinct()
    across = border.join(border.groupBy("kind", "label", "low").agg(F.min("a").alias("b")), ["kind", "label", "low"]).select("a", "b")
    groups = components(met.where("kind = 0").select("a", "b").unionAll(across))
    members = materialize(groups.withColumnRenamed("node", "cls").join(sets, "cls").select("cls", "root", "copies", "size", "rep", "labels", "depth"), "members")
    blocks = materialize(_blocks(members, "root").select("root", "nblk"), "blocks")
    member = members.join(blocks, "root")
    whole = member.where(F.col("nblk") <= SPREAD).select("cls", "rep", "copies", F.col("root").alias("node"), "nblk", F.lit(-1).alias("tree"), "labels")
    chained = materialize(member.where(F.col("nblk") > SPREAD).drop("nblk"), "chained")
    parts, temporary = whole, [crowded, met, groups, members, blocks, chained]
    if not chained.isEmpty():
        prefixes = in_arrow(chained.select("labels", "depth", "cls"), _label_rows, _ROWS).select("tree", "label", "cls")
        # groups that share a crowded prefix stay apart, as smaller ones do
        nodes = prefixes.join(chained, "cls").withColumn("node", F.concat(F.encode(F.hex("label"), "utf-8"), "root"))
        temporary.append(sizes := materialize(_blocks(nodes, "node").where("n > 1").select("node", "nblk"), "nodes"))
        parts = parts.unionAll(nodes.join(sizes, "node").select("cls", "rep", "copies", "node", "nblk", "tree", "labels"))
    places = parts.groupBy("rep").agg(F.collect_list(F.struct("cls", "copies", "node", "nblk", "tree", "labels")).alias("places"))
    texts = _texts(docs, key)
    fetched = texts.join(places.select("rep.k", "rep.th", "places"), ["th", "k"]).dropDuplicates(["th", "k"]).select("z", F.explode("places").alias("p")).select("z", "p.*")
    fetched = fetched.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nblk")).cast("int"))
    paired = fetched.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nblk") - 1))).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("o")
    verified = materialize(paired.groupBy("node", "i", "j").applyInArrow(verify, "cls binary, head binary, links long, multi boolean"), "links")
    large = components(verified.where("multi").select(F.col("cls").alias("a"), F.col("head").alias("b")))
    root = verified.where("NOT multi").select("cls", F.col("head").alias("root")).unionAll(large.select("node", "root"))
    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    info = sets.select("cls", "copies", "first_id", "rep").join(root, "cls", "left").join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "cls")
    roots = materialize(info, "roots")
    classes = materialize(roots.groupBy("root").agg(F.min(order).alias("m"), F.sum("copies").alias("class_size")), "classes")
    made = [sets, verified, large, roots, classes]
    info = roots.join(classes, "root").select(
        "cls", F.col("m.first_id").alias("class_id"), "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("m.cls").alias("kept_cls"), "rep"
    )
    info = materialize(info, "classes")
    for df in (*temporary, *made):
        discard(df)
    return sig.select("doc_id", "cls", "th"), info


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links."""
    rows, info = _class_ids(docs)
    alone: Column = F.col("class_size").isNull()
    return rows.join(info, "cls", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one with the least id; all columns stay."""
    rows, info = _class_ids(docs)
    one = info.where(F.col("kept_cls") == F.col("cls")).select(F.col("rep.k").alias("k"), F.col("rep.th").alias("th"), F.lit(True).alias("one"))
    wordless = rows.where("cls IS NULL").select(_key().alias("k"), F.coalesce("th", F.lit(0)).alias("th"), F.lit(False).alias("one")).distinct()
    # whatever their names are, the columns travel as one
    marked = docs.select(F.struct(*quoted(docs.columns)).alias("row"), _key().alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    found = marked.join(one.unionAll(wordless), ["k", "th"])
    # rows of one id and text are sorted next to each other by the join
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("k", "th").orderBy("th"))).where("NOT one OR nth = 1").select("row.*")
