"""BPE encoding and decoding.

The encoder backtracks: at each offset it takes the longest vocabulary entry that an Aho-Corasick
automaton found there, and keeps it if the pair with its left neighbour is compatible, i.e. if merging
the two entries' own merges in order of rank would not have joined across their border. Otherwise it
goes to the next shorter entry, or one step back; an offset from which no way leads on is never
entered again, so the work is linear in the text. Decoding gathers bytes through an offset table.

Input: any frame with a text column. Null and empty texts give no ids and an empty decoded text. Very
long texts are handled piece by piece (white space always separates pieces); repeated rows and ties
are independent of each other; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_arrow, quoted, row_blocks, text_bytes

#: Code points that the tokenizer's own \s matches (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: str.split() also splits at these, which are no white space to the tokenizer.
ODD_SPACE = re.compile("[\\x1c-\\x1f]")
#: Beyond ASCII and extended Latin.
UNUSUAL = re.compile("[^\\x00-\u024f]")
CACHE_ENTRIES = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pairs(dict):
    """The pair-compatibility table, filled as pairs come up."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[pair] = self.find(*pair)
        return found


class Bpe:
    """An encoder for one vocabulary file of the ``tokenizers`` kind with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        model = spec["model"]
        end, back = model["end_of_word_suffix"] or "", byte_alphabet()
        self.back = back
        vocab: dict[str, int] = model["vocab"]

        def symbols(token: str) -> str:
            closed = end and token.endswith(end) and token != end
            body = token[: -len(end)] if closed else token
            raw = [back[c] for c in body]
            if closed:
                raw[-1] += 256
            return "".join(map(chr, raw))

        by_id = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id |= {i: t for t, i in self.special.items()}
        self.size = max(by_id) + 1
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = c
            self.parts.setdefault(c, (a, b))
        self.length, texts = {}, {}
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            s = symbols(token)
            if len(s) > 1 and i not in self.parts:
                continue  # no merge makes it
            texts[s] = i
            self.length[i] = len(s)
            automaton.add_word(s, i)
        automaton.make_automaton()
        self.automaton = automaton
        #: The longest shorter entry that an entry begins with.
        self.shorter: dict[int, int] = {}
        for s, i in texts.items():
            n = len(s) - 1
            while n and s[:n] not in texts:
                n -= 1
            self.shorter[i] = texts[s[:n]] if n else -1
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.compatible = _Pairs(self._fits)
        self.chunks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.offsets, self.table = self._decode_table(by_id)

    def _decode_table(self, by_id: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's UTF-8 text with the blank that joins it to the next, one after the other."""
        rows = [(by_id.get(i, "") + " ").encode() for i in range(self.size)]
        return np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.frombuffer(b"".join(rows), np.uint8)

    def _fits(self, a: int, b: int) -> bool:
        limit = self.size
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            # undo the later of the two entries' last merges: what stood at the border before it
            if a > b and a in self.parts:
                limit, a = a, self.parts[a][1]
            elif b in self.parts:
                limit, b = b + 1, self.parts[b][0]
            elif a in self.parts:
                limit, a = a, self.parts[a][1]
            else:
                return True

    def word(self, s: str) -> list[int]:
        """Ids of one word given as symbols: bytes, the last one raised by 256."""
        n, length, shorter, fits = len(s), self.length, self.shorter, self.compatible
        longest: list[int] = [-1] * (n + 1)
        for end, i in self.automaton.iter(s):  # of the entries at an offset, longer ones end later
            longest[end + 1 - length[i]] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            if token < 0:
                dead[at] = 1
                at -= length[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1
                continue
            to = at + length[token]
            if not dead[to] and (last < 0 or fits[last, token]):
                out.append(token)
                at, last, token = to, token, longest[to]
            else:
                token = shorter[token]
        return out

    def chunk(self, text: str) -> bytes:
        """Packed ids of a normalised text without white space."""
        known = self.chunks.get(text)
        if known is not None:
            return known
        known = self.before.get(text)
        if known is not None:
            self._remember(text, known)
            return known
        own = not UNUSUAL.search(text)
        if own and text.isalpha():
            raw = text.encode()
            known = array("I", self.word(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))).tobytes()
        elif own and len(text) > 1 and text[-1] in ".," and text[:-1].isalpha():
            known = self.chunk(text[:-1]) + self.chunk(text[-1])
        else:
            ids: list[int] = []
            for raw in self.pieces_of(text, own):
                ids += self.word(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
            known = array("I", ids).tobytes()
        if len(text) <= 64:
            self._remember(text, known)
        return known

    def _remember(self, text: str, ids: bytes) -> None:
        """Two generations bound the memory and keep what is in use."""
        if len(self.chunks) >= CACHE_ENTRIES:
            self.before, self.chunks = self.chunks, {}
        self.chunks[text] = ids

    def pieces_of(self, text: str, own: bool) -> list[bytes]:
        """The words of a text without white space. Whether a code point beyond extended Latin is a
        letter or a number depends on the Unicode version, so the tokenizer's own tables decide."""
        if own:
            return [x.encode() for x in self.pieces.findall(text)]
        back = self.back
        return [bytes([back[c] for c in x]) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode(self, text: str | None) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials and "<|" in text:
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # texts of ASCII and extended Latin are in normal form C already
        text = text.lower() if text.isascii() or not UNUSUAL.search(text) else self.library.normalizer.normalize_str(text)
        words = re.split(f"[{SPACE}]+", text) if ODD_SPACE.search(text) else text.split()
        known = self.chunks
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            chunk = self.chunk
            return b"".join([chunk(w) for w in words if w])

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts of rows of ids: entries joined by blanks."""
        length = np.diff(self.offsets)[ids]
        ends = np.cumsum(length)
        shift = np.repeat(self.offsets[ids] - (ends - length), length)
        data = self.table[shift + np.arange(len(shift))]
        bounds = np.concatenate([[0], ends])[rows]
        full = np.diff(rows) > 0
        keep = np.ones(len(data), bool)
        keep[bounds[1:][full] - 1] = False  # the blank after a row's last entry
        offs = bounds - np.concatenate([[0], np.cumsum(full)])
        return data[keep], offs


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of each text (binary: little-endian unsigned 32-bit integers) and their
    number. ``path``: the vocabulary file, readable on every executor."""
    keep = [c for c in df.columns if c not in (ids, n_tokens)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for block in row_blocks(batch, text):
                packed = [bpe.encode(x) for x in block.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(c) for c in keep), pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())],
                    names=[*keep, ids, n_tokens],
                )

    return in_arrow(df.select(*quoted({c: None for c in [*keep, text]})), run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of packed ids, special entries included."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for block in row_blocks(batch, ids):
                data, offs = text_bytes(block.column(ids))
                out, bounds = bpe.decode(np.frombuffer(data.tobytes(), "<u4"), offs // 4)
                column = pa.Array.from_buffers(pa.string(), block.num_rows, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), column], names=[*keep, text])

    return in_arrow(df, run, schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and digests of the ids and of the decoded text."""
    path = path or vocabulary()
    both = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
