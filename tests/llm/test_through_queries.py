"""Queries against scalar versions: the quality query's scores feature by feature, the pipeline's texts stage by stage."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwarden.llm import bpe, quality, registry, sampling, toxicity
from graphwarden.llm.blocks import _MULT

from test_operators import near_classes, passages

M64 = (1 << 64) - 1


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ (h >> 33)


def polynomial(values):
    return sum((v + 1) * pow(_MULT, k, 1 << 64) for k, v in enumerate(values)) & M64


def kind(byte):
    return 1 if 48 <= byte < 58 else 2 if 65 <= byte < 91 else 3 if 97 <= byte < 123 else 4 if byte >= 128 else byte


def features(text):
    """Buckets of a text's features, and how many tokens it has."""
    words = re.findall(rb"[^\t\n\v\f\r ]+", (text or "").encode())
    tokens, shapes = [], []
    for k, w in enumerate(words):
        if k and w == words[k - 1]:
            tokens.append(0x5EED)
            shapes.append(0x5EED)
            continue
        tokens.append(mixed(polynomial(w)))
        runs = [kind(w[0])] + [kind(b) for a, b in zip(w, w[1:]) if kind(a) != kind(b)]
        shapes.append(mixed(polynomial(runs) + 7 & M64))

    def gram(parts, salt):
        h = salt
        for p in parts:
            h = mixed(h * 0x9E3779B97F4A7C15 + p & M64)
        return h >> 44

    out = [gram(tokens[k : k + n], n) for n in (1, 2) for k in range(len(words) - n + 1)]
    out += [gram(shapes[k : k + n], n + 2) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return out, len(words)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_query_like_scalar_scores(spark, sf, tables):
    docs, labels = tables
    learnt, counts = sampling.training_rows(docs, labels, "quality", quality.PER_CLASS, sampling.remainder(F.col("doc_id"), quality.FOLDS) != quality.HELD_OUT)
    samples = []
    for text in learnt["text"].to_pylist():
        found, n = features(text)
        ids, count = np.unique(found, return_counts=True) if found else (np.zeros(0, int), np.zeros(0))
        samples.append((np.append(ids.astype(int), quality.BUCKETS), np.append(4 * count / max(1, n), 1.0)))
    y = learnt["label"].to_numpy()
    w = quality.ftrl(samples, y)  # followed step by step in test_scalar.py
    w[-1] += math.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - math.log(max(1, int((y == 1).sum())) / max(1, int((y == 0).sum())))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = registry.op4_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found, n = features(texts[r.doc_id])
        x = 4 * float(sum(float(w[f]) for f in found)) / max(1, n) + float(w[-1])
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-4, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def cut_windows(text, windows):
    """The text without words in a window of an item, again and again; None if over half of its words go."""
    first = True
    while True:
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        low = [bytes(b + 32 if 65 <= b <= 90 else b for b in text[s:e]) for s, e in found]
        hit = [False] * len(low)
        for size, some in windows.items():
            for k in range(len(low) - size + 1):
                if tuple(low[k : k + size]) in some:
                    hit[k : k + size] = [True] * size
        if not any(hit):
            return text
        if first and sum(hit) > 0.5 * len(hit):
            return None
        first, left, at = False, b"", 0
        for k, (s, e) in enumerate(found):
            if hit[k] and (k == 0 or not hit[k - 1]):
                left += text[at:s]
            if hit[k]:
                at = e
        text = left + text[at:]


def test_pipeline_texts_stage_by_stage(spark, sf, tables):
    import corpus_pipeline

    docs, labels = tables
    step = [(r.doc_id, r.text) for r in toxicity.reject(docs, labels).collect()]
    kept = {c for _, c, _, _ in near_classes(step)}
    step = [(i, t) for i, t in step if i in kept]
    cut = {i: t for i, (t, _) in passages([(i, t.encode()) for i, t in step]).items()}
    step = [(i, cut[i]) for i, t in step if cut[i].strip() or not t.strip()]
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text.encode())
        low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        size = min(10, len(low))
        for k in range(len(low) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(low[k : k + size]))
    want = {i: t for i, t in ((i, cut_windows(t, windows)) for i, t in step) if t is not None}
    coder = bpe.loaded(bpe.vocabulary())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in out} == {i: t.decode() for i, t in want.items()}
    assert all(bytes(r.ids) == coder.encode(r.text) for r in out)
