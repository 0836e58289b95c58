"""Periodic runs against a search of every period, on random and hand-made texts and whole tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from graphwarden.llm import periodic


def every_period(w):
    """Runs by trying every period: (start, length, period)."""
    seen, out = set(), []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j) != (i, i) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = every_period(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(rng):
    k, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 6, 7, 20, 60, 130])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        docs = [made(rng) for _ in range(rng.randint(1, 6))]
        offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = periodic.find(np.array([x for d in docs for x in d], np.int64), offs)
        assert [tuple(r) for r in got.tolist()] == [(t, *r) for t, d in enumerate(docs) for r in every_period(d)]


def test_nested_and_neighbouring():
    inner = "a a a a a a b c".split()
    w = inner * 5 + ["x"] + ["p", "q"] * 4 + ["q", "p"] * 4
    ids = np.unique(w, return_inverse=True)[1]
    assert [tuple(r)[1:] for r in periodic.find(ids, np.array([0, len(w)])).tolist()] == every_period(w)


def test_slices(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 16)
    w = np.concatenate([np.arange(100), np.tile(np.arange(37), 5), np.zeros(50, np.int64), np.tile([1, 2], 90)])
    assert [tuple(r)[1:] for r in periodic.find(w, np.array([0, len(w)])).tolist()] == every_period(w.tolist())


def test_colliding_hashes(monkeypatch):
    """Hashes that call everything equal: what is found is still compared word by word."""
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    w = np.array([1, 2, 3, 4, 5, 6, 7, 8] + [9] * 8 + [1, 2, 3])
    found = [tuple(r)[1:] for r in periodic.find(w, np.array([0, len(w)])).tolist()]
    assert found == [(8, 8, 1)]


def test_long_texts():
    for w in (np.zeros(300_000, np.int64), np.tile(np.arange(1000), 200), np.arange(200_000)):
        got = periodic.find(w, np.array([0, len(w)])).tolist()
        assert got == {300_000: [[0, 0, 300_000, 1]]}.get(len(w), [[0, 0, 200_000, 1000]] if w[1000] == 0 else [])


EDGES = [(i, t) for i in (1, 4, 26, None) for t in (None, "", " \n\t\x0b\x0c\r ", "a", "a " * 6, "a a a a a", "ab\x1cab ab\xa0ab " * 5, "é ñ é ñ é ñ é ñ", "one two three four five " * 40, "x " * 50 + "y z " * 60)]


def test_report_on_edges(spark):
    ten = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = EDGES + [(i, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * (1 + i % 7)) for i in ten] + [(7, "a b " * 9)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "2 AS start", "'q' AS `a.b`")
    got = sorted(map(str, (tuple(r) for r in periodic.report(df).collect())))
    assert got == sorted(str(contract(*r)) for r in rows)
    assert periodic.report(df.limit(0)).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: tuple(r) for r in periodic.report(docs).collect()}
    short = [r for r in rows if len(r[1] or "") < 20_000]
    assert len(got) == len(rows) and len(short) > 150
    for r in short:
        assert got[r[0]] == contract(*r)


def test_columns_and_collapse(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "q"), (2, " no  run ", "q"), (3, None, "q"), (3, None, "q")], "doc_id long, text string, `a.b` string").selectExpr("*", "5 AS start")
    out = periodic.collapse(df)
    assert out.columns == df.columns
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(x) for x in [(1, "a b c", "q", 5), (2, " no  run ", "q", 5), (3, None, "q", 5), (3, None, "q", 5)])
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.with_runs(df).collect()}
    assert found == {1: [(0, 8, 2)], 2: [], 3: []}
    assert periodic.collapse(df.limit(0)).collect() == [] and periodic.with_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 5, 60])
def test_repeated(n):
    for doc in range(200):
        at = periodic.repeated(doc, n)
        assert (at is None) == (zlib.crc32(str(doc).encode()) % 10 != 0)
        assert at is None or (at >= 0).all() and (at < n).all()
