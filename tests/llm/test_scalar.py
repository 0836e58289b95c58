"""Scalar references, written word by word and feature by feature, of the two classifiers; whole-table and query
tests of BPE, licenses, threads and the pipeline on odd tables."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphwarden.llm import bpe, chat, licenses, quality, registry, storage, toxicity
from graphwarden.llm.blocks import text_bytes

from test_quotes import brute_force


# -- 4
def test_ftrl_follows_the_published_updates():
    """McMahan et al. (2013), algorithm 1, one coordinate at a time."""
    rng = random.Random(3)
    samples = [(np.array(sorted(rng.sample(range(40), 6)) + [quality.BUCKETS]), np.array([rng.choice([0.5, 1.0, 2.0]) for _ in range(6)] + [1.0])) for _ in range(80)]
    labels = np.array([int(sum(i) % 3 == 0) for i, _ in samples])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            ids, x = samples[k]
            w = {i: weight(i) for i in ids.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(ids.tolist(), x))))
            for i, v in zip(ids.tolist(), x):
                g = (p - labels[k]) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.ftrl(samples, labels)
    assert {i: got[i] for i in z} == pytest.approx({i: weight(i) for i in z}, rel=1e-5, abs=1e-7) and np.count_nonzero(got) <= len(z)


# -- 9
def _grams(text):
    """Distinct buckets of a text's 4- to 6-grams of characters."""
    folded = "".join(" " if c in "\t\n\v\f\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out = set()
    for n in toxicity.SIZES:
        for a in range(len(folded) - n + 1):
            h = 0
            for c in folded[a : a + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.add((h ^ (h >> 13) ^ (n * 0x3779)) >> (32 - toxicity.BITS))
    return out


def test_naive_bayes_scaled_regression():
    rng = random.Random(6)
    vocabulary = ["good", "fine", "Tree", "house", "日本語です", "плохо", "awful", "wretch", "été"]
    texts, labels = [], []
    for k in range(360):
        bad = k % 3 == 0
        words = [rng.choice(vocabulary[:5] + ["été"]) for _ in range(6)] + ([rng.choice(["awful", "wretch", "плохо"])] if bad else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(bad))
    sets = [_grams(t) for t in texts]
    n = [labels.count(0), labels.count(1)]
    df = [{}, {}]
    for s, y in zip(sets, labels):
        for g in s:
            df[y][g] = df[y].get(g, 0) + 1
    ratio = {}
    for g in {*df[0], *df[1]}:
        clean, bad = df[0].get(g, 0) + 0.5, df[1].get(g, 0) + 0.5
        r = math.log(bad / (n[1] + 1)) - math.log(clean / (n[0] + 1))
        if abs(r) >= toxicity.MIN_Z * math.sqrt(1 / bad + 1 / clean):
            ratio[g] = r
    assert len(ratio) > 20
    w, b = dict.fromkeys(ratio, 0.0), 0.0
    g2, b2 = dict.fromkeys(ratio, 1e-8), 1e-8
    for _ in range(150):
        grad, gb = {g: 1e-3 * w[g] for g in w}, 0.0
        for s, y in zip(sets, labels):
            used = [g for g in s if g in w]
            e = (1 / (1 + math.exp(-(sum(w[g] * ratio[g] for g in used) + b))) - y) / len(labels)
            gb += e
            for g in used:
                grad[g] += e * ratio[g]
        for g in w:
            g2[g] += grad[g] ** 2
            w[g] -= 0.1 * grad[g] / math.sqrt(g2[g])
        b2 += gb**2
        b -= 0.1 * gb / math.sqrt(b2)
    counts = {0: 900, 1: 100}
    b += math.log(counts[1] / counts[0]) - math.log(n[1] / n[0])
    model = toxicity.train(pa.array(texts, pa.string()), np.array(labels), counts)
    asked = ["", "an AWFUL house", "плохо\tплохо", "日本語です good", "wretch", "x" * 3]
    want = [1 / (1 + math.exp(-(sum(w[g] * ratio[g] for g in _grams(t) if g in w) + b))) for t in asked]
    got = toxicity.score_block(*text_bytes(pa.array(asked, pa.string())), model, model.among())
    assert got.tolist() == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_characters_of_broken_utf8():
    data, offs = np.frombuffer(b"aB\xff\xc3\xa9\t", np.uint8), np.array([0, 3, 6])
    codes, bounds = toxicity.characters(data, offs)
    assert codes.tolist() == [97, 98, 0xFFFD, 0xE9, 32] and bounds.tolist() == [0, 3, 5]


# -- 1, 3, 8
def test_bpe_like_the_library_on_a_whole_table(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in registry.op1_bpe_round_trip(spark, sf).collect()}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_license_query(spark):
    """Headers with clean and heavy changes in texts of other words, through the query's own report."""
    rng = random.Random(12)
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        around = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
        broken = " ".join(w if j % 3 else f"z{j}" for j, w in enumerate(text.split()))
        rows += [(3 * k, f"{around}\n{text}\n{around}"), (3 * k + 1, f"{around}\n{broken}"), (3 * k + 2, around)]
        want[3 * k] = name
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i in want:
            assert want[i] in got[i].licenses.split(",") and got[i].least_containment >= 0.8
        elif i % 3 == 2 or len(text.split()) > 180:
            assert got[i].n_licenses == 0, got[i]


def test_threads_follow_the_parents(spark):
    rng = random.Random(21)
    lines = [f"line {i} says {i * 7}" for i in range(60)]
    rows, talks = [], {}
    for conv in range(5):
        talks[conv] = []
        for turn in range(60):
            quote = f"> {rng.choice(lines[:turn])}\n" if turn and rng.random() < 0.8 else ""
            talks[conv].append((turn, f"{quote}{lines[turn]}"))
        rows += [(conv, t, x) for t, x in talks[conv]]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread, r.depth) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    deepest = 0
    for conv, talk in talks.items():
        parent = brute_force(talk)
        for t in parent:
            root, depth = t, 0
            while parent[root] is not None:
                root, depth = parent[root], depth + 1
            deepest = max(deepest, depth)
            assert got[conv, t] == (parent[t], root, depth)
    assert deepest >= 4


# -- pipeline
def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    shared = [" ".join(f"p{i}x{j}" for j in range(n)) for i, n in enumerate((51, 55, 60))]  # passages below 400 bytes
    rows = [(i, f"{' '.join(f'a{i}b{j}' for j in range(70))} {shared[i % 3]} {' '.join(f'c{i}d{j}' for j in range(70))}", "en", "web", 7, "q", 1) for i in range(9)]
    rows += [(20, None, None, None, None, None, None), (None, "", "en", None, 0, "q", 2), (21, "lone words here", None, "s", 15, None, 3), (21, "lone words here", None, "s", 15, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row int")
    other = {"labels": spark.createDataFrame([(i, 1, int(i == 2)) for i in range(9)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "a0b1 a0b2 a0b3"), (None, None)], "item_id long, text string")}
    for at, table in (("full", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        for name, df in other.items():
            df.write.parquet(f"{tmp_path}/{at}/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    got = {r.doc_id: r for r in out.where(F.col("doc_id").isNotNull()).collect()}
    assert set(got) == {*range(9), 20, 21}
    for i in range(9):
        head = [f"a{i}b{j}" for j in range(70) if i or j not in (1, 2, 3)]
        assert got[i].text.split() == head + [f"c{i}d{j}" for j in range(70)] and got[i].n_chars == len(got[i].text) and got[i]["a.b"] == "q"
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    mark = storage.written()
    corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert storage.written() == mark + 1  # only the result's table stays
