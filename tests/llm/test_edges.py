"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphwarden.llm import blocks, bpe, chat, decontam, jaccard, licenses, media, quality, sufdedup, toxicity, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 9000
ROWS = [(1, "Alpha beta gamma delta epsilon zeta eta theta."), (1, "Alpha beta gamma delta epsilon zeta eta theta."), (2, None), (3, ""), (4, "  \n\t "), (None, "x"), (None, None), (5, LONG), (6, LONG), (7, "ΑΒΓ ñandú 日本語 😀\0end")]
CLASHES = ["a.b", "x`y", "cls", "dig", "z", "row", "score", "kept", "wanted", "labels", "h", "k", "null text", "n_chars"]
KEPT = {"documents": 10}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit(5 if c == "n_chars" else "q").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "beta gamma"), (2, None), (3, ""), (None, "theta"), (1, "beta gamma")], "item_id long, text string")


REPORTS = {
    "bpe": lambda d, s: bpe.round_trip_digests(d),
    "decontam": lambda d, s: decontam.report(d, s["bench"]),
    "quality": lambda d, s: quality.classify(d, s["labels"]),
    "media": lambda d, s: media.report(d),
    "jaccard": lambda d, s: jaccard.classes(d),
    "sufdedup": lambda d, s: sufdedup.report(d),
    "licenses": lambda d, s: licenses.report(d),
    "toxicity": lambda d, s: toxicity.classify(d, s["labels"]),
}
STAGES = {
    "reject": lambda d, s: toxicity.reject(d, s["labels"]),
    "keep_one": lambda d, s: jaccard.keep_one(d),
    "deduplicate": lambda d, s: sufdedup.deduplicate(d),
    "decontaminate": lambda d, s: decontam.decontaminate(d, s["bench"]),
    "encode": lambda d, s: bpe.encode(d, bpe.vocabulary()).drop("ids", "n_tokens"),
    "score": lambda d, s: quality.add_score(d, quality.fit(d, s["labels"])).drop("score").withColumn("score", F.lit("q")).select(*blocks.quoted(d.columns)),
}
#: Operators that put their results in the place of the text: what comes back besides the other columns.
WITHOUT_TEXT = {
    "licenses": (lambda d: licenses.scan(d), {"licenses"}),
    "media": (lambda d: media.encode(d), {"n_bytes", "media"}),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_row(name, docs, labels, bench):
    rows = REPORTS[name](docs, {"labels": labels, "bench": bench}).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    by = {}
    for r in rows:  # equal texts, equal values
        by.setdefault(r.doc_id, set()).add(str(r.asDict()))
    assert len(by[1]) == 1


@pytest.mark.parametrize("name", REPORTS)
def test_empty_table(name, docs, labels, bench):
    assert REPORTS[name](docs.limit(0), {"labels": labels.limit(0), "bench": bench.limit(0)}).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, docs, labels, bench):
    out = STAGES[name](docs, {"labels": labels, "bench": bench})
    assert out.columns == docs.columns
    assert all(r["cls"] == "q" and r["null text"] == "q" for r in out.collect())
    assert STAGES[name](docs.limit(0), {"labels": labels, "bench": bench}).collect() == []


@pytest.mark.parametrize("name", WITHOUT_TEXT)
def test_other_columns_pass_where_the_text_goes(name, docs):
    apply, added = WITHOUT_TEXT[name]
    out = apply(docs)
    rest = [c for c in docs.columns if c != "text"]
    assert set(rest) <= set(out.columns) and "text" not in out.columns and set(out.columns) - set(rest) >= added - set(rest)
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS) and all(r["cls"] == "q" and r["null text"] == "q" and r["a.b"] == "q" for r in rows)
    assert apply(docs.limit(0)).collect() == []


def test_values(docs, bench):
    e = hashlib.sha256(b"").hexdigest()
    r = {x.doc_id: x for x in bpe.round_trip_digests(docs).where("doc_id IN (2, 3, 4)").collect()}
    assert all((x.n_tokens, x.ids_sha256, x.decoded_sha256) == (0, e, e) for x in r.values()) and len(r) == 3
    r = {x.doc_id: x for x in decontam.report(docs, bench).collect()}
    assert (r[1].n_words, r[1].n_hit, r[1].n_items) == (8, 3, 2)
    assert r[1].items_sha256 == hashlib.sha256(b"1,null").hexdigest() and r[2].items_sha256 == e
    r = [(x.doc_id, x.class_id, x.class_size, x.n_links) for x in jaccard.classes(docs).collect()]
    assert r.count((1, 1, 2, 1)) == 2 and (5, 5, 2, 1) in r and (6, 5, 2, 1) in r and (2, 2, 1, 0) in r and (4, 4, 1, 0) in r
    r = {x.doc_id: x for x in sufdedup.report(docs).collect()}
    assert (r[5].n_removed, r[5].n_spans, r[5].kept_sha256) == (len(LONG), 1, e) and r[1].n_removed == 0
    kept = [x.doc_id for x in jaccard.keep_one(docs).collect()]
    assert kept.count(1) == 1 and 6 not in kept and {2, 3, 4, 5, 7} <= set(kept)


def test_no_labels(docs, labels):
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert max(r.score for r in toxicity.classify(docs, labels.where("toxic = 1")).collect()) < 0.01


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 1500), (2, "u", "a" * 1500), (2, "u", "a" * 1500), (3, None, None), (4, "u\r\nX: y", "b"), (5, "u", "b"), (None, "u", "c" * 1200), (None, "u", "a" * 1500)], "page_id long, url string, html string")
    rows = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages.withColumn("digest", F.lit("q"))).collect()}
    assert rows == {(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (4, 1, "response", None), (5, 1, "response", None), (None, 1200, "response", None), (None, 1500, "revisit", 2)}
    assert warc.archived(pages.limit(0)).collect() == []
    talk = spark.createDataFrame([(1, 0, "a b"), (1, 0, "a b"), (1, 1, "> a b\nc"), (None, 1, "> a b"), (1, None, None), (2, 0, "")], "conv_id long, turn long, text string")
    out = chat.formatted(talk.withColumn("depth", F.lit("q")).withColumn("own", F.lit("q"))).collect()
    assert len(out) == 6 and [r.parent_turn for r in out if r.turn == 1 and r.conv_id == 1] == [0]
    assert chat.formatted(talk.limit(0)).collect() == []
