"""Which rows the classifiers learn from."""

import pytest
from pyspark.sql import functions as F

from graphwarden.llm import quality, sampling, toxicity




def rows_of(spark, docs, labels, **more):
    table, counts = sampling.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", more.pop("per_class", 10), F.lit(True), **more)
    return [(r["doc_id"], r["text"], r["label"]) for r in table.to_pylist()], counts


def test_rows_that_fit_fill_the_sample(spark):
    """Long texts take no places: with as many long texts as short ones the sample is still full."""
    docs = [(i, "x" * (100_000 if i % 2 else 10)) for i in range(60)]
    got, counts = rows_of(spark, docs, [(i, 1) for i in range(60)], per_class=25)
    assert len(got) == 25 and all(len(t) == 10 for _, t, _ in got) and counts == {1: 60}


@pytest.mark.parametrize("budget, n", [(16 << 20, 8), (150_000, 3), (10, 1)])
def test_a_label_of_long_texts_only(spark, budget, n):
    docs = [(i, "y" * (40_000 + 5_000 * i)) for i in range(8)] + [(100 + i, "z") for i in range(3)]
    got, _ = rows_of(spark, docs, [(i, 1) for i in range(8)] + [(100 + i, 0) for i in range(3)], long_bytes=budget)
    assert sorted(i for i, _, label in got if label == 1) == list(range(n)) and len([1 for *_, label in got if label == 0]) == 3


def test_ids_count_once(spark):
    docs = [(1, "bb"), (1, "a"), (1, "c"), (2, None), (None, "x"), (3, "q"), (3, "q")]
    got, counts = rows_of(spark, docs, [(1, 0), (1, 1), (2, 0), (3, 1), (9, 1), (None, 1), (4, None), (5, 7)])
    assert sorted(got) == [(1, "a", 1), (2, None, 0), (3, "q", 1)] and counts == {0: 1, 1: 3}
    assert rows_of(spark, docs, [])[0] == [] and rows_of(spark, [], [(1, 0)])[0] == []


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_positives_of_long_texts_are_found(spark, module, label):
    """All positives are over the bound, as in the case that scored every text 0."""
    docs, labels = [], []
    for i in range(150):
        bad = i % 3 == 0
        docs.append((i, ("you horrid beast " if bad else "the quiet garden ") * (3000 if bad else 5)))
        labels.append((i, int(bad)))
    got = module.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 5 and all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in held)
