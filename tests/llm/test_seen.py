"""What tasks remember is bounded and decides nothing."""

import pytest

from graphwarden.llm import blocks, jaccard, sufdedup, warc


def test_forgets_when_full():
    seen = blocks.Seen(3)
    assert seen.new("aab") == [True, False, True] and seen.new("ca") == [True, False]
    assert seen.new("d") == [True] and seen.new("ab") == [False, True] and len(seen.values) <= 3


@pytest.mark.parametrize("most", [1, 2])
def test_results_do_not_hang_on_memory(spark, monkeypatch, most):
    texts = ["the same long text about nothing in particular " * 12, "another text " * 40, "short"]
    docs = spark.createDataFrame([(i, texts[i % 3] if i % 5 else texts[0] + f" end {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    pages = spark.createDataFrame([(i, f"http://e/{i}", texts[i % 3] * 3) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    run = lambda: [sorted(map(str, x.collect())) for x in (jaccard.classes(docs), sufdedup.report(docs), warc.archived(pages))]
    want = run()
    for module in (jaccard, sufdedup, warc):
        monkeypatch.setattr(module, "Seen", lambda: blocks.Seen(most))
    assert run() == want
