"""License scans: every place of a license."""

import random

import pyarrow as pa
import pytest

from graphwarden.llm import licenses
from graphwarden.llm.blocks import text_bytes

ALL = licenses.TEMPLATES | licenses.NOTICES


def filler(n, rng=random.Random(3)):
    return " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("gap", [0, 1, 7, 100, 2000])
@pytest.mark.parametrize("name", sorted(ALL))
def test_all_places(name, gap):
    text, want = filler(gap), []
    for _ in range(4):
        at = len(text) + 1
        text += f"\n{ALL[name]}\n{filler(gap)}"
        want.append((at, at + len(ALL[name])))
    scanner = licenses.Scanner({name: ALL[name]})
    (got,) = scanner.scan(*text_bytes(pa.array([text])))
    assert [(n, s) for n, s, _, _ in got] == [(name, 1.0)] * 4
    for (_, _, a, b), (x, y) in zip(got, want):
        # a span has the words of one copy, without the marks around them
        assert a - x <= 1 and a >= x and y - b <= 2 and b <= y


def test_places_are_disjoint_and_hold_the_template():
    rng = random.Random(5)
    scanner = licenses.Scanner(ALL)
    for _ in range(40):
        text, n = filler(9), 0
        for _ in range(rng.randint(1, 5)):
            words = ALL["mit"].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "x"
            text += " " + " ".join(words) + " " + filler(rng.choice([0, 3, 300]))
            n += 1
        got = [x for x in scanner.scan(*text_bytes(pa.array([text])))[0] if x[0] == "mit"]
        assert len(got) == n and all(x[3] <= y[2] for x, y in zip(got, got[1:]))
        for _, _, a, b in got:
            assert licenses.Scanner({"mit": ALL["mit"]}).scan(*text_bytes(pa.array([text[a:b]])))[0][0][1] >= 0.8


def test_places_in_the_query(spark):
    text = f"{ALL['mit']} {filler(500)} {ALL['mit']} {filler(50)} All rights reserved."
    (row,) = licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_licenses, row.licenses, row.least_containment) == (2, "all-rights-reserved,mit", 1.0)
    short, long = row.spans.split(",")
    assert len(short.split(";")) == 1 and len(long.split(";")) == 2
