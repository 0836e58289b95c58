"""License scans: short notices and further license texts."""

import pyarrow as pa
import pytest

from graphwarden.llm import licenses
from graphwarden.llm.blocks import text_bytes

WORDS = " ".join(f"n{i}" for i in range(60))
GRANTS = {
    "mit-warranty": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.',
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "cc0-1.0": "To the extent possible under law, J. Doe has waived all copyright and related or neighboring rights to Foo.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def scan(*texts):
    return licenses.Scanner(licenses.TEMPLATES | licenses.NOTICES).scan(*text_bytes(pa.array(texts, pa.string())))


def test_notices_of_few_words():
    long = f"{WORDS}\n© 2020 Doe. ALL rights, reserved!\n{WORDS}"
    got = scan(long, "All rights reserved.", "all rights", "all rights are reserved here today", None, "", "what reserved all rights may be")
    assert [[x[0] for x in row] for row in got] == [["all-rights-reserved"]] * 2 + [[]] * 5
    (_, share, a, b), = got[0]
    assert share == 1 and long.encode()[a:b] == b"ALL rights, reserved"
    templates = {"one": "Copyleft", "four": "Use it as wanted"}
    got = licenses.Scanner(templates).scan(*text_bytes(pa.array([f"{WORDS} copyleft {WORDS} use it as wanted {WORDS}"])))
    assert [x[0] for x in got[0]] == ["four", "one"]


def test_notices_in_the_query(spark):
    docs = spark.createDataFrame([(1, f"{WORDS}\nAll rights reserved.\n{WORDS}"), (2, WORDS)], "doc_id long, text string")
    assert {r.doc_id: (r.n_licenses, r.licenses) for r in licenses.report(docs).collect()} == {1: (1, "all-rights-reserved"), 2: (0, "")}


@pytest.mark.parametrize("name", GRANTS)
def test_further_licenses(name):
    assert name in [x[0] for x in scan(f"{WORDS} {GRANTS[name]} {WORDS}")[0]]


def test_gpl_is_not_lgpl_or_agpl():
    assert [x[0] for x in scan(f"{WORDS} {licenses.TEMPLATES['gpl']} {WORDS}")[0]] == ["gpl"]
