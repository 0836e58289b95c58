"""Quotation linking against brute force on repeated lines."""

import random
import re

import pytest

from graphwarden.llm import chat

A, B = "one two three four five six seven eight nine ten", "alpha beta gamma delta"
CASES = [
    # the later holder of both lines has more of the quoted words than the first holder of the long one
    ([(1, A), (5, f"{A}\n{B}\nanother line"), (7, f"> {A}\n> {B}\nwell")], {7: 5}),
    # the latest holder of a line isn't always the one with most words
    ([(1, f"{A}\n{B}\nmore"), (5, f"{A}\nother"), (6, "third"), (7, f"> {A}\nhm\n> {B}\nwell")], {7: 1}),
    # a text said twice is answered where it was said last
    ([(1, "yes"), (2, "no"), (3, "yes"), (4, "> yes\nfine"), (5, "yes"), (6, "> yes\nok")], {4: 3, 6: 5}),
    # a sentence out of a line, and one that is wrapped anew
    ([(1, "It rains today. We stay at home then. Bye"), (2, "unrelated"), (3, "> We stay at home then.\nright"), (4, "> We stay\n> at home then.\n> Never heard of\nyes")], {3: 1, 4: 1}),
]


@pytest.mark.parametrize("hot", [0, 64])
@pytest.mark.parametrize(("talk", "want"), CASES)
def test_most_quoted_words(spark, monkeypatch, talk, want, hot):
    monkeypatch.setattr(chat, "HOT", hot)
    got = {r.turn: r.parent_turn for r in chat.formatted(spark.createDataFrame([(1, t, x) for t, x in talk], "conv_id long, turn long, text string")).collect()}
    assert {t: p for t, p in got.items() if p is not None} == want


def pieces(text):
    """Normalised units of a text with their word positions."""
    out = set()
    for pattern in (r"(?!)", r"\n", r"\n[ \t]*\n", r"\n[ \t]*\n|(?<=[.])\s+", r"\n|(?<=[.])\s+"):
        at = 0
        for part in re.split(pattern, text):
            words = re.findall(r"[a-z0-9]+", part.lower())
            if words:
                out.add((" ".join(words), at, at + len(words)))
            at += len(words)
    return out


def brute_force(talk):
    own = {t: {k for k, _, _ in pieces("\n".join(x for x in text.split("\n") if not x.startswith(">")).strip())} for t, text in talk}
    out = {}
    for t, text in talk:
        passages = re.findall(r"(?:^>.*\n?)+", text, re.M)
        votes = {}
        for o in (o for o in own if o < t):
            votes[o] = sum(len({w for k, a, b in pieces(re.sub(r"(?m)^> ?", "", p).rstrip("\n")) if k in own[o] for w in range(a, b)}) for p in passages)
        best = max(votes.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        out[t] = best[0] if best[1] else None
    return out


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_quotes_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(chat, "HOT", hot)
    rng = random.Random(hot)
    lines = ["yes", "thanks a lot", "see you. kind regards", "kind regards", "first thing. second thing is long", "second thing is long"] + [f"line {i} has {i % 4} words. and more {i % 5}" for i in range(12)]
    talks = {}
    for conv in range(6):
        talks[conv] = []
        for turn in sorted(rng.sample(range(-70, 9000), 40)):
            own = [rng.choice(lines + [""]) for _ in range(rng.randint(1, 4))]
            quotes = ["> " + rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 3]))]
            more = ["hm"] + ["> " + rng.choice(lines) for _ in range(rng.choice([0, 0, 2]))]
            talks[conv].append((turn, "\n".join(quotes + own + more)))
    rows = [(c, t, x) for c, talk in talks.items() for t, x in talk]
    got = {(r.conv_id, r.turn): r.parent_turn for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    want = {(c, t): p for c, talk in talks.items() for t, p in brute_force(talk).items()}
    assert got == want and sum(p is not None for p in want.values()) > 100
