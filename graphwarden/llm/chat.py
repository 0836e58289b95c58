"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` that it begins with (blanks between them allowed). Level 0
is the message's own text; runs of lines of one level are passages. A text's units are the whole, its
paragraphs, lines, sentences and the sentences' parts in each line. Units of own texts are indexed by
digests of their normalised words under every message that holds them; units of quoted passages look
their digests up in the index of their conversation. Only digests that are quoted stay in the index.

A message answers the earlier message from which most words of its outermost quotes come (ties: the
later one): the words of a passage that lie in any unit which that message holds, each counted once. All
earlier holders take part. A digest with more than ``HOT`` holders isn't joined to each of them: holders
with the same set of such digests are one class, and the latest earlier member stands for its class,
since all members are equal in these words. Messages that hold a rarer unit too are counted one by one.

A message that quotes nothing known starts a thread. ``thread`` is the turn that started
the thread and ``depth`` the number of answers above; ordering by (conv_id, thread, turn) puts every
answer after what it answers. Roots are found by pointer doubling: joins on (conv_id, turn), a number of
rounds logarithmic in the depth, and no conversation is ever gathered in one place.

Turns are integers. Null and empty texts have no lines. Without a conversation or turn a message can't be linked. Messages
with the same (conv_id, turn) share what is found for any of them. Very long texts are split into lines
like others; extra columns are passed through, but those named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

MARKS = r"^(?:[ \t]?>)+"
PARAGRAPH = r"\n[ \t]*\n"
SENTENCE = r"(?<=[.!?…])\s+|(?<=[。！？])"
#: A whole text, its lines, paragraphs, sentences (over line ends) and their parts in each line.
UNITS = (r"(?!)", r"\n", PARAGRAPH, f"{PARAGRAPH}|{SENTENCE}", rf"\n|{SENTENCE}")
#: Digests with more holders than this in a conversation are credited by class.
HOT = 64
BITS = 6
ATTRIBUTION = r"(?i)^.*\b(?:wrote|schrieb|escribió|a écrit)\s*:\s*$"
_RESULTS = ("parent_turn", "thread", "depth", "n_quotes", "n_linked")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("body")
        ),
    )


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with own (the text without quotes and their attribution lines) and passages
    (array<struct<level, body>> of the quotes)."""
    rows = messages.withColumn("_lines", _lines(F.col(text)))
    rows = rows.withColumn(
        "_lines",
        F.filter("_lines", lambda x, i: ~((x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.try_element_at("_lines", i + 2)["level"], F.lit(0)) > 0))),
    )
    # a passage begins where the level changes
    begins = F.filter(
        F.transform("_lines", lambda x, i: F.when((x["level"] > 0) & ((i == 0) | (F.col("_lines")[F.greatest(i - 1, F.lit(0))]["level"] != x["level"])), i)), lambda i: i.isNotNull()
    )
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    rows = rows.withColumns({"_begins": begins, "own": F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"))})
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size("_lines")))
    passages = F.transform(
        F.arrays_zip(F.col("_begins").alias("a"), ends.alias("b")),
        lambda p: F.struct(
            F.col("_lines")[p["a"]]["level"].alias("level"),
            F.array_join(
                F.transform(F.filter(F.slice("_lines", p["a"] + 1, p["b"] - p["a"]), lambda x: x["level"] == F.col("_lines")[p["a"]]["level"]), lambda x: x["body"]), "\n"
            ).alias("body"),
        ),
    )
    return rows.withColumn("passages", F.when(F.size("_begins") > 0, passages).otherwise(F.array().cast("array<struct<level:int,body:string>>"))).drop("_lines", "_begins")


def _units(body: Column) -> Column:
    """array<struct<key, s, e>>: the normalised units of a body and the words [s, e) of it that they are."""

    def placed(pattern: str) -> Column:
        parts = F.filter(F.transform(F.split(body, pattern), _normal), lambda x: x != "")
        # one entry for each word; the first one of a part names it, and its position is the part's
        words = F.flatten(F.transform(parts, lambda x: F.transform(F.split(x, " "), lambda w, j: F.struct(F.when(j == 0, x).alias("key")))))
        at = F.transform(words, lambda x, i: F.struct(x["key"].alias("key"), i.alias("s"), (i + F.size(F.split(x["key"], " "))).alias("e")))
        return F.filter(at, lambda x: x["key"].isNotNull())

    return F.array_distinct(F.concat(*(placed(x) for x in UNITS)))


def _keys(body: Column) -> Column:
    """Distinct normalised units of a body."""
    return F.array_distinct(F.filter(F.transform(F.concat(*(F.split(body, x) for x in UNITS)), _normal), lambda x: x != ""))


def _covered(spans: DataFrame, by: str) -> DataFrame:
    """conv_id, turn, ``by``, w: how many words of the message's passages lie in any of the spans."""
    sets = spans.groupBy("conv_id", "turn", "p", "passage", by).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("x"))
    words = F.aggregate(
        "x", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n")), lambda a: a["n"],
    )
    return sets.select("conv_id", "turn", by, words.alias("w")).groupBy("conv_id", "turn", by).agg(F.sum("w").alias("w"))


def _nodes(turn: str, levels: int) -> Column:
    """The nodes of a turn in a tree whose nodes have 2**BITS children; the root has what is left."""
    t = F.col(turn).cast("long")
    return F.inline(
        F.array(*(
            F.struct(F.lit(k).alias("at"), (F.shiftright(t, BITS * (k + 1)) if k + 1 < levels else F.lit(0).cast("long")).alias("node"), F.shiftright(t, BITS * k).alias("child"))
            for k in range(levels)
        ))
    )


def _latest(votes: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, turn, from_turn, w: each vote (conv_id, turn, class, w) with its class's latest member before
    the turn. At each level of a tree of turns, only one node's children are looked at, so that neither a
    class nor a conversation is sorted in one place."""
    lo, hi = members.agg(F.min("from_turn").cast("long"), F.max("from_turn").cast("long")).first()
    levels = 1
    while (hi >> BITS * (levels - 1)) - (lo >> BITS * (levels - 1)) >= 1 << BITS:
        levels += 1
    tree = members.select("conv_id", "class", "from_turn", _nodes("from_turn", levels)).groupBy("conv_id", "class", "at", "node", "child").agg(F.max("from_turn").alias("last"))
    tree = tree.groupBy("conv_id", "class", "at", "node").agg(F.collect_list(F.struct("child", "last")).alias("children"))
    asked = votes.select("*", _nodes("turn", levels)).join(tree, ["conv_id", "class", "at", "node"])
    last = F.array_max(F.transform(F.filter("children", lambda x: x["child"] < F.col("child")), lambda x: x["last"]))
    best = asked.select("conv_id", "turn", "class", "w", last.alias("from_turn")).where("from_turn IS NOT NULL")
    return best.groupBy("conv_id", "turn", "class").agg(F.max("from_turn").alias("from_turn"), F.max("w").alias("w")).drop("class")


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_quotes, n_linked of messages with quotes, from parsed rows."""
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = materialize(
        known.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("p", "passage")).select(
            "conv_id", "turn", "p", F.col("passage.level").alias("level"), _digest(F.col("passage.body")).alias("passage"), F.explode_outer(_units(F.col("passage.body"))).alias("unit")
        ).select("conv_id", "turn", "p", "level", "passage", _digest(F.col("unit.key")).alias("key"), "unit.s", "unit.e"), "quotes",
    )
    if quoting.isEmpty():
        return quoting.select("conv_id", "turn", F.col("turn").alias("parent_turn"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"))
    index = known.select("conv_id", F.col("turn").alias("from_turn"), F.explode(_keys(F.col("own"))).alias("key")).withColumn("key", _digest(F.col("key")))
    held = materialize(index.join(quoting.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").distinct(), "holders")
    keys = held.groupBy("conv_id", "key").agg(F.min("from_turn").alias("first"), (F.count(F.lit(1)) > HOT).alias("hot"))
    found = materialize(quoting.join(keys, ["conv_id", "key"], "left").withColumn("known", F.coalesce(F.col("first") < F.col("turn"), F.lit(False))), "found")
    outer = found.groupBy("conv_id", "turn").agg(F.min("level").alias("least"))
    asked = found.join(outer, ["conv_id", "turn"]).where("known AND level = least").select("conv_id", "turn", "p", "passage", "key", "s", "e", "hot")
    rare, hot = asked.where("NOT hot"), asked.where("hot")
    spans = rare.join(held, ["conv_id", "key"]).where("from_turn < turn").select("conv_id", "turn", "p", "passage", "from_turn", "s", "e")
    if hot.isEmpty():
        votes = _covered(spans, "from_turn")
    else:
        spans = materialize(spans, "spans")
        held = held.join(keys.where("hot"), ["conv_id", "key"], "left_semi")
        more = spans.select("conv_id", "turn", "from_turn").distinct().join(hot, ["conv_id", "turn"]).join(held, ["conv_id", "from_turn", "key"], "left_semi")
        members = held.groupBy("conv_id", "from_turn").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        members = materialize(members.withColumn("class", _digest(F.array_join(F.transform("keys", F.hex), ""))), "classes")
        classes = members.groupBy("conv_id", "class").agg(F.first("keys").alias("keys")).select("conv_id", "class", F.explode("keys").alias("key"))
        common = _covered(hot.join(classes, ["conv_id", "key"]), "class")
        votes = _covered(spans.unionByName(more.select(spans.columns)), "from_turn").unionByName(_latest(common, members))
    parent = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("w", "from_turn"))["from_turn"].alias("parent_turn"))
    counts = found.groupBy("conv_id", "turn").agg(F.count_distinct("p").alias("n_quotes"), F.count_distinct(F.when(F.col("known"), F.col("p"))).alias("n_linked"))
    return counts.join(parent, ["conv_id", "turn"], "left").select("conv_id", "turn", "parent_turn", "n_quotes", "n_linked")


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of messages with a parent, by pointer doubling."""
    state = materialize(parents.where("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left")
        if joined.where("far IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
        state = materialize(joined.select("conv_id", "turn", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def formatted(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, text and more) with the text replaced by the message's own words, and
    parent_turn, thread, depth, n_quotes, n_linked."""
    rows = parsed(messages.drop(*_RESULTS, "own", "passages", "_lines", "_begins"))
    found = links(rows)
    found = materialize(found, "replies")
    placed = found.join(threads(found), ["conv_id", "turn"], "left")
    keep = [F.col("own").alias(c) if c == "text" else F.col(c) for c in rows.columns if c not in ("own", "passages")]
    out = rows.select(*keep).join(placed, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", zero), "n_quotes": F.coalesce("n_quotes", zero), "n_linked": F.coalesce("n_linked", zero)})
