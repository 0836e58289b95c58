"""URL filters: host and path rules, and for all other addresses a logistic regression on hashed n-grams of
characters of host and path, trained on a small table of labelled addresses.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; path: from there up to
``?``, ``#`` or the end. A null, and an address without ``://``, has an empty host and an empty path, meets no
rule and gets the score of the intercept alone. A rule fits its host and all subdomains if the path starts with
the rule's; of several the longest (host and path together) decides, then the one with the longer host, then
the first. Equal addresses get equal values; addresses of any length are read whole; all columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_arrow, quoted, row_blocks, text_bytes
from .sampling import sigmoid

#: Digits count as one sign: numbers of articles say nothing.
_SIGNS = np.arange(256, dtype=np.uint32)
_SIGNS[48:58] = 48

BITS = 18
SIZES = (3, 4, 5)
THRESHOLD = 0.5
#: Labelled addresses to learn from, at most; a larger table is refused.
MOST = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]

#: Names of hosts to block (gambling, pills, adult pages, cracked software, false prizes, advertisements and
#: trackers, farms of links), and of ordinary ones. Each stands in two frames of an address; both kinds share the
#: frames, so that only names tell them apart.
BLOCKED = """
casino royal-casino casino-bonus online-casino best-casino-slots poker poker-tables win-poker jackpot jackpot-slots free-slots slots-win win-big big-win-lotto
bets free-bets bets-online sports-bets betting best-betting-odds lotto-win lucky-spins free-spins roulette-win bingo-bonus
pills cheap-pills diet-pills pills-online cheap-meds meds-discount viagra cheap-viagra cialis-online pharmacy-pills weight-loss-pills
xxx xxx-videos porn free-porn adult-cams hot-cams live-sex sexy-singles adult-dating nude-pics
warez free-warez crack-keygen keygen serial-keys torrent-movies nulled-scripts hacked-games
prize-winner free-prize claim-prize free-iphone click-here click-now get-rich-quick easy-money payday-loans cheap-loans fast-cash crypto-doubler account-verify login-verify replica-watches cheap-replica
ads ads-server adserver banner-ads popup-ads click-ads ads-network ads-tracking track-ads tracker pixel-tracker click-tracker
spam spam-links spam-blog bulk-spam link-farm farm-links content-farm seo-farm backlinks cheap-backlinks
"""
ALLOWED = """
garden river mountain history science music painting theatre museum library school student teacher university journal research paper letter weather winter summer kitchen bakery
bread cheese coffee family children parents health doctor hospital nurse village city region nation country island ocean harbor bridge station railway airport travel hotel
camera picture gallery cinema radio method number algebra geometry physics chemistry biology language grammar dictionary translation poetry novel author publisher
computer software hardware network database engineer designer architect builder furniture carpenter market grocery farmer harvest forest animal horse birds climate energy
justice court parliament election minister senate council budget statistics census archive heritage church temple festival dance orchestra football tennis cycling running chess
morning-post daily-press travel-notes evening-news city-news world-atlas open-maps train-times photo-forum math-lib spark-guide data-notes home-cooking old-books bird-watch tree-house
the-other another there these thought sheet stand land inner thesis onward rather nothing something without together weatherman brother mother father leather feather gather
"""
FRAMES = """
https://www.*.com/en/12 http://*.org/en/34/ https://blog.*.net/de/5.html http://m.*.com/fr/78?page=2&ref=x https://*.info/ http://www.*.org/es/9#top https://en.*.net/articles/1 http://m.*.net/en/2?utm_source=feed
https://*.com/fr/41.html http://blog.*.com/es/7/ https://m.*.org/de/60 http://www.*.info/index.html https://*.co/en/8?id=3
"""


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in table of labelled addresses: url, label (1: block)."""
    frames, rows = FRAMES.split(), []
    for label, names in ((1, BLOCKED.split()), (0, ALLOWED.split())):
        for k, name in enumerate(names):
            rows += [(frames[j % len(frames)].replace("*", name), label) for j in (k, k + len(frames) // 2)]
    return spark.createDataFrame(rows, "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def deciding(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides; nulls where none fits. For tens of rules: each is a condition."""
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(str(r)), -len(r.host)))
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith(F.lit("." + r.host))) & path.startswith(F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(str(r))).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def grams(data: np.ndarray, offs: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of a block's texts, each text between a start and an end sign."""
    n = len(offs) - 1
    size = np.diff(offs) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    signs = np.zeros(at[-1], np.uint32)
    signs[at[:-1]], signs[at[1:] - 1] = 257, 258
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    signs[inner] = _SIGNS[data]
    row = np.repeat(np.arange(n), size)
    left = at[1:][row] - np.arange(at[-1])
    rows, buckets, h = [], [], np.full(at[-1], salt, np.uint32)
    for k in range(max(SIZES)):
        h = h[: max(0, at[-1] - k)] * np.uint32(0x01000193) + signs[k:]
        if k + 1 in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            mixed = (mixed ^ (mixed >> np.uint32(13)) ^ np.uint32(k * 0x3779)) >> np.uint32(32 - BITS)
            fits = left[: len(h)] > k
            rows.append(row[: len(h)][fits])
            buckets.append(mixed[fits].astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the n-grams; those of host and of path each have length 1 together."""
    out = []
    for salt, column in ((17, host), (91, path)):
        row, bucket = grams(*text_bytes(column), salt)
        key, count = np.unique((row << BITS) | bucket, return_counts=True)
        row = key >> BITS
        norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(column)))
        out.append((row, key & ((1 << BITS) - 1), count / norm[row]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        row, bucket, value = features(host, path)
        empty = (text_bytes(host)[1][1:] == text_bytes(host)[1][:-1]) & (text_bytes(path)[1][1:] == text_bytes(path)[1][:-1])
        total = np.bincount(row, self.weights[bucket] * value, len(host))
        return sigmoid(np.where(empty, 0.0, total) + self.intercept)


def train(host: pa.Array, path: pa.Array, labels: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> Model:
    """Full-batch gradient descent with Adagrad steps; without addresses of both labels everything is allowed."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), -40.0)
    row, bucket, value = features(host, path)
    ids, col = np.unique(bucket, return_inverse=True)
    w, b, y = np.zeros(len(ids)), 0.0, labels.astype(float)
    g2, b2 = np.full(len(ids), 1e-8), 1e-8
    for _ in range(rounds):
        e = (sigmoid(np.bincount(row, w[col] * value, len(y)) + b) - y) / len(y)
        g = np.bincount(col, e[row] * value, len(ids)) + l2 * w / len(y)
        g2 += g * g
        b2 += e.sum() ** 2
        w -= 0.2 * g / np.sqrt(g2)
        b -= 0.2 * e.sum() / np.sqrt(b2)
    weights = np.zeros(1 << BITS)
    weights[ids] = w
    return Model(weights, float(b))


def fit(table: DataFrame, most: int = MOST) -> Model:
    """A model of a small table of labelled addresses (url, label 0 or 1); other labels and nulls are left out."""
    host, path = parts(F.col("url"))
    rows = table.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"))
    got = rows.orderBy("host", "path", "label").limit(most + 1).toArrow()
    if len(got) > most:
        raise ValueError(f"over {most} labelled addresses: choose some, or raise `most`")
    return train(got["host"].combine_chunks(), got["path"].combine_chunks(), got["label"].to_numpy())


def judge(pages: DataFrame, model: Model, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits), score (the model's, of all addresses) and verdict;
    columns of these names are replaced."""
    added = ("host", "path", "rule", "score", "verdict")
    names = [c for c in pages.columns if c.lower() not in added]
    host, path = parts(quoted([url])[0])
    cut = pages.select(*quoted(names), host.alias("host"), path.alias("path"))
    schema = T.StructType([*cut.schema.fields, T.StructField("score", T.DoubleType(), False)])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever was learnt from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, "path"):
                score = shared.value.score(block.column("host"), block.column("path"))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(score)], names=[*block.schema.names, "score"])

    scored = in_arrow(cut, run, schema)
    rule, verdict = deciding(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(*quoted(names), "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, by_score).alias("verdict"))


def allowed(pages: DataFrame, model: Model, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose address is allowed, with their own columns."""
    kept = "_address"
    while kept in {c.lower() for c in pages.columns}:
        kept += "_"
    held = pages.select(F.struct(*quoted(pages.columns)).alias(kept), quoted([url])[0].alias("url"))
    return judge(held, model, rules).where(F.col("verdict") == "allow").select(f"{kept}.*")


def report(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score."""
    model = fit(labelled(pages.sparkSession))
    return judge(pages.select("page_id", "url"), model, rules).select("page_id", "host", "path", "rule", "verdict", "score")
