"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. What they say
about a text is one of 3^8 patterns, so Spark counts the patterns over all
rows and expectation-maximisation of the labellers' accuracies runs on those
counts. The posterior of its pattern then labels each text, and a linear
scorer over hashed features is fitted to these labels: its weights are log
odds from posterior-weighted counts, which Spark sums over all rows too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, refuse, short_batches, struct_of, written
from .quality_rules import counts_of

LABELLERS = 8
PATTERNS = 3**LABELLERS  # bound of what EM gets
FEATURES = 1 << 13
UNIT = 1_000_000
ROUNDS = 100
KEEP = 0.3
PATTERNS_HELD = 500  # feature sums that a task holds, of 64 kB each
SHORT = 20  # words; shares of words say nothing about shorter texts
GOOD, BAD, NONE = 1, 0, 2


def _vote(value: float, bad: float, good: float) -> int:
    """Bad at or beyond one limit, good at or within the other, nothing between them."""
    if bad > good:
        return BAD if value >= bad else GOOD if value <= good else NONE
    return BAD if value <= bad else GOOD if value >= good else NONE


def _stats(text: str) -> list[float]:
    n, chars, symbols, dup, repeat, upper = counts_of(text)
    words = text.split()
    lines = text.count("\n") + 1
    n = max(n, 1)
    small = sum(len(w) <= 3 and w.isalpha() for w in words)
    ends = sum(w[-1] in ".,;:?" for w in words)
    return [symbols / n, repeat / n, upper / max(chars, 1), n, dup / lines, small / n, ends / n, len(set(words)) / n]


#: Limits of the labellers on _stats(): at which they say bad, and good.
LIMITS = [(0.1, 0.02), (0.3, 0.1), (0.3, 0.1), (2, 50), (0.4, 0.2), (0.02, 0.1), (0.005, 0.03), (0.15, 0.4)]


def votes(stats: list[float]) -> int:
    """The pattern of all votes, as a number to base 3."""
    out = 0
    for k, (s, (bad, good)) in enumerate(zip(stats, LIMITS, strict=True)):
        out = out * 3 + (NONE if k > 4 and stats[3] < SHORT else _vote(s, bad, good))
    return out


def _digits(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 for k in reversed(range(LABELLERS))], axis=1)


def posteriors(counts: dict[int, int]) -> np.ndarray:
    """P(good) of each pattern, by EM over the counted patterns.

    Each labeller has its own chance of each vote given good and given bad.
    Kinds of bad text are caught by one or two labellers each, so EM begins
    with any vote for bad as a sign of a bad text; begun at the majority's
    vote it would settle on bad texts of one kind only. A text on which nobody
    votes gets the share of good ones.
    """
    seen = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in seen.tolist()], float)
    says = np.eye(3)[_digits(np.arange(PATTERNS))]  # pattern, labeller, vote
    begin = np.where(says[:, :, BAD].any(axis=1), 0.1, 0.9)
    if not len(seen):
        return begin
    p = begin[seen]
    for _ in range(ROUNDS):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        chance = []
        for w in (n * p, n * (1 - p)):
            c = np.einsum("p,plv->lv", w, says[seen]) + [[1.0, 1.0, 1.0]]
            chance.append(np.log(c / c.sum(1, keepdims=True)))
        # Labellers must do better than chance: a vote for good never speaks for bad
        odds = chance[0] - chance[1]
        odds[:, GOOD], odds[:, BAD], odds[:, NONE] = np.maximum(odds[:, GOOD], 0), np.minimum(odds[:, BAD], 0), 0
        every = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", says, odds), -30, 30)))
        if np.abs(every[seen] - p).max() < 1e-9:
            break
        p = every[seen]
    return every


_CLASS = np.full(128, 8, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:"]], _CLASS[[ord(c) for c in "#*$%&|<>"]], _CLASS[[ord(c) for c in "!?"]] = 4, 5, 6
_BINS = [(0.01, 0.05, 0.1, 0.3), (0.05, 0.1, 0.3, 0.6), (0.02, 0.1, 0.3, 0.6), (10, 30, 50, 200), (0.1, 0.2, 0.4), (0.02, 0.1, 0.2), (0.005, 0.03, 0.3), (0.15, 0.3, 0.5)]


def features(text: str, stats: list[float]) -> np.ndarray:
    """Hashed features of a whole text: shares of 4-grams of character classes, and the range of each statistic."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    c = np.where(a < 128, _CLASS[np.minimum(a, 127)], np.uint8(1)).astype(np.int64)
    x = np.zeros(FEATURES, np.int64)
    if len(c) > 3:
        g = ((c[:-3] * 9 + c[1:-2]) * 9 + c[2:-1]) * 9 + c[3:]
        x += np.bincount((g * 2654435761 >> 7) % FEATURES, minlength=FEATURES) * UNIT // len(g)
    for k, (s, bins) in enumerate(zip(stats, _BINS, strict=True)):
        x[zlib.crc32(b"%d:%d" % (k, np.searchsorted(bins, s))) % FEATURES] += UNIT
    return x


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature sums of a task's texts by vote pattern; feature -1 counts the texts."""
    sums: dict[int, np.ndarray] = {}

    def send():
        for pattern, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"pattern": pattern, "feature": at - 1, "n": x[at]})
        sums.clear()

    for pdf in batches:
        for text in pdf["text"]:
            stats = _stats(text)
            x = sums.setdefault(votes(stats), np.zeros(FEATURES + 1, np.int64))
            x[0] += 1
            x[1:] += features(text, stats)
        if len(sums) > PATTERNS_HELD:
            yield from send()
    yield from send()


class Model:
    """Posterior of each vote pattern, and the weight of each hashed feature."""

    def __init__(self, posterior: np.ndarray, good: np.ndarray, bad: np.ndarray):
        self.posterior = posterior
        smooth = UNIT / 100
        self.weights = np.log((good + smooth) / (good.sum() + smooth * FEATURES)) - np.log((bad + smooth) / (bad.sum() + smooth * FEATURES))
        share = (good.sum() + UNIT) / (good.sum() + bad.sum() + 2 * UNIT)
        self.bias = np.log(share / (1 - share))

    def score(self, text: str | None) -> tuple[float, float]:
        stats = _stats(text or "")
        z = self.bias + self.weights @ features(text or "", stats) / UNIT
        return float(self.posterior[votes(stats)]), float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame) -> Model:
    """The model of all texts of docs; null counts as empty. The driver gets PATTERNS and FEATURES rows at most.

    One pass sums the features by pattern, so that the posteriors, which EM
    finds from the patterns' counts afterwards, can weigh the sums.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_summed, "pattern int, feature int, n long")
    sums = written(sums.groupBy("pattern", "feature").agg(F.sum("n").alias("n")), "quality-sums")
    posterior = posteriors({r[0]: r[1] for r in sums.filter("feature = -1").select("pattern", "n").collect()})
    parts = spark.createDataFrame([(i, round(1000 * float(x))) for i, x in enumerate(posterior)], "pattern int, part int")
    weighed = sums.filter("feature >= 0").join(parts, "pattern").withColumn("n", F.col("n").cast("decimal(24,0)"))
    good, bad = np.zeros((2, FEATURES))
    for r in weighed.groupBy("feature").agg(F.sum(F.col("n") * F.col("part")), F.sum(F.col("n") * (1000 - F.col("part")))).collect():
        good[r[0]], bad[r[0]] = float(r[1]) / 1000, float(r[2]) / 1000
    return Model(posterior, good, bad)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the struct _quality: weak_label (the labellers' posterior) and score (the scorer's), both from 0 to 1.

    Null text counts as empty; equal texts get equal scores; long texts are
    read whole; an empty table stays empty. A column _quality is refused.
    """
    refuse(docs, "_quality")
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(struct_of("weak_label double, score double"))
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t) for t in texts], columns=["weak_label", "score"])

    return docs.withColumn("_quality", scored(F.col("text")))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weak label and score; kept at a score of KEEP or more."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fit(docs)).select("doc_id", "_quality.*")
    return written(out, "quality-scores").withColumn("kept", F.col("score") >= KEEP)
