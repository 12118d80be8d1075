"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1 bits. For each bit a binary linear
classifier over hashed character 1-, 2- and 3-grams tells the languages with +1
from those with -1: its weights are the log odds of a gram in either half, from
counts that Spark sums over all training rows. A text's margins are decoded to
the codeword of least weighted logistic loss; a bit weighs as much as it
separates its halves on the language profiles. Where the runner-up's loss is
close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, refuse, short_batches, struct_of

GRAM_BITS = 12
GRAMS = 1 << GRAM_BITS
#: Bound of the model that the driver holds: this many languages at most, GRAMS counts each. More tags than that aren't languages, and fitting refuses them.
LANGS_MOST = 2000
UNIT = 1_000_000  # a text's grams are counted in parts of this, so each text weighs the same and sums are whole numbers
AMBIGUOUS = 0.15  # of the mean loss of a bit
SHARPNESS = 12.0  # of the score

_LETTER = regex.compile(r"\p{L}")  # letters only: no superscripts, fractions or circled numbers


def grams(text: str) -> np.ndarray:
    """Counts of the hashed grams of a whole text in lower case; runs of other characters than letters count as they are."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    a = np.where((a < 97) | ((a > 122) & (a < 0xC0)), np.uint32(32), a).astype(np.uint32)
    out = np.zeros(GRAMS, np.int64)
    h = a * np.uint32(0x9E3779B1)
    for k in range(3):
        if k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[k:] * np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(32 - GRAM_BITS), minlength=GRAMS)
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits up to seven languages, beyond that a fixed random code of 10 log2 n bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], float).T
    rng = np.random.default_rng(n)
    bits = int(np.ceil(10 * np.log2(n)))
    code = np.array([rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0)) for _ in range(bits)]).T
    if len(np.unique(code, axis=0)) < n:
        raise ValueError("two languages share a codeword")
    return code


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            x = grams(text)
            if n := int(x.sum()):
                sums[lang] = sums.get(lang, 0) + x * UNIT // n
    for lang, x in sums.items():
        at = np.flatnonzero(x)
        yield pd.DataFrame({"lang": lang, "gram": at, "n": x[at]})


class Model:
    """Codewords, weights and bit weights of the learnt languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        if not langs:
            return
        freq = (counts + 0.5 * UNIT / GRAMS) / (counts + 0.5 * UNIT / GRAMS).sum(axis=1, keepdims=True)
        plus, minus = ((self.code == s).T.astype(float) for s in (1, -1))
        mean = lambda side: (side @ freq + 1e-9) / (side.sum(axis=1, keepdims=True) + 1e-9 * GRAMS)
        self.weights = np.log(mean(plus)) - np.log(mean(minus)) if len(langs) > 1 else np.zeros((1, GRAMS))
        own = self.code * (freq @ self.weights.T)  # how far each language's profile lies on its side of each bit
        self.scale = np.maximum(own.mean(axis=0), 1e-12)
        trust = np.clip((own / self.scale).min(axis=0), 0.05, None)
        self.trust = trust / trust.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0, False
        x = grams(text)
        margin = self.weights @ x / (x.sum() * self.scale)
        loss = np.logaddexp(0, -2 * self.code * margin) @ self.trust
        best = int(loss.argmin())
        others = np.delete(loss, best)
        return self.langs[best], float(1 / np.exp(-SHARPNESS * (loss - loss[best])).sum()), bool(len(others) and others.min() - loss[best] < AMBIGUOUS)


def fit(docs: DataFrame) -> Model:
    """The model of docs (text, lang); rows without either are left out. No rows give a model without languages.

    The driver gets sums for each (language, gram), LANGS_MOST x GRAMS at most.
    """
    short_batches(docs.sparkSession)
    rows = docs.select("text", "lang").filter("text is not null and lang is not null")
    sums = rows.mapInPandas(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("x")).limit(LANGS_MOST + 1).collect()
    if len(got) > LANGS_MOST:
        raise ValueError(f"more than {LANGS_MOST} languages")
    langs = sorted(r["lang"] for r in got)
    counts = np.zeros((len(langs), GRAMS))
    for r in got:
        counts[langs.index(r["lang"]), [g["gram"] for g in r["x"]]] = [g["n"] for g in r["x"]]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the struct _language (lang_pred, score, ambiguous); only the text goes to Python.

    "und" with score 0 for a null text, one without a letter, or where no language was learnt.
    Equal texts get equal predictions; long ones are read whole; an empty table
    stays empty. A column _language is refused.
    """
    refuse(docs, "_language")
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(struct_of("lang_pred string, score double, ambiguous boolean"))
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn("_language", told(F.col("text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the four fifths that aren't held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = docs_of(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(fold != 0))
    return predict(docs.drop("lang"), model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "_language.*")
