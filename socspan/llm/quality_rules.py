"""Quality rules with thresholds learnt from each language and source.

Counts of every text are taken once. For each (lang, source) group a mergeable
sketch holds each rule's values in buckets of bounded relative error (32
buckets to a power of two); merging two sketches is adding their counts, which
is what Spark's partial aggregation does, so the result doesn't depend on how
rows were dealt. A text fails a rule beyond its group's upper or lower fence:

    upper = q75 + SPREADS * max(q75 - q25, least), lower likewise

Groups of fewer than GROUP_LEAST texts use the merged sketch of their language,
or of everything if that is small too. The fences are joined to the rows by
lang and source.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, refuse, short_batches, struct_of, written

SPREADS = 4
GROUP_LEAST = 30
MIN_WORDS = 50  # fixed base rule
MAX_REPEAT_PERCENT = 50  # fixed base rule

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"
#: rule: numerator, denominator, scale, least spread in scaled units, whether low values fail, whether high values fail
RULES = {
    "word_length": ("word_chars", "n_words", 100, 60, True, True),
    "symbols": ("n_symbols", "n_words", 1000, 25, False, True),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False, True),
    "dup_lines": ("n_dup_lines", "n_words", 1000, 20, False, True),
    "upper": ("n_upper", "word_chars", 1000, 25, False, True),
}

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, key, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[key] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of a whole text."""
    text = text or ""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, _repeat_words(words), len(_UPPER.findall(text))


@F.pandas_udf(struct_of(COUNTS))
def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")], dtype="int64")


def with_counts(docs: DataFrame, column: str = "_quality_counts") -> DataFrame:
    """docs with a struct column of the counts of each row's text; only the text goes to Python."""
    short_batches(docs.sparkSession)
    return docs.withColumn(column, _counts(F.col("text")))


def base_failed(c: str = "") -> Column:
    """The fixed rules: too few words, or more than half of them in repeated 3-word windows."""
    return (F.col(c + "n_words") < MIN_WORDS) | (100 * F.col(c + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(c + "n_words"))


def _value(rule: str, c: str = "") -> Column:
    """A rule's value: a ratio in whole units of 1 / scale."""
    top, under, scale, *_ = RULES[rule]
    return F.floor(F.col(c + top) * scale / F.greatest(F.col(c + under), F.lit(1))).cast("long")


def _bucket(v: Column) -> Column:
    """Values below 64 have a bucket each; above, 32 buckets to a power of two."""
    bits = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(bits * 32 + F.call_function("shiftright", v, bits.cast("int")))


def _floor_of(b: Column) -> Column:
    """The least value in a bucket."""
    bits = F.floor((b - 64) / 32) + 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - bits * 32).cast("long"), bits.cast("int")))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) of counts rows that pass the base rules.

    Null lang or source are groups of their own, held as empty strings.
    """
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), _bucket(_value(r)).alias("bucket")) for r in RULES))
    rows = counts.filter(~base_failed()).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.inline(rules))
    return rows.groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, rule, low, high): each group's fences, from its own sketch or a merged one."""

    def quartiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        # a sketch has a bounded number of buckets, so it fits one sorted array
        s = merged.groupBy(*keys, "rule").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))

        def at(num: int) -> str:
            return f"aggregate(s, named_struct('left', cast(ceil(total * {num} / 4.0) as bigint), 'b', cast(-1 as bigint)), (a, x) -> named_struct('left', a.left - x.n, 'b', if(a.left > 0, cast(x.bucket as bigint), a.b)), a -> a.b)"

        return s.select(*keys, "rule", "total", _floor_of(F.expr(at(1))).alias("q1"), _floor_of(F.expr(at(3))).alias("q3"))

    own = quartiles(["lang", "source"])
    lang = quartiles(["lang"]).select("lang", "rule", F.col("total").alias("lang_total"), F.col("q1").alias("lang_q1"), F.col("q3").alias("lang_q3"))
    every = quartiles([]).select("rule", F.col("q1").alias("all_q1"), F.col("q3").alias("all_q3"))
    d = own.join(lang, ["lang", "rule"]).join(every, "rule")

    def chosen(q: str) -> Column:
        return F.when(F.col("total") >= GROUP_LEAST, F.col(q)).when(F.col("lang_total") >= GROUP_LEAST, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))

    rule = F.create_map(*(x for r, v in RULES.items() for x in (F.lit(r), F.array(F.lit(v[3]), F.lit(int(v[4])), F.lit(int(v[5]))))))[F.col("rule")]
    d = d.select("lang", "source", "rule", chosen("q1").alias("q1"), chosen("q3").alias("q3"), rule.alias("r"))
    spread = SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.col("r")[0].cast("long"))
    return d.select("lang", "source", "rule", F.when(F.col("r")[1] == 1, F.col("q1") - spread).alias("low"), F.when(F.col("r")[2] == 1, F.col("q3") + spread).alias("high"))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row a (lang, source) with a map of each rule's fences."""
    f = fences(sketches(counts))
    return f.groupBy(F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source")).agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("_t_fences"))


def judged(rows: DataFrame, limits: DataFrame, c: str = "") -> DataFrame:
    """rows (with lang, source and counts, prefixed c) with _kept: the base rules and the joined fences.

    A group without a text that passes the base rules has no fences; its rows
    fail the base rules anyway. Few groups hold many rows, so the limits are
    the small side of the join and Spark may split a large group's rows.
    """
    ok = ~base_failed(c)
    for r in RULES:
        f, v = F.col("_t_fences")[r], _value(r, c)
        ok = ok & F.coalesce(v >= f["low"], F.lit(True)) & F.coalesce(v <= f["high"], F.lit(True))
    on = (F.coalesce(rows["lang"], F.lit("")) == limits["_t_lang"]) & (F.coalesce(rows["source"], F.lit("")) == limits["_t_source"])
    return rows.join(limits, on, "left").withColumn("_kept", F.coalesce(ok, F.lit(False))).drop("_t_lang", "_t_source", "_t_fences")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    Null text counts as empty and fails; an empty table stays empty; rows with
    equal text, lang and source get equal verdicts. The counts are taken twice
    (for the sketches, then for the verdict) so that no text is shuffled. The
    columns that it adds on the way, such as _quality_counts, are refused; all
    others are kept whatever their names.
    """
    refuse(docs, "_quality_counts", "_kept", "_t_lang", "_t_source", "_t_fences")
    counts = with_counts(docs.select("text", "lang", "source")).select("lang", "source", "_quality_counts.*")
    limits = written(thresholds(counts), "quality-fences")
    return judged(with_counts(docs), limits, "_quality_counts.").filter("_kept").select(*(docs[c] for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    counts = written(with_counts(docs_of(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "_quality_counts.*"), "quality-counts")
    out = judged(counts, thresholds(counts)).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_kept").alias("kept"), "n_upper")
