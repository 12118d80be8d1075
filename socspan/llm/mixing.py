"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked: in turn each
margin's cells are scaled to the margin's target share, until no factor
differs from 1 by more than TOLERANCE. A cell's weight over its share of
tokens, scaled so that KEEP of all tokens are expected to stay, is the
probability with which its documents are drawn. Only DataFrame functions are
used.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, refuse, written

TOPICS = 8
TOLERANCE = 1e-6
WAIT, FALL = 5, 0.98  # raking ends where WAIT rounds leave more than FALL of the largest factor's distance from 1
KEEP = 0.8
#: A margin's target share is proportional to its share of tokens raised to this.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
SEED = "mix-1"

OTHER = "other"

_LOOK = "aggregate(split(text, '[ \\t-\\r]+'), named_struct('n', 0L, 'w', ''), (a, w) -> named_struct('n', a.n + if(w = '', 0L, 1L), 'w', if(length(w) > length(a.w) or (length(w) = length(a.w) and w > a.w), w, a.w)))"


def chance(doc_id: str = "doc_id") -> Column:
    """A number from 0 to 2^32 - 1 that depends on doc_id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 8), 16, 10).cast("long")


def look(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """docs with the struct _mix (source, lang, topic, tokens) of each row.

    Tokens are words. topic names a column of docs. Without one, texts are put
    into TOPICS groups by the hash of their longest word: groups that say
    nothing of content, but make the third margin for tables without topics.
    Nulls count as '' (of a topic, as OTHER). Columns _mix and _look are refused.
    """
    if bad := {"_mix", "_look"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(bad)}")
    group = (F.conv(F.substring(F.md5("_look.w"), 1, 4), 16, 10).cast("int") % TOPICS).cast("string")
    t = F.coalesce(F.col(topic).cast("string"), F.lit(OTHER)) if topic else group
    d = docs.withColumn("_look", F.coalesce(F.expr(_LOOK), F.expr("named_struct('n', 0L, 'w', '')")))
    return d.withColumn("_mix", F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), t.alias("topic"), F.col("_look.n").alias("tokens"))).drop("_look")


def targets(cells: DataFrame) -> DataFrame:
    """(margin, value, target) where no targets are given: each margin's shares raised to its power, and scaled to add up to 1."""
    out = None
    for margin, power in POWERS.items():
        m = cells.groupBy(F.col(margin).cast("string").alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
        m = m.crossJoin(m.agg(F.sum("p").alias("all"))).select(F.lit(margin).alias("margin"), "value", (F.col("p") / F.col("all")).alias("target"))
        out = m if out is None else out.unionByName(m)
    return out


def present(goals: DataFrame, cells: DataFrame) -> DataFrame:
    """Given goals (margin, value, target), those of values that cells have, scaled to add up to 1 for each margin."""
    there = reduce(DataFrame.unionByName, (cells.select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")).distinct() for m in POWERS))
    goals = goals.filter("target > 0").join(there, ["margin", "value"], "left_semi")
    return goals.withColumn("target", F.col("target") / F.sum("target").over(Window.partitionBy("margin")))


def rake(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """cells (source, lang, topic, tokens) with w: weights that meet the goals on every margin and add up to 1.

    goals are rows (margin, value, target) that add up to 1 for each margin;
    cells of a value without one are left out, as are those without a token.
    A cell looks its three goals up once; then each margin's step joins it with
    that margin's sums and is written to the shared folder, so no plan holds more
    than one step. Rounds go on until no factor is off by more than TOLERANCE,
    or the largest one has hardly fallen in the last WAIT rounds: the margins
    contradict each other, or nearly so. Then the last weights count, with a
    warning that says how far off they are.
    """
    total = cells.agg(F.sum("tokens").alias("all"))
    cells = cells.filter("tokens > 0").crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens") / F.col("all")).drop("all")  # one row
    goals = written(goals, "mix-goals")
    for margin in POWERS:
        goal = goals.filter(F.col("margin") == margin).select(F.col("value").alias("_value"), F.col("target").alias(f"to_{margin}"))
        cells = cells.join(goal, F.col(margin).cast("string") == F.col("_value")).drop("_value")
    offs: list[float] = []
    while True:
        cells = cells.withColumn("off", F.lit(0.0))
        for margin in POWERS:
            factor = F.col(f"to_{margin}") / F.col("s")
            scaled = cells.join(cells.groupBy(margin).agg(F.sum("w").alias("s")), margin)
            cells = written(scaled.withColumns({"w": F.col("w") * factor, "off": F.greatest("off", F.abs(factor - 1))}).drop("s"), "mix-cells")
        off = cells.agg(F.max("off")).first()[0]
        if off is None or off < TOLERANCE:
            break
        offs.append(off)
        if len(offs) > WAIT and off > FALL * offs[-1 - WAIT]:
            warnings.warn(f"After {len(offs)} rounds, which no longer help, a margin is still off its targets by a factor of {1 + off}.", stacklevel=2)
            break
    return cells.drop("off", *(f"to_{m}" for m in POWERS))


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Raked cells with p, the probability of drawing each of a cell's documents: min(1, c * weight / share).

    c is such that keep of all tokens are expected; cells at probability 1
    can't give more, so the others give what these fall short of.
    """
    ratio = F.col("w") / F.col("tokens")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    c, before = 0.0, -1.0
    while c > before:
        before = c
        full = ratio * before >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("w")))).first()
        if not r[1] or keep * total <= (r[0] or 0):
            break
        c = (keep * total - r[0]) / r[1]
    return cells.withColumn("p", F.least(F.lit(1.0), ratio * c))


def mix(docs: DataFrame, keep: float = KEEP, looked: DataFrame | None = None, goals: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """docs with the struct _mix, its p added, of the rows that are drawn.

    goals (margin, value, target) gives the target weights of the margins
    source, lang and topic, in any proportion; values without one aren't drawn.
    Without goals targets() gives them. topic names a column.

    A row is drawn by a hash of its doc_id, so rows that share one are drawn
    alike within a cell. Texts without a word have no weight and aren't drawn;
    an empty table stays empty. The cells are joined as the small side. Columns
    _cell and _p are refused beside those of look().
    """
    refuse(docs, "_cell", "_p", *(() if looked is not None else ("_mix",)))
    looked = look(docs, topic) if looked is None else looked
    cells = written(looked.groupBy("_mix.source", "_mix.lang", "_mix.topic").agg(F.sum("_mix.tokens").alias("tokens")).filter("tokens > 0"), "mix-cells")
    p = written(probabilities(rake(cells, targets(cells) if goals is None else present(goals, cells)), keep).select(F.struct("source", "lang", "topic").alias("_cell"), F.col("p").alias("_p")), "mix-chances")
    row = F.struct("_mix.source", "_mix.lang", "_mix.topic")
    drawn = looked.join(p, row == F.col("_cell")).filter(chance() < F.col("_p") * 2**32)
    return drawn.withColumn("_mix", F.col("_mix").withField("p", F.col("_p"))).drop("_cell", "_p")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn, with their cell, tokens and probability."""
    looked = written(look(docs_of(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", "_mix"), "mix-looked")
    return mix(looked, looked=looked).select("doc_id", "_mix.source", "_mix.lang", "_mix.topic", "_mix.tokens", F.round("_mix.p", 6).alias("probability"))
