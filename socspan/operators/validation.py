"""Detection quality against labels (VLD-01..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = ["execution_gap", "negative_space", "composite"]
KEYS = ["entity_id", "signal_id"]


def family(c: str = "signal_id"):
    return F.when(F.col(c).startswith("NS-"), "negative_space").when(F.col(c).startswith("COMP-"), "composite").otherwise("execution_gap")


def expected(labels: DataFrame) -> DataFrame:
    """VLD-01: positives: HIGH or CRITICAL, or a note that says planted and not "not planted"."""
    note = F.lower(F.coalesce("note", F.lit("")))
    return labels.filter(F.col("severity").isin("HIGH", "CRITICAL") | (note.contains("planted") & ~note.contains("not planted"))).select(*KEYS).distinct()


def by_scenario(labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """VLD-02, VLD-06: positives, hits and recall of each scenario (SX where none is named); 1 without positives."""
    pos = expected(labels).withColumn("positive", F.lit(True))
    hit = flagged.select(*KEYS).distinct().withColumn("hit", F.lit(True))
    d = labels.select(F.coalesce("scenario_id", F.lit("SX")).alias("scenario_id"), *KEYS).distinct().join(pos, KEYS, "left").join(hit, KEYS, "left")
    n, h = F.count_if(F.col("positive")), F.count_if(F.col("positive") & F.col("hit"))
    return d.groupBy("scenario_id").agg(n.alias("positives"), h.alias("hits"), F.coalesce(h / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("recall"))


def ranked(flagged: DataFrame) -> DataFrame:
    """VLD-03, VLD-04: flagged findings ranked by severity, score, entity and signal."""
    order = F.array_position(F.array(*map(F.lit, ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"])), F.col("severity"))
    return flagged.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), F.desc(F.round("score", 9)), *KEYS)))  # at most a row for each entity and signal


def precision_at(flagged: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """VLD-05: share of hits among the first k ranked findings."""
    d = ranked(flagged).join(positives.select(*KEYS, F.lit(1.0).alias("hit")), KEYS, "left")
    return d.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank", F.coalesce("hit", F.lit(0.0)).alias("hit")).filter("rank <= k").groupBy("k").agg(F.avg("hit").alias("precision"))


def cells(flagged: DataFrame, positives: DataFrame) -> DataFrame:
    """Each (entity, signal) of either side, with predicted and actual."""
    a, b = flagged.select(*KEYS).distinct().withColumn("predicted", F.lit(True)), positives.select(*KEYS).distinct().withColumn("actual", F.lit(True))
    return a.join(b, KEYS, "full_outer").na.fill(False)


def family_scores(flagged: DataFrame, positives: DataFrame) -> DataFrame:
    """VLD-07: precision, recall and F1 of each signal family; 1 on empty denominators."""
    both = F.count_if(F.col("predicted") & F.col("actual"))
    p = F.coalesce(both / F.nullif(F.count_if("predicted"), F.lit(0)), F.lit(1.0))
    r = F.coalesce(both / F.nullif(F.count_if("actual"), F.lit(0)), F.lit(1.0))
    d = cells(flagged, positives).groupBy(family().alias("family")).agg(p.alias("precision"), r.alias("recall"))
    return d.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def agreement(pairs: DataFrame) -> DataFrame:
    """VLD-08, VLD-09: Cohen's kappa and Krippendorff's alpha of rows (a, b) of two raters' booleans."""
    t = pairs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("a") == F.col("b")).cast("double")).alias("same"), F.sum(F.col("a").cast("double")).alias("pa"), F.sum(F.col("b").cast("double")).alias("pb"))
    po = F.col("same") / F.col("n")
    pe = (F.col("pa") * F.col("pb") + (F.col("n") - F.col("pa")) * (F.col("n") - F.col("pb"))) / (F.col("n") * F.col("n"))
    kappa = F.when(pe >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(po - pe, 1 - pe))))
    ones, total = F.col("pa") + F.col("pb"), 2 * F.col("n")
    de = 2 * ones * (total - ones) / (total * (total - 1))
    alpha = F.when(de == 0, 1.0).otherwise(1 - F.try_divide(1 - po, de))
    return t.select(kappa.alias("kappa"), alpha.alias("alpha"))


def compare(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """VLD-10: one row: hits, misses, false alarms over labelled cells, precision, recall, kappa, alpha."""
    pos = expected(labels)
    universe = labels.select(*KEYS).distinct()
    d = universe.join(cells(flagged, pos), KEYS, "left").na.fill(False)
    n = d.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("predicted") & F.col("actual")).alias("hits"), F.count_if(~F.col("predicted") & F.col("actual")).alias("misses"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("false_alarms"))
    rates = n.select("*", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("false_alarms")), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(1.0)).alias("recall"))
    return rates.crossJoin(agreement(d.select(F.col("predicted").alias("a"), F.col("actual").alias("b"))))  # one row each


def ablate(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """VLD-11: recall without each family, and its drop."""
    pos = expected(labels)
    d = cells(flagged, pos).filter("actual").withColumn("family", family())
    out = d.select(F.explode(F.array(*map(F.lit, FAMILIES))).alias("disabled"), "family", "predicted")
    base, rest = F.avg(F.col("predicted").cast("double")), F.avg((F.col("predicted") & (F.col("family") != F.col("disabled"))).cast("double"))
    return out.groupBy("disabled").agg(base.alias("baseline"), rest.alias("recall"), (base - rest).alias("drop"))


def disagreements(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """VLD-12: findings without a label, and labels without a finding."""
    pos = expected(labels)
    a = flagged.select(*KEYS).distinct().join(pos, KEYS, "left_anti").withColumn("kind", F.lit("flagged_only"))
    return a.unionByName(pos.join(flagged, KEYS, "left_anti").withColumn("kind", F.lit("expected_only")))
