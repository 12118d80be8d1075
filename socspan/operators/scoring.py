"""Risk scores, confidence, review queue, portfolio and calibration (SCR-01..19, TMP-01 windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp01
from ..params import DEFAULT, DOMAIN_WEIGHTS, SEVERITY_WEIGHT, Params

#: The domain of each signal.
DOMAINS = {
    "detection_coverage": ["EG-005", "NS-001", "NS-002", "NS-005", "NS-009"],
    "investigation_quality": ["EG-002", "EG-009", "EG-010", "EG-011", "EG-012"],
    "escalation_integrity": ["EG-003", "EG-004", "EG-014"],
    "operational_discipline": ["EG-001", "EG-006", "EG-008", "EG-013"],
    "governance": ["EG-007", "COMP-001", "COMP-002", "COMP-003"],
    "peer_divergence": ["NS-003", "NS-004"],
    "negative_space": ["NS-006", "NS-007", "NS-008", "NS-010", "NS-011", "NS-012"],
}


def domain_of(signal: Column) -> Column:
    """The domain of a signal id; governance for unknown ones."""
    out = None
    for d, ids in DOMAINS.items():
        out = F.when(signal.isin(ids), d) if out is None else out.when(signal.isin(ids), d)
    return out.otherwise("governance")


def contributions(results: DataFrame) -> DataFrame:
    """SCR-01: results with domain and contribution: score times severity weight times 100 where flagged on enough data."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv))[F.col("severity")], F.lit(0.30))
    on = F.col("is_flagged") & ~F.col("insufficient_data")
    return results.withColumns({"domain": domain_of(F.col("signal_id")), "contribution": F.when(on, clamp01(F.col("score")) * weight * 100).otherwise(0.0)})


def domain_scores(results: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """SCR-02: greatest contribution times 1 - exp(-k n), n positive contributions; a row for each entity and domain."""
    c = contributions(results)
    s = c.groupBy("entity_id", "domain").agg(F.max("contribution").alias("top"), F.count_if(F.col("contribution") > 0).alias("breadth"))
    every = results.select("entity_id").distinct().select("entity_id", F.explode(F.array(*map(F.lit, DOMAIN_WEIGHTS))).alias("domain"))
    d = every.join(s, ["entity_id", "domain"], "left").na.fill(0)
    return d.withColumn("domain_score", F.col("top") * (1 - F.exp(-p.breadth_k * F.col("breadth"))))


def band(score: Column) -> Column:
    """SCR-04: 25, 50 and 75 are the lower edges."""
    return F.when(score < 25, "LOW").when(score < 50, "MODERATE").when(score < 75, "ELEVATED").otherwise("HIGH")


def entity_scores(results: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """SCR-03, SCR-04: weighted sum over domains, band, flagged signals and the domain that contributes most."""
    weights = F.create_map(*(F.lit(x) for k, v in DOMAIN_WEIGHTS.items() for x in (k, v / sum(DOMAIN_WEIGHTS.values()))))
    d = domain_scores(results, p).withColumn("part", weights[F.col("domain")] * F.col("domain_score"))
    s = d.groupBy("entity_id").agg(F.sum("part").alias("score"), F.min_by("domain", F.struct(-F.round("part", 9), "domain")).alias("focus_domain"))
    n = results.groupBy("entity_id").agg(F.count_if("is_flagged").alias("n_flagged"), F.avg((~F.col("insufficient_data")).cast("double")).alias("adequate_share"))
    return s.join(n, "entity_id").withColumn("band", band(F.col("score")))


def null_shares(frames: dict[str, DataFrame]) -> DataFrame:
    """Mean over tables of the mean share of nulls over columns, by entity."""
    out = None
    for df in frames.values():
        cols = [c for c in df.columns if c != "entity_id"]
        share = sum((F.avg(F.col(c).isNull().cast("double")) for c in cols), F.lit(0.0)) / len(cols)
        part = df.groupBy("entity_id").agg(share.alias("null_share"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity_id").agg(F.avg("null_share").alias("null_share"))


def completeness(registry: DataFrame, frames: dict[str, DataFrame], quarantined: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """SCR-07: (1 - nulls)(1 - min(1, 2q))(1 - min(1, 2u)) times label confidence, by entity.

    q: distinct quarantined rows (entity_id, _fingerprint) over alerts; u: share of alerts of unknown severity.
    """
    alerts = frames["alerts"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("severity_norm") == "UNKNOWN").cast("double")).alias("u"))
    q = quarantined.groupBy("entity_id").agg(F.count_distinct("_fingerprint").alias("bad"))
    d = registry.select("entity_id").join(null_shares(frames), "entity_id", "left").join(alerts, "entity_id", "left").join(q, "entity_id", "left")
    sure = F.lit(1.0)
    if labels is not None:
        d = d.join(labels.groupBy("entity_id").agg(F.avg("confidence").alias("sure")), "entity_id", "left")
        sure = F.coalesce("sure", F.lit(1.0))
    rate = F.coalesce(F.col("bad"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))
    value = (1 - F.coalesce("null_share", F.lit(0.0))) * (1 - F.least(F.lit(1.0), 2 * rate)) * (1 - F.least(F.lit(1.0), 2 * F.coalesce("u", F.lit(0.0)))) * sure
    return d.select("entity_id", rate.alias("quarantine_rate"), F.coalesce("null_share", F.lit(0.0)).alias("null_share"), clamp01(value).alias("completeness"))


def confidence(scores: DataFrame, complete: DataFrame, sizes: DataFrame) -> DataFrame:
    """SCR-08: level and reason from completeness, share of adequate signals, cohorts and missing values.

    sizes (entity_id, fell_back) tells whose peers are all entities, as the
    cohort is too small; that is adequate, and the reason names it. An entity
    without a row there has no comparison and isn't HIGH. capped says that
    completeness alone made the level LOW.
    """
    d = scores.join(complete, "entity_id", "left").na.fill(0.0, ["completeness", "null_share"]).join(sizes.select("entity_id", "fell_back"), "entity_id", "left")
    capped, sure = F.col("completeness") < 0.6, F.col("fell_back").isNotNull()
    high = (F.col("completeness") >= 0.9) & (F.col("adequate_share") >= 0.9) & sure & (F.col("null_share") <= 0.05)
    level = F.when(capped, "LOW").when(high, "HIGH").when((F.col("completeness") >= 0.7) & (F.col("adequate_share") >= 0.5), "MEDIUM").otherwise("LOW")
    note = F.when(~sure, "no peer comparison").when(F.col("fell_back"), "cohort too small, compared with all entities").otherwise("cohort large enough for comparison")
    facts = F.format_string("completeness %.2f; %.0f%% of signals have enough rows; %s", F.col("completeness"), F.col("adequate_share") * 100, note)
    reason = F.when(capped, F.format_string("completeness %.2f is below 0.60; left out of the ranking until the feed is verified", "completeness")).when(high, F.format_string("%s; missing values %.1f%%", facts, F.col("null_share") * 100)).otherwise(facts)
    return d.withColumns({"confidence": level, "confidence_reason": reason, "capped": capped}).drop("fell_back")


def ranking(scored: DataFrame) -> DataFrame:
    """SCR-05: rank by score of entities complete enough, and of the others in a queue of their own."""
    w = Window.partitionBy("queue").orderBy(F.desc(F.round("score", 9)), "entity_id")
    return scored.withColumn("queue", F.when(F.col("completeness") >= 0.6, "ranking").otherwise("insufficient")).withColumn("rank", F.row_number().over(w))


def novelty(entities: DataFrame, runs: DataFrame, prior: int = 2, down: float = 0.4) -> DataFrame:
    """SCR-09: down^(streak - prior + 1) once an entity is in the prior latest runs without a break; runs are (run_id, seq, entity_id)."""
    order = runs.select("run_id", "seq").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("seq"))))  # one row a run
    seen = runs.select("run_id", "entity_id").distinct()
    grid = entities.select("entity_id").distinct().crossJoin(F.broadcast(order)).join(seen.withColumn("seen", F.lit(1)), ["run_id", "entity_id"], "left")
    miss = grid.groupBy("entity_id").agg(F.coalesce(F.min(F.when(F.col("seen").isNull(), F.col("back"))) - 1, F.max("back")).alias("streak"))
    d = entities.select("entity_id").distinct().join(miss, "entity_id", "left").na.fill(0, ["streak"])
    return d.select("entity_id", "streak", F.when(F.col("streak") >= prior, F.pow(F.lit(down), F.col("streak") - prior + 1)).otherwise(1.0).alias("novelty"))


def coverage_gap(entities: DataFrame, reviewed: DataFrame, as_of: str, days: int = 30, up: float = 1.25) -> DataFrame:
    """SCR-10: up if an entity was never reviewed or longer than days ago."""
    last = reviewed.groupBy("entity_id").agg(F.max("ts").alias("ts"))
    old = F.col("ts").isNull() | (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("ts") > days * 86400)
    return entities.select("entity_id").distinct().join(last, "entity_id", "left").select("entity_id", F.when(old, up).otherwise(1.0).alias("coverage_gap"))


def sample_ids(rows: DataFrame, alerts: DataFrame, tables: dict[str, str], seed: int = 42, top: int = 5) -> DataFrame:
    """SCR-11: up to top alert_ids and case_ids that support each signal of an entity, in an order that the seed draws.

    rows are evidence (entity_id, signal_id, side, row_id), tables the table
    that a signal's rows are of. Ids of alerts must be in alerts; repeated ids
    count once. Signals with neither have no row.
    """
    kinds = F.create_map(*(F.lit(x) for kv in tables.items() for x in kv))
    d = rows.filter("side = 'supports'").select("entity_id", "signal_id", kinds[F.col("signal_id")].alias("kind"), "row_id").distinct()
    known = alerts.select("entity_id", F.col("alert_id").cast("string").alias("row_id"))
    d = d.filter("kind = 'alerts'").join(known, ["entity_id", "row_id"], "left_semi").unionByName(d.filter("kind = 'cases'"))
    salt = F.concat("signal_id", F.when(F.col("kind") == "alerts", ":alert").otherwise(":case"))
    w = Window.partitionBy("entity_id", "signal_id", "kind").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), salt, "row_id"), 256), "row_id")
    d = d.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "row_id")))), lambda x: x.row_id)
    return d.groupBy("entity_id", "signal_id").agg(of("alerts").alias("alert_ids"), of("cases").alias("case_ids"))


def review_queue(scored: DataFrame, novel: DataFrame, gaps: DataFrame, minutes: int = 10) -> DataFrame:
    """SCR-12: priority = score x completeness x novelty x gap, rank by it, minutes for the flagged signals."""
    d = scored.join(novel, "entity_id").join(gaps, "entity_id").withColumn("priority", F.col("score") * F.col("completeness") * F.col("novelty") * F.col("coverage_gap"))
    w = Window.orderBy(F.desc(F.round("priority", 9)), "entity_id")  # one row an entity
    return d.select("entity_id", "priority", "focus_domain", "band", F.greatest(F.lit(1), F.col("n_flagged") * minutes).alias("review_minutes"), F.row_number().over(w).alias("rank"))


def portfolio(scored: DataFrame, registry: DataFrame, prior: DataFrame | None = None, top: int = 5, shift: float = 2.0) -> DataFrame:
    """SCR-13, RPT-04: (kind, name, value): entities of each band, the top entities by score, the median of each sector, and the trend.

    The trend compares the median score with that of prior (entity_id, score),
    an earlier run: DETERIORATING where it is more than shift higher, IMPROVING
    where it is more than shift lower, else STABLE; its value is the difference,
    0 without an earlier run. A top entity's value is its place.
    """
    spark = scored.sparkSession
    bands = spark.createDataFrame([(b,) for b in ("LOW", "MODERATE", "ELEVATED", "HIGH")], "name string")
    n = scored.groupBy(F.col("band").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    counts = bands.join(n, "name", "left").na.fill(0.0).select(F.lit("band").alias("kind"), "name", "value")
    sector = scored.join(registry, "entity_id", "left").groupBy(F.coalesce("sector", F.lit("unknown")).alias("name")).agg(F.median("score").alias("value"))
    order = [F.desc(F.round("score", 9)), F.col("entity_id")]
    first = scored.orderBy(*order).limit(top).withColumn("value", F.row_number().over(Window.orderBy(*order)).cast("double"))
    out = counts.unionByName(sector.select(F.lit("sector_median").alias("kind"), "name", "value")).unionByName(first.select(F.lit("top").alias("kind"), F.col("entity_id").alias("name"), "value"))
    runs = scored.select("score", F.lit(True).alias("now"))
    runs = runs if prior is None else runs.unionByName(prior.select("score", F.lit(False).alias("now")))
    moved = F.coalesce(F.median(F.when(F.col("now"), F.col("score"))) - F.median(F.when(~F.col("now"), F.col("score"))), F.lit(0.0))
    trend = runs.agg(moved.alias("value")).select(F.lit("trend").alias("kind"), F.when(F.col("value") > shift, "DETERIORATING").when(F.col("value") < -shift, "IMPROVING").otherwise("STABLE").alias("name"), "value")
    return out.unionByName(trend)


def trends(history: DataFrame) -> DataFrame:
    """SCR-14: direction over windows (entity_id, seq, score): only a strictly monotone course has one."""
    d = history.withColumn("step", F.signum(F.col("score") - F.lag("score").over(Window.partitionBy("entity_id").orderBy("seq"))))
    s = d.groupBy("entity_id").agg(F.count(F.lit(1)).alias("windows"), F.min("step").alias("low"), F.max("step").alias("high"))
    return s.select("entity_id", "windows", F.when(F.col("windows") < 2, "INSUFFICIENT_HISTORY").when(F.col("high") < 0, "IMPROVING").when(F.col("low") > 0, "WORSENING").otherwise("STABLE").alias("direction"))


def signal_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """SCR-14: NEW, PERSISTENT or RESOLVED for each flagged (entity_id, signal_id) of two windows."""
    a, b = (x.select("entity_id", "signal_id", F.lit(True).alias(n)).distinct() for x, n in ((now, "now"), (before, "before")))
    return a.join(b, ["entity_id", "signal_id"], "full_outer").select("entity_id", "signal_id", F.when(F.col("before").isNull(), "NEW").when(F.col("now").isNull(), "RESOLVED").otherwise("PERSISTENT").alias("state"))


def drill_down(results: DataFrame) -> DataFrame:
    """SCR-15: flagged signals nested by entity and domain."""
    c = contributions(results).filter("is_flagged").groupBy("entity_id", "domain").agg(F.sort_array(F.collect_list(F.struct("signal_id", "severity", F.round("contribution", 6).alias("contribution"), "finding_id"))).alias("signals"))
    return c.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("domain", "signals"))).alias("domains"))


def train_calibrator(rows: DataFrame):
    """SCR-17: a model of label (0, 1) on score: isotonic from 50 rows on, else logistic; None without rows of both labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows.select("score", F.col("label").cast("double").alias("label")))
    n, kinds = d.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if kinds < 2:
        return None
    return (IsotonicRegression() if n >= 50 else LogisticRegression()).fit(d)


def calibrate(rows: DataFrame, model) -> DataFrame:
    """SCR-16: rows (.., score in 0..1) with calibrated_score in 0..100; raw x 100 and calibrated false without a model."""
    if model is None:
        return rows.withColumns({"calibrated_score": F.col("score") * 100, "calibrated": F.lit(False)})
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = model.transform(VectorAssembler(inputCols=["score"], outputCol="features").transform(rows))
    value = vector_to_array("probability")[1] if "probability" in d.columns else F.col("prediction")
    return d.select(*rows.columns, (clamp01(value) * 100).alias("calibrated_score"), F.lit(True).alias("calibrated"))


def save_calibrator(model, rows: DataFrame, features: list[str], path: str) -> None:
    """SCR-16: a model of train_calibrator(), bound to the rows it was trained on (by SCR-19) and to the features behind the score."""
    spark = rows.sparkSession
    facts = fingerprint(rows.select("score", "label")).select("fingerprint", F.array(*map(F.lit, features)).cast("array<string>").alias("features"), F.lit(type(model).__name__).alias("kind"))
    model.write().overwrite().save(f"{path}/model")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/facts")  # last: without facts there is no model
    spark.catalog.refreshByPath(path)


def load_calibrator(spark, path: str, rows: DataFrame | None, features: list[str]) -> tuple[object | None, str]:
    """SCR-16: the saved model, or None and why: there is none, or it was trained on other features or (if rows are given) other rows.

    Give the result to calibrate(), which then returns raw scores and calibrated false.
    """
    from pyspark.errors import AnalysisException
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import IsotonicRegressionModel

    try:
        facts = spark.read.schema("fingerprint string, features array<string>, kind string").json(f"{path}/facts").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        facts = None
    if facts is None:
        return None, "no calibrator"
    if facts["features"] != features:
        return None, "other features"
    if rows is not None and fingerprint(rows.select("score", "label")).first()[0] != facts["fingerprint"]:
        return None, "other training rows"
    kinds = {k.__name__: k for k in (IsotonicRegressionModel, LogisticRegressionModel)}
    return kinds[facts["kind"]].load(f"{path}/model"), ""


def brier(rows: DataFrame) -> DataFrame:
    """SCR-18: mean squared difference of p and label."""
    return rows.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """SCR-18: for each of the bins of p its centre, the share of positives and the count; empty bins too, the last one closed."""
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    s = rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg(F.col("label").cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))
    return every.join(s, "bin", "left").select("bin", ((F.col("bin") + 0.5) / bins).alias("centre"), F.coalesce("positive", F.lit(0.0)).alias("positive"), F.coalesce("n", F.lit(0)).alias("n"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """SCR-19: one hash of all rows, whatever their order, from counts of row hashes by their first two digits."""
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = h.groupBy(F.substring("h", 1, 2).alias("k")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "s", "n"))), lambda x: F.concat_ws(":", x.k, x.s, x.n)), "|"), 256).alias("fingerprint"))
