"""Expected minus observed telemetry (COV-01..08) and asset coverage (AST-01..03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, EXPECTED_DEFAULT, EXPECTED_SOURCES, TACTICS, TAXONOMY, Params


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def is_critical() -> Column:
    return F.upper("criticality").isin("HIGH", "CRITICAL")


def is_facing() -> Column:
    return F.lower(F.col("internet_facing").cast("string")).isin("true", "1")


def expected_sources(assets: DataFrame) -> DataFrame:
    """COV-01: assets with expected, the sources that their profile should send."""
    profiles = F.create_map(*(x for k, v in EXPECTED_SOURCES.items() for x in (F.lit(k), _texts(v))))
    key = F.concat_ws("|", F.lower("criticality"), "environment", "os_family", F.lower(F.col("internet_facing").cast("string")))
    return assets.withColumn("expected", F.coalesce(F.try_element_at(profiles, key), _texts(EXPECTED_DEFAULT)))


def negative_space(assets: DataFrame, telemetry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """COV-02: each asset and expected source, whether it was observed, and days of silence (none, or the whole window)."""
    seen = telemetry.select("entity_id", "asset_id", F.col("source").alias("expected_source"), F.lit(True).alias("seen")).distinct()
    pairs = expected_sources(assets).select("entity_id", "asset_id", F.explode("expected").alias("expected_source"), is_critical().alias("critical"))
    m = pairs.join(seen, ["entity_id", "asset_id", "expected_source"], "left")
    gap = F.col("seen").isNull()
    return m.select("entity_id", "asset_id", "expected_source", (~gap).alias("observed"), gap.alias("gap_flag"), F.when(gap, int(p.days)).otherwise(0).alias("silence_days"), "critical")


def daily_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts a day by entity, of days that have any."""
    return alerts.filter("detected_ts is not null").groupBy("entity_id", F.to_date("detected_ts").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))


def detrended(daily: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """COV-03: daily counts with residual: count minus the median of the last baseline_days buckets, itself included."""
    w = Window.partitionBy("entity_id").orderBy("day").rowsBetween(-p.baseline_days + 1, 0)
    return daily.withColumn("residual", F.col("cnt") - F.expr("percentile(cnt, 0.5)").over(w))


def coverage_summary(registry: DataFrame, assets: DataFrame, telemetry: DataFrame, alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """COV-04..06: gap ratio of critical assets, longest silence, category and tactic coverage, absent pairs."""
    space = negative_space(assets, telemetry, p)
    crit = assets.filter(is_critical()).groupBy("entity_id").agg(F.count_distinct("asset_id").alias("n_critical_assets"))
    gaps = space.groupBy("entity_id").agg(F.count_distinct(F.when(F.col("critical") & F.col("gap_flag"), F.col("asset_id"))).alias("gap_assets"), F.max("silence_days").alias("silence"), F.count_if("gap_flag").alias("absent"), F.count(F.lit(1)).alias("pairs"))
    cats = alerts.groupBy("entity_id").agg(F.collect_set("category").alias("cats"))
    none = F.array().cast("array<string>")
    d = registry.select("entity_id").join(crit, "entity_id", "left").join(gaps, "entity_id", "left").join(cats, "entity_id", "left")
    missing = F.size(F.array_except(_texts(TAXONOMY), F.coalesce("cats", none)))
    tactics = F.size(F.array_intersect(_texts(TACTICS), F.coalesce("cats", none)))
    return d.select(
        "entity_id",
        F.coalesce(F.col("gap_assets") / F.greatest(F.lit(1), "n_critical_assets"), F.lit(0.0)).alias("telemetry_gap_ratio"),
        F.coalesce(F.col("silence").cast("double"), F.lit(0.0)).alias("silence_max"),
        missing.alias("category_missing"),
        (1 - missing / len(TAXONOMY)).alias("category_coverage"),
        (tactics / len(TACTICS)).alias("tactic_coverage"),
        F.coalesce("absent", F.lit(0)).alias("expected_absent_count"),
        F.coalesce("pairs", F.lit(0)).alias("space_rows"),
    )


def facing_assets(assets: DataFrame) -> DataFrame:
    """COV-08: internet-facing assets."""
    return assets.filter(is_facing())


def perimeter_blind(assets: DataFrame, telemetry: DataFrame) -> DataFrame:
    """COV-08: internet-facing assets that send neither firewall nor ids."""
    seen = telemetry.filter(F.col("source").isin("firewall", "ids")).select("entity_id", "asset_id").distinct()
    return facing_assets(assets).join(seen, ["entity_id", "asset_id"], "left_anti")


def coverage_cells(space: DataFrame, results: DataFrame, limit: int = 500) -> DataFrame:
    """COV-07: the first cells of the heat map, each with the entity's first flagged negative-space finding."""
    link = results.filter("is_flagged and signal_id like 'NS-%'").groupBy("entity_id").agg(F.min_by("finding_id", "signal_id").alias("finding_id"), F.min("signal_id").alias("linked_signal"))
    cells = space.join(link, "entity_id", "left").select("entity_id", "asset_id", "expected_source", "gap_flag", F.when(F.col("gap_flag"), "gap").otherwise("ok").alias("css"), "finding_id", "linked_signal")
    return cells.orderBy("entity_id", "asset_id", "expected_source").limit(limit)


def resolve_assets(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """AST-01: assets, and a row of unknown profile for each asset that only alerts name."""
    shadow = alerts.filter("asset_id is not null").select("entity_id", "asset_id").distinct().join(assets, ["entity_id", "asset_id"], "left_anti")
    shadow = shadow.select("entity_id", "asset_id", F.lit("").alias("hostname"), F.lit("UNKNOWN").alias("criticality"), F.lit("unknown").alias("environment"), F.lit("unknown").alias("os_family"), F.lit(False).alias("internet_facing"))
    return assets.unionByName(shadow)


def alert_density(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """AST-02: alerts of each asset of the inventory."""
    n = alerts.groupBy("entity_id", "asset_id").agg(F.count("alert_id").alias("n"))
    return assets.select("entity_id", "asset_id").join(n, ["entity_id", "asset_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def asset_features(alerts: DataFrame, cases: DataFrame, assets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """AST-03: density, coverage rates and shadow assets by entity."""
    alerted = alerts.filter("asset_id is not null").select("entity_id", "asset_id", F.lit(True).alias("alerted")).distinct()
    d = resolve_assets(alerts, assets).join(alerted, ["entity_id", "asset_id"], "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    a = d.groupBy("entity_id").agg(
        (F.count_if(is_critical() & F.col("alerted")) / F.greatest(F.lit(1), F.count_if(is_critical()))).alias("critical_asset_coverage"),
        (F.count_if(is_facing() & F.col("alerted")) / F.greatest(F.lit(1), F.count_if(is_facing()))).alias("internet_facing_alert_rate"),
        F.count_if(F.col("criticality") == "UNKNOWN").alias("shadow_asset_count"),
        F.count(F.lit(1)).alias("asset_count_resolved"),
    )
    cased = cases.groupBy("entity_id").agg(F.count_distinct("asset_id").alias("cased"))
    dense = alert_density(alerts, assets).groupBy("entity_id").agg((F.avg("n") / p.days).alias("alert_density_mean"))
    d = a.join(cased, "entity_id", "left").join(dense, "entity_id", "left")
    return d.select("entity_id", F.coalesce("alert_density_mean", F.lit(0.0)).alias("alert_density_mean"), "critical_asset_coverage", "internet_facing_alert_rate", (F.coalesce("cased", F.lit(0)) / F.greatest(F.lit(1), "asset_count_resolved")).alias("case_asset_coverage"), "shadow_asset_count", "asset_count_resolved")
