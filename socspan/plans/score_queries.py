"""Queries of ingest, scoring, evidence, audit and validation."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finding_id, share
from ..functions.tables import shared_dir, written
from ..operators import audit, coverage, evidence, ledger, peers, reports, scoring, signals, temporal, validation
from ..params import DEFAULT, DOMAIN_WEIGHTS, SEVERITY_WEIGHT
from ..sources import ingest, records, sinks, submission, versions
from . import entity_queries as q
from . import signal_queries as sq
from .common import Book
from .entity_queries import mins

_b = Book()
AS_OF = "2030-01-01 00:00:00"


@lru_cache(maxsize=4)
def _stored(t):
    """The tables of a query, written once for all that reads them."""
    return t.stored()


@lru_cache(maxsize=4)
def found(t) -> DataFrame:
    """The results of all signals and composites; written, and computed once for the tables of a query."""
    return signals.run_all(_stored(t))


ORDER = "list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)"
_COLUMNS = "entity_id, high_band, signal_id, value, threshold, sample_size, is_flagged, score, severity, confidence, insufficient_data"


def _composite(c: str) -> str:
    ids = [m for m in signals.members(signals.COMPOSITES[c][1]) if m != "high_band"]
    return f"select c.entity_id, h.high_band, signal_id, value, 1.0::double as threshold, {len(ids)}::bigint as sample_size, is_flagged, value as score, severity, confidence, false as insufficient_data from ({sq.composite(c).replace('from results', 'from base')}) c join (select entity_id, bool_or(high_band) as high_band from base group by 1) h using (entity_id)"


RESULTS = [*sq.wide(), "base as materialized (" + " union all ".join(map(sq.rule, signals.SIGNALS)) + ")", f"results as materialized (select {_COLUMNS} from base union all " + " union all ".join(map(_composite, signals.COMPOSITES)) + ")"]
_DOMAIN = "case " + " ".join(f"when signal_id in ({', '.join(repr(i) for i in ids)}) then '{d}'" for d, ids in scoring.DOMAINS.items()) + " else 'governance' end"
_WEIGHT = "case severity " + " ".join(f"when '{k}' then {v}::double" for k, v in SEVERITY_WEIGHT.items()) + " end"
CONTRIB = f"contrib as (select *, {_DOMAIN} as domain, case when is_flagged and not insufficient_data then least(1.0, greatest(0.0, score)) * {_WEIGHT} * 100 else 0.0 end as contribution from results)"
DOMAIN = "doms as (select r.entity_id, d.domain, d.weight, coalesce(max(c.contribution), 0.0) as top, count(*) filter (where c.contribution > 0) as breadth from registry r cross join (" + " union all ".join(f"select '{k}' as domain, {v}::double as weight" for k, v in DOMAIN_WEIGHTS.items()) + ") d left join contrib c on c.entity_id = r.entity_id and c.domain = d.domain group by 1, 2, 3)"
SCORES = "scores as (select entity_id, sum(weight * top * (1 - exp(-0.8 * breadth))) as score, arg_min(domain, struct_pack(a := -round(weight * top * (1 - exp(-0.8 * breadth)), 9), b := domain)) as focus_domain from doms group by 1)"
_S = [*RESULTS, CONTRIB, DOMAIN, SCORES]

_b.add("scr_01_contributions", lambda t: scoring.contributions(found(t)).select("entity_id", "signal_id", "domain", "contribution"), "select entity_id, signal_id, domain, round(contribution, 6) as contribution from contrib", *_S)
_b.add("scr_02_domain_scores", lambda t: scoring.domain_scores(found(t)).select("entity_id", "domain", "top", "breadth", "domain_score"), "select entity_id, domain, round(top, 6) as top, breadth, round(top * (1 - exp(-0.8 * breadth)), 6) as domain_score from doms", *_S)
_BAND = "case when score < 25 then 'LOW' when score < 50 then 'MODERATE' when score < 75 then 'ELEVATED' else 'HIGH' end"
_b.add("scr_03_entity_scores", lambda t: scoring.entity_scores(found(t)).select("entity_id", "score", "band", "focus_domain"), f"select entity_id, round(score, 6) as score, {_BAND} as band, focus_domain from scores", *_S)
_shifted = lambda t, scores: scores.join(t.registry, "entity_id").select("entity_id", (F.col("score") - F.expr("3 + nk % 4")).alias("score"))  # noqa: E731  # stands for an earlier run
_b.add("scr_13_portfolio", lambda t: scoring.portfolio(s := scoring.entity_scores(found(t)), t.registry, _shifted(t, s)),
       f"select 'band' as kind, b.name, count(s.entity_id)::double as value from (select unnest(['LOW', 'MODERATE', 'ELEVATED', 'HIGH']) as name) b left join (select entity_id, {_BAND} as band from scores) s on s.band = b.name group by 2 union all select 'sector_median', sector, round(median(score), 6) from scores join registry using (entity_id) group by 2 "
       "union all select 'top', entity_id, k::double from (select entity_id, row_number() over (order by round(score, 9) desc, entity_id) as k from scores) where k <= 5 "
       "union all select 'trend', case when v > 2 then 'DETERIORATING' when v < -2 then 'IMPROVING' else 'STABLE' end, round(v, 6) from (select median(score) - median(score - 3 - nk % 4) as v from scores join registry using (entity_id))", *_S)
_b.add("scr_08_confidence", lambda t: scoring.confidence(scoring.entity_scores(found(t)), t.registry.select("entity_id", F.expr("0.5d + nk % 6 * 0.1d").alias("completeness"), F.expr("nk % 3 * 0.03d").alias("null_share")), peers.cohort_sizes(t.registry.withColumn("cohort_id", F.when(F.expr("nk % 5 < 4"), F.col("cohort_id")).otherwise(F.concat_ws("-", "cohort_id", "nk"))), replace(DEFAULT, cohort_min=3))).select("entity_id", "confidence", "confidence_reason", "capped"),
       "select entity_id, case when c < 0.6 then 'LOW' when high then 'HIGH' when c >= 0.7 and a >= 0.5 then 'MEDIUM' else 'LOW' end as confidence, case when c < 0.6 then printf('completeness %.2f is below 0.60; left out of the ranking until the feed is verified', c) else facts || case when high then printf('; missing values %.1f%%', m * 100) else '' end end as confidence_reason, c < 0.6 as capped from "
       "(select *, c >= 0.9 and a >= 0.9 and m <= 0.05 as high, printf('completeness %.2f; %.0f%% of signals have enough rows; ', c, a * 100) || case when others < 3 then 'cohort too small, compared with all entities' else 'cohort large enough for comparison' end as facts from "
       "(select r.entity_id, 0.5::double + r.nk % 6 * 0.1::double as c, r.nk % 3 * 0.03::double as m, count(*) over (partition by case when r.nk % 5 < 4 then r.cohort_id else r.cohort_id || '-' || r.nk end) - 1 as others, x.a from registry r join (select entity_id, avg(case when insufficient_data then 0.0::double else 1 end) as a from results group by 1) x using (entity_id)))", *_S)


def _scored(t) -> DataFrame:
    q = ingest.quarantine(_checked(t), "run")
    full = scoring.completeness(t.registry, {"alerts": t.alerts, "cases": t.cases.drop("alert_ids", "alert_ref", "ok"), "assets": t.assets}, q)
    return scoring.ranking(scoring.confidence(scoring.entity_scores(found(t)), full, peers.cohort_sizes(t.registry)))


def _checked(t) -> DataFrame:
    dirty = t.cases.withColumns({"severity_norm": F.when(F.expr("ok % 20 = 0"), "BANANA").otherwise(F.col("severity_norm")), "close_ts": F.when(F.expr("ok % 20 = 1"), F.expr("detected_ts - interval 1 hour")).otherwise(F.col("close_ts")), "asset_id": F.when(F.expr("ok % 20 = 2"), F.lit(None)).otherwise(F.col("asset_id"))})
    return ingest.check(dirty, "2001-12-31 00:00:00", ["case_id", "asset_id", "open_ts"], ingest.CASE_ENUMS)


CHECKED = "checked as (select *, case when greatest(open_ts, detected_ts, ack_ts, c2) > timestamp '2001-12-31 00:01:00' then 'FUTURE_TIMESTAMP' when c2 < detected_ts or ack_ts < detected_ts then 'NON_MONOTONIC' when ok % 20 = 2 then 'REQUIRED_MISSING' when ok % 20 = 0 then 'ENUM_INVALID' end as reason from (select *, case when ok % 20 = 1 then detected_ts - interval 1 hour else close_ts end as c2 from cases))"
_b.add("val_05_check_cases", lambda t: _checked(t).select("entity_id", "case_id", "reason"), "select entity_id, case_id, reason from checked", CHECKED)
_b.add("val_03_orphan_references", lambda t: ingest.check(t.alerts, "2030-01-01 00:00:00", ["alert_id"], {}, t.assets.filter("cast(asset_id as int) % 11 <> 0")).filter("reason is not null").select("entity_id", "alert_id", "reason"), "select entity_id, alert_id, 'ORPHAN_REFERENCE' as reason from alerts where asset_id::int % 11 = 0")
_b.add("val_06_scorecard", lambda t: ingest.scorecard(_checked(t)).select("entity_id", "total_rows", "valid_rows", "quarantined_rows", "quarantine_rate", ingest.health(F.col("quarantine_rate")).alias("health"), F.coalesce(F.try_element_at("reasons", F.lit("ENUM_INVALID")), F.lit(0)).alias("enum_invalid")),
       "select entity_id, total_rows, valid_rows, total_rows - valid_rows as quarantined_rows, round((total_rows - valid_rows) / total_rows, 6) as quarantine_rate, case when (total_rows - valid_rows) / total_rows >= 0.2 then 'POOR' when (total_rows - valid_rows) / total_rows >= 0.05 then 'DEGRADED' else 'HEALTHY' end as health, enum_invalid from (select entity_id, count(*) as total_rows, count(*) filter (where reason is null) as valid_rows, count(*) filter (where reason = 'ENUM_INVALID') as enum_invalid from checked group by 1)", CHECKED)
_b.add("snk_02_quarantine_append", lambda t: ingest.append_new(q := ingest.quarantine(_checked(t), "run"), q.filter("reason_code = 'ENUM_INVALID'")).groupBy("entity_id", "reason_code").agg(F.count(F.lit(1)).alias("n")), "select entity_id, reason as reason_code, count(*) as n from checked where reason is not null and reason <> 'ENUM_INVALID' group by 1, 2", CHECKED)
_raw = lambda t: t.alerts.select("entity_id", F.concat(F.lit("="), "alert_id").alias("Alert-ID"), F.col("asset_id").alias("Host ID"), F.col("title").alias("Alert Name"), F.element_at(F.array(F.lit(" p1"), F.lit("Med"), F.lit("weird")), (F.col("alert_id").cast("int") % 3 + 1)).alias("Priority"), F.lower("status").alias("State"), F.when(F.expr("cast(alert_id as int) % 2 = 0"), F.date_format("detected_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("detected_ts", "dd/MM/yyyy HH:mm")).alias("Timestamp"))
_b.add("map_01_map_alerts", lambda t: submission.map_table(_raw(t), "alerts", AS_OF, zone="Asia/Kolkata").select("entity_id", "alert_id", "asset_id", "severity_norm", "status", "category", "detected_ts"),
       "select entity_id, alert_id, asset_id, case alert_id::int % 3 when 0 then 'CRITICAL' when 1 then 'MEDIUM' else 'UNKNOWN' end as severity_norm, status, 'SECURITY' as category, case when alert_id::int % 2 = 0 then date_trunc('millisecond', detected_ts) else date_trunc('minute', detected_ts) - interval 330 minute end as detected_ts from alerts")
_PLACE = lambda key, rows: f"select *, row_number() over (partition by entity_id order by sha256({key})) - 1 as i from {rows}"
_b.add("map_09_derived_cases", lambda t: submission.derived_cases(t.alerts).select("entity_id", "case_id", "status", "disposition_code", "open_ts", "close_ts"),
       f"select entity_id, 'CAS-' || alert_id as case_id, case when i % 2 = 0 then 'CLOSED' else 'OPEN' end as status, case when i % 3 = 0 then 'TRUE_POSITIVE' else 'BENIGN' end as disposition_code, detected_ts as open_ts, case when i % 2 = 0 then detected_ts end as close_ts from ({_PLACE('alert_id', 'alerts')})")
_SEEN = "(select distinct entity_id, asset_id from alerts)"
_b.add("map_10_derived_assets", lambda t: submission.derived_assets(t.alerts), f"select entity_id, asset_id, lower(replace(asset_id, ' ', '-')) || '.corp' as hostname, case when i % 2 = 0 then 'high' else 'medium' end as criticality, 'production' as environment, case when i % 2 = 0 then 'linux' else 'windows' end as os_family, i % 3 = 0 as internet_facing from ({_PLACE('asset_id', _SEEN)})")
_b.add("map_11_derived_telemetry", lambda t: submission.derived_telemetry(t.alerts, AS_OF), f"select entity_id, 'TEL-' || entity_id || '-' || asset_id as telemetry_id, asset_id, 'edr_sensor' as source, timestamp '{AS_OF}' as observed_ts from {_SEEN}")


def _sent(t) -> dict[str, DataFrame]:
    """Raw tables as entities send them: every third entity has no inventory, every fourth no cases, none has telemetry; some rows lack what they need."""
    at = lambda df: df.join(t.registry.select("entity_id", "nk"), "entity_id")
    return {
        "alerts": _raw(t).withColumn("Host ID", F.when(F.col("Alert-ID").endswith("3"), F.lit(None)).otherwise(F.col("Host ID"))),
        "assets": at(t.assets).filter("nk % 3 > 0").select("entity_id", "asset_id", F.col("hostname").alias("Host Name"), F.nullif("criticality", F.lit("low")).alias("Asset Criticality"), F.col("environment").alias("env"), F.col("os_family").alias("OS"), F.col("internet_facing").cast("string").alias("Internet Exposed"), F.lit("x").alias("extra")),
        "cases": at(t.cases).filter("nk % 4 > 0").select("entity_id", F.col("case_id").alias("Incident ID"), F.col("severity_norm").alias("Priority"), F.expr("case when ok % 10 = 0 then 'gone away' else lower(status) end").alias("State"), F.date_format("open_ts", "yyyy-MM-dd HH:mm:ss").alias("Opened"), F.date_format("close_ts", "yyyy-MM-dd HH:mm:ss").alias("Closed")),
        "investigations": t.investigations.select("entity_id", F.col("investigation_id").alias("id"), "case_id", F.col("notes").alias("Comments")),
        "escalations": t.escalations.select("entity_id", "escalation_id", "case_id", F.lower("from_tier").alias("source_tier"), F.col("to_tier").alias("target tier")),
    }


def _submitted(t) -> submission.Submission:
    return submission.materialize(_sent(t), "run", AS_OF, stage=True)


_SUBMITTED = [
    "kr as (select r.nk, x.* from cases x join registry r using (entity_id))",
    "ar as (select r.nk, x.* from assets x join registry r using (entity_id))",
    "al as (select r.nk, x.*, alert_id like '%3' as bad from alerts x join registry r using (entity_id))",
    "sent as (select entity_id, 'alerts' as record_type, bad from al union all select entity_id, 'assets', criticality = 'low' from ar where nk % 3 > 0 "
    "union all select entity_id, 'assets', false from (select distinct entity_id, asset_id from al where nk % 3 = 0 and not bad) "
    "union all select entity_id, 'cases', ok % 10 = 0 from kr where nk % 4 > 0 union all select entity_id, 'cases', false from al where nk % 4 = 0 "
    "union all select entity_id, 'investigations', false from investigations union all select entity_id, 'escalations', false from escalations "
    "union all select entity_id, 'telemetry', false from (select distinct entity_id, asset_id from al where not bad))",
]
_b.add("map_13_submission", lambda t: _submitted(t).report.drop("times_unread"), "select entity_id, record_type, count(*) as total_rows, count(*) filter (where not bad) as valid_rows, count(*) filter (where bad) as quarantined_rows from sent group by 1, 2", *_SUBMITTED)
_b.add("map_13_rejected", lambda t: _submitted(t).rejected.groupBy("entity_id", "record_type", "reason_code").agg(F.sum("copies").alias("n")), "select entity_id, record_type, case when record_type = 'cases' then 'ENUM_INVALID' else 'REQUIRED_MISSING' end as reason_code, count(*)::bigint as n from sent where bad group by 1, 2", *_SUBMITTED)
_b.add("map_13_assets", lambda t: _submitted(t).tables["assets"].select("entity_id", "asset_id", "hostname", "criticality", "environment", "os_family", "internet_facing"),
       f"select entity_id, asset_id, hostname, criticality, environment, os_family, internet_facing from ar where nk % 3 > 0 and criticality <> 'low' union all select entity_id, asset_id, lower(asset_id) || '.corp', case when i % 2 = 0 then 'high' else 'medium' end, 'production', case when i % 2 = 0 then 'linux' else 'windows' end, i % 3 = 0 from ({_PLACE('asset_id', '(select distinct entity_id, asset_id from al where nk % 3 = 0 and not bad)')})", *_SUBMITTED)
_three = lambda t: {"alerts": t.alerts, "cases": t.cases.drop("ok", "alert_ids"), "investigations": t.investigations}
_b.add("rpt_02_quality", lambda t: records.quality(_three(t), ingest.quarantine(_checked(t), "run")),
       "select entity_id, total, greatest(0, total - bad) as valid, bad as quarantined, round(bad / greatest(1, total), 4) as quarantine_rate, empty as null_cells, case when bad > 0 then 'partial feed' else '-' end as top_reason from (select entity_id, sum(n)::bigint as total, sum(e)::bigint as empty, sum(b)::bigint as bad from (select entity_id, 1 as n, (alert_id is null)::int + (asset_id is null)::int + (title is null)::int + (severity_norm is null)::int + (status is null)::int + (category is null)::int + (analyst_id is null)::int + (detected_ts is null)::int + (ack_ts is null)::int + (ingest_ts is null)::int as e, 0 as b from alerts "
       "union all select entity_id, 1, (asset_id is null)::int + (severity_norm is null)::int + (status is null)::int + (tier is null)::int + (reopen_count is null)::int + (analyst_id is null)::int + (alert_ref is null)::int + (is_duplicate_of is null)::int + (open_ts is null)::int + (detected_ts is null)::int + (ack_ts is null)::int + (disposition_code is null)::int + (close_ts is null)::int, (reason is not null)::int from checked "
       "union all select entity_id, 1, (case_id is null)::int + (analyst_id is null)::int + (notes is null)::int, 0 from investigations) group by 1)", CHECKED)
_b.add("src_09_entities", lambda t: records.entities(t.registry, t.alerts), "select distinct entity_id from alerts")
_b.add("src_17_quarantine_rate", lambda t: records.quarantine_rates(ingest.quarantine(_checked(t), "run"), t.alerts), "select entity_id, round(coalesce(b, 0) / greatest(1, coalesce(n, 0)), 6) as quarantine_rate from (select entity_id, count(*) as n from alerts group by 1) full join (select entity_id, count(*) as b from checked where reason is not null group by 1) using (entity_id)", CHECKED)
_b.add("scr_06_windows", lambda t: records.window_labels(t.registry, t.alerts), "select entity_id, coalesce(strftime(min(detected_ts), '%Y-%m-%d') || '..' || strftime(max(detected_ts), '%Y-%m-%d'), 'unknown') as \"window\" from registry left join alerts using (entity_id) group by 1")
_b.add("snk_04_upsert", lambda t: sinks.upsert(t.assets.filter("cast(asset_id as int) % 2 = 0").withColumn("hostname", F.lit("new")), t.assets, "asset_id").select("asset_id", "hostname"), "select asset_id, case when asset_id::int % 2 = 0 then 'new' else hostname end as hostname from assets")

_b.add("scr_05_ranking", lambda t: _scored(t).select("entity_id", "queue", "rank", "score", "completeness", "confidence"))
_runs = lambda t: t.registry.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seq"), "entity_id", "nk").filter("nk % 4 <> seq % 4 or nk % 5 = 0").select(F.concat(F.lit("run-"), "seq").alias("run_id"), "seq", "entity_id")
_b.add("scr_09_novelty", lambda t: scoring.novelty(t.registry, _runs(t)),
       "select r.entity_id, coalesce(min(case when not seen then 4 - seq end), 4) as streak, case when coalesce(min(case when not seen then 4 - seq end), 4) >= 2 then round(pow(0.4::double, coalesce(min(case when not seen then 4 - seq end), 4) - 1), 6) else 1.0::double end as novelty from (select entity_id, seq, (nk % 4 <> seq % 4 or nk % 5 = 0) as seen from registry cross join (select unnest([1, 2, 3, 4]) as seq)) r group by 1")
_b.add("scr_10_coverage_gap", lambda t: scoring.coverage_gap(t.registry, t.registry.filter("nk % 3 > 0").select("entity_id", F.expr("timestamp '2024-01-20 00:00:00' - interval '1' day * (nk * 2)").alias("ts")), "2024-02-01 00:00:00"), "select entity_id, case when nk % 3 = 0 or nk * 2 + 12 > 30 then 1.25::double else 1.0::double end as coverage_gap from registry")
_b.add("scr_12_review_queue", lambda t: scoring.review_queue(_scored(t), scoring.novelty(t.registry, _runs(t)), scoring.coverage_gap(t.registry, t.registry.select("entity_id", F.expr("timestamp '2024-01-20 00:00:00'").alias("ts")).limit(0), "2024-02-01 00:00:00")))
_hist = lambda t: t.cases.groupBy("entity_id", F.year("open_ts").alias("seq")).agg(share(F.col("status") == "CLOSED").alias("score"))
_b.add("scr_14_trends", lambda t: scoring.trends(_hist(t)), "select entity_id, count(*) as windows, case when count(*) < 2 then 'INSUFFICIENT_HISTORY' when max(step) < 0 then 'IMPROVING' when min(step) > 0 then 'WORSENING' else 'STABLE' end as direction from (select *, sign(score - lag(score) over (partition by entity_id order by seq)) as step from (select entity_id, year(open_ts) as seq, avg(case when status = 'CLOSED' then 1.0::double else 0 end) as score from cases group by 1, 2)) group by 1")
_b.add("scr_14_signal_changes", lambda t: scoring.signal_changes(found(t).filter("is_flagged"), found(t).filter("value >= threshold * 0.5 and not insufficient_data")), "select coalesce(a.entity_id, b.entity_id) as entity_id, coalesce(a.signal_id, b.signal_id) as signal_id, case when b.entity_id is null then 'NEW' when a.entity_id is null then 'RESOLVED' else 'PERSISTENT' end as state from (select * from results where is_flagged) a full join (select * from results where value >= threshold * 0.5 and not insufficient_data) b on a.entity_id = b.entity_id and a.signal_id = b.signal_id", *RESULTS)
_b.add("scr_15_drill_down", lambda t: scoring.drill_down(found(t)).select("entity_id", F.size("domains").alias("n_domains"), F.to_json("domains").alias("domains")))


def _labelled(spark, d) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score"))


_DL = "with x as (select l.quality as label, least(1.0::double, d.n_chars / 4000) as p from labels l join documents d using (doc_id)) "
_b.add_raw("scr_16_17_calibration", lambda s, d: scoring.calibrate(r := _labelled(s, d), scoring.train_calibrator(r)).select("doc_id", "calibrated", F.round("calibrated_score", 3).alias("calibrated_score")))
_b.add_raw("scr_18_brier", lambda s, d: scoring.brier(_labelled(s, d).withColumnRenamed("score", "p")), _DL + "select round(avg((p - label) * (p - label)), 6) as brier from x")
_b.add_raw("scr_18_reliability", lambda s, d: scoring.reliability(_labelled(s, d).withColumnRenamed("score", "p")), _DL + "select cast(b.bin as int) as bin, round((b.bin + 0.5) / 10, 6)::double as centre, round(coalesce(avg(x.label::double), 0.0), 6) as positive, count(x.label) as n from (select unnest(range(10)) as bin) b left join x on least(floor(x.p * 10), 9) = b.bin group by b.bin")
_b.add_raw("scr_19_fingerprint", lambda s, d: scoring.fingerprint(_labelled(s, d)))

# Evidence

_FACTS = [
    q.CX, q.EXPECT, q.SPACE, q.DAYS, q.DETREND,
    "be as (select distinct entity_id, case_id from (select *, lag(close_ts, 49) over (partition by entity_id, coalesce(analyst_id, 'UNKNOWN'), coalesce(disposition_code, 'UNKNOWN') order by close_ts, case_id) as f from cases where close_ts is not null) where epoch_us(close_ts) - epoch_us(f) <= 60000000)",
    "f_cases as (select x.* exclude (m), x.m as minutes, coalesce(hour(x.close_ts) >= 22 or hour(x.close_ts) < 6, false) as night, x.alert_ref is not null as has_alert, be.case_id is not null as burst_end, x.case_id as row_id from cx x left join be on be.entity_id = x.entity_id and be.case_id = x.case_id)",
    f"f_alerts as (select *, coalesce({q.LATE}, false) as late, alert_id as row_id from alerts)",
    "f_investigations as (select *, investigation_id as row_id from investigations)",
    "f_escalations as (select e.*, coalesce(e.accepted_ts is null and k.status = 'CLOSED' and k.tier = e.from_tier, false) as nowhere, e.escalation_id as row_id from escalations e left join cases k on k.entity_id = e.entity_id and k.case_id = e.case_id)",
    "f_assets as (select a.*, upper(criticality) in ('HIGH', 'CRITICAL') as critical, internet_facing as facing, not exists (select 1 from alerts x where x.entity_id = a.entity_id and x.asset_id = a.asset_id) as silent, not exists (select 1 from telemetry x where x.entity_id = a.entity_id and x.asset_id = a.asset_id and x.source in ('firewall', 'ids')) as blind, asset_id as row_id from assets a)",
    "f_space as (select *, asset_id || '/' || expected_source as row_id from space)",
    "f_days as (select *, row_number() over (partition by entity_id order by day desc) as back, cast(day as varchar) as row_id from detrend)",
    "fe as (select entity_id, cast(time_bucket(interval '7 days', detected_ts, timestamp '1970-01-01') as date) as w, count(*) as cnt from alerts group by 1, 2)",
    "f_feed as (select *, row_number() over (partition by entity_id order by w desc) as back, cast(w as varchar) as row_id from fe)",
    "er as (" + " union all ".join(f"select entity_id, '{r.signal_id}' as signal_id, case when coalesce({r.supports}, false) then 'supports' else 'counters' end as side, row_id from f_{r.table} where {r.among}" for r in evidence.RULES) + ")",
    "ev5 as (select entity_id, signal_id, side, row_id from (select *, row_number() over (partition by entity_id, signal_id, side order by row_id) as k from er) where k <= 5)",
]
_MEMBERS = "mb as (select * from (values " + ", ".join(f"('{c}', '{m}')" for c, (_, tree) in signals.COMPOSITES.items() for m in signals.members(tree) if m != "high_band") + ") v(composite, member))"
_BUNDLES = [
    _MEMBERS, "al5 as (select * from ev5 union all select r.entity_id, m.composite, case when r.is_flagged then 'supports' else 'counters' end, m.member from results r join mb m on m.member = r.signal_id)",
    "bu as (select entity_id, signal_id, count(*) filter (where side = 'supports') as ns, count(*) filter (where side = 'counters') as nc, coalesce(string_agg(row_id, '|' order by row_id) filter (where side = 'supports'), '') as ids from al5 group by 1, 2)",
    "co as (select a.entity_id, a.signal_id, count(*) as n_peers, median(b.value) as median, count(*) filter (where b.value < a.value) / count(*) as share_below from results a join results b on a.signal_id = b.signal_id and a.entity_id <> b.entity_id group by 1, 2)",
]


@lru_cache(maxsize=4)
def _rows(t) -> DataFrame:
    """The evidence rows of a query's tables; written, five for and against each finding."""
    return written(evidence.evidence_rows(_stored(t)), "evidence-rows")


_b.add("exp_01_evidence_rows", lambda t: _rows(t).select("entity_id", "signal_id", "side", "row_id"), "select * from ev5", *_FACTS)
_TABLE_OF = {r.signal_id: r.table for r in evidence.RULES}
_KIND = "case " + " ".join(f"when signal_id in ({', '.join(repr(i) for i, x in _TABLE_OF.items() if x == k)}) then '{k}'" for k in ("alerts", "cases") if k in _TABLE_OF.values()) + " end"
_b.add("scr_11_samples", lambda t: scoring.sample_ids(_rows(t), t.alerts.filter("cast(alert_id as int) % 3 > 0"), _TABLE_OF).select("entity_id", "signal_id", F.array_join("alert_ids", ",").alias("alert_ids"), F.array_join("case_ids", ",").alias("case_ids")),
       "select entity_id, signal_id, coalesce(string_agg(row_id, ',' order by h) filter (where kind = 'alerts'), '') as alert_ids, coalesce(string_agg(row_id, ',' order by h) filter (where kind = 'cases'), '') as case_ids from (select *, sha256('42|' || signal_id || if(kind = 'alerts', ':alert', ':case') || '|' || row_id) as h from (select distinct entity_id, signal_id, row_id, " + _KIND + " as kind from ev5 where side = 'supports')) x where kind = 'cases' or (kind = 'alerts' and exists (select 1 from alerts a where a.entity_id = x.entity_id and a.alert_id = x.row_id and a.alert_id::int % 3 > 0)) group by 1, 2", *_FACTS)
_b.add("exp_02_bundles", lambda t: evidence.bundles(found(t), _rows(t)).select("entity_id", "signal_id", F.size("supporting").cast("long").alias("n_supporting"), F.size("counter").cast("long").alias("n_counter"), "absent_reason", "counter_none_reason", "cohort.n_peers", "cohort.median", "cohort.share_below", "evidence_id"),
       "select r.entity_id, r.signal_id, coalesce(ns, 0) as n_supporting, coalesce(nc, 0) as n_counter, case when coalesce(ns, 0) = 0 then if(insufficient_data, 'not enough rows', 'no row supports this signal') end as absent_reason, case when coalesce(nc, 0) = 0 then 'no counter-examples in window' end as counter_none_reason, n_peers, round(median, 6) as median, round(share_below, 6) as share_below, sha256(coalesce(ids, '')) as evidence_id from results r left join bu using (entity_id, signal_id) left join co using (entity_id, signal_id)", *RESULTS, *[c for c in _FACTS if c not in RESULTS], *_BUNDLES)
_b.add("exp_05_reasons", lambda t: evidence.reasons(found(t)).select("entity_id", "signal_id", "code", "label", "sentence"))
_logged = lambda r: audit.build_chain(r.filter("is_flagged").select(F.col("entity_id").alias("run_id"), F.row_number().over(temporal.Window.partitionBy("entity_id").orderBy("signal_id")).alias("seq"), F.lit("2024-02-01 00:00:00").alias("ts"), F.lit("FINDING").alias("event_type"), F.to_json(F.struct("finding_id")).alias("payload_json")))
_b.add("exp_12_explain", lambda t: evidence.explain(r := found(t), evidence.bundles(r, _rows(t)), _scored(t), _logged(r)).select("entity_id", "signal_id", "code", F.size("supporting").cast("long").alias("n_supporting"), "clearing_value", F.col("confidence").isNotNull().alias("has_confidence"), F.col("audit_seq").cast("long").alias("audit_seq")),
       f"select r.entity_id, r.signal_id, 'RC-' || r.signal_id as code, coalesce(e.ns, 0) as n_supporting, case when not insufficient_data and is_flagged and r.signal_id like 'EG-%' then round(threshold - greatest(abs(threshold), 1.0) * 1e-6, 6) end as clearing_value, true as has_confidence, l.audit_seq from results r left join bu e on e.entity_id = r.entity_id and e.signal_id = r.signal_id left join (select entity_id, signal_id, row_number() over (partition by entity_id order by signal_id) as audit_seq from results where is_flagged) l on l.entity_id = r.entity_id and l.signal_id = r.signal_id", *RESULTS, *[c for c in _FACTS if c not in RESULTS], *_BUNDLES[:3])
_b.add("exp_06_composite_members", lambda t: evidence.composite_members(found(t)), "select entity_id, composite, coalesce(string_agg(case when is_flagged then signal_id end, ',' order by signal_id), '') as fired, coalesce(string_agg(case when not is_flagged then signal_id end, ',' order by signal_id), '') as counter from results join (" + " union all ".join(f"select '{c}' as composite, '{m}' as member" for c, (_, tr) in signals.COMPOSITES.items() for m in signals.members(tr) if m != "high_band") + ") m on m.member = signal_id group by 1, 2", *RESULTS)
_b.add("exp_08_counterfactuals", lambda t: evidence.counterfactuals(found(t)).select("entity_id", "signal_id", "clearing_value", "reason"), "select entity_id, signal_id, case when not insufficient_data and is_flagged and signal_id like 'EG-%' then round(threshold - greatest(abs(threshold), 1.0) * 1e-6, 6) end as clearing_value, case when insufficient_data then 'insufficient data' when not is_flagged then 'not firing' when signal_id not like 'EG-%' then 'not a single measure' end as reason from results", *RESULTS)
_b.add("exp_10_narratives", lambda t: evidence.narratives(r := found(t), evidence.bundles(r, _rows(t))).select("entity_id", "signal_id", "narrative"))
_b.add("exp_11_guard_cited", lambda t: evidence.guard_cited(evidence.narratives(r := found(t), b := evidence.bundles(r, _rows(t))).select("finding_id", F.col("narrative").alias("text")), b).join(r.select("finding_id", "entity_id", "signal_id"), "finding_id").select("entity_id", "signal_id", "failed"),
       "select entity_id, signal_id, null::varchar as failed from results where is_flagged", *RESULTS)
_b.add_raw("exp_11_guard", lambda s, d: evidence.guard(s.read.parquet(f"{d}/documents.parquet"), "doc_id"),
           f"select doc_id, case when regexp_matches(text, '{evidence.PERSONAL}') then 'personal data' when regexp_matches(text, '{evidence.PRESCRIPTIVE}') then 'prescriptive' when length(text) > 4000 then 'too long' end as failed from documents")
_b.add("cov_07_cells", lambda t: coverage.coverage_cells(coverage.negative_space(t.assets, t.telemetry), found(t)).drop("finding_id"), "select entity_id, asset_id, expected_source, gap_flag, case when gap_flag then 'gap' else 'ok' end as css, linked_signal from space left join (select entity_id, min(signal_id) as linked_signal from results where is_flagged and signal_id like 'NS-%' group by 1) using (entity_id) order by entity_id, asset_id, expected_source limit 500", *RESULTS)

# Audit

_events = lambda t: t.escalations.select(F.col("entity_id").alias("run_id"), F.row_number().over(temporal.Window.partitionBy("entity_id").orderBy("escalation_id")).alias("seq"), F.date_format("escalated_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit("ESCALATED").alias("event_type"), F.to_json(F.struct("entity_id", "case_id")).alias("payload_json"))
LEDGER = ["ev as (select entity_id as run_id, row_number() over (partition by entity_id order by escalation_id) as seq, strftime(escalated_ts, '%Y-%m-%d %H:%M:%S') as ts, '{\"entity_id\":\"' || entity_id || '\",\"case_id\":\"' || case_id || '\"}' as payload from escalations)",
          f"ch(run_id, seq, h) as (select run_id, seq, sha256('{audit.GENESIS}' || '||' || payload || '||' || seq || '||' || ts || '||' || run_id || '||ESCALATED') from ev where seq = 1 union all select c.run_id, e.seq, sha256(c.h || '||' || e.payload || '||' || e.seq || '||' || e.ts || '||' || e.run_id || '||ESCALATED') from ch c join ev e on e.run_id = c.run_id and e.seq = c.seq + 1)"]
_b.add("aud_01_chain", lambda t: audit.build_chain(_events(t)).select("run_id", F.col("seq").cast("long").alias("seq"), "entry_hash"), "select run_id, seq, h as entry_hash from ch", *LEDGER)
_b.add("aud_02_verify", lambda t: audit.verify_chain(audit.build_chain(_events(t)).withColumn("payload_json", F.when(F.expr("seq = 7"), F.lit("{}")).otherwise(F.col("payload_json")))).select("run_id", "n", "ok", F.col("first_broken_seq").cast("long").alias("first_broken_seq")), "select run_id, count(*) as n, count(*) < 7 as ok, case when count(*) >= 7 then 7::bigint end as first_broken_seq from ev group by 1", LEDGER[0])
_b.add("aud_03_reconcile", lambda t: audit.reconcile(e := _events(t), e.filter("seq <> 5")).select("run_id", F.col("first_difference").cast("long").alias("first_difference")), "select run_id, case when count(*) >= 5 then 5::bigint end as first_difference from ev group by 1", LEDGER[0])
_b.add("aud_04_05_manifest", lambda t: audit.manifest(audit.build_chain(_events(t)), "unit-key"))
# One chain over all runs, its mirror, and look-ups of stored results

_all_events = lambda t: _events(t).drop("seq")
CHAIN_ALL = ["ea as (select row_number() over (order by ts, run_id, payload) - 1 as seq, run_id, ts, payload from ev)",
             f"ca(seq, run_id, h) as (select seq, run_id, sha256('{audit.GENESIS}' || '||' || payload || '||' || seq || '||' || ts || '||' || run_id || '||ESCALATED') from ea where seq = 0 union all select c.seq + 1, e.run_id, sha256(c.h || '||' || e.payload || '||' || e.seq || '||' || e.ts || '||' || e.run_id || '||ESCALATED') from ca c join ea e on e.seq = c.seq + 1)"]


def _ledger(t) -> str:
    path = shared_dir(t.escalations.sparkSession, "ledger")
    early = written(_all_events(t), "events")
    cut = early.agg(F.percentile(F.unix_timestamp("ts"), F.lit(0.5)).cast("timestamp").cast("string")).first()[0] or ""
    ledger.append(early.filter(F.col("ts") < cut), path, "first")
    ledger.append(early.filter(F.col("ts") >= cut), path, "second")
    return path


def _mirrored(t) -> DataFrame:
    spark, path, mirror = t.escalations.sparkSession, _ledger(t), shared_dir(t.escalations.sparkSession, "mirror")
    for part, rows in ((0, ledger.read(spark, path).filter("part = 0 and seq % 3 <> 1")), (7_000_000, ledger.read(spark, path).limit(2))):
        rows.drop("part").write.parquet(f"{mirror}/part={part}")
    ledger.rebuild_mirror(spark, path, mirror)
    return ledger.read(spark, mirror).select("seq", "run_id", "entry_hash")


_b.add("aud_01_ledger", lambda t: ledger.read(t.escalations.sparkSession, _ledger(t)).select("seq", "run_id", "entry_hash"), "select seq, run_id, h as entry_hash from ca", LEDGER[0], *CHAIN_ALL)
_b.add("aud_02_ledger_verify", lambda t: ledger.verify(ledger.read(t.escalations.sparkSession, _ledger(t)).withColumn("run_id", F.when(F.expr("seq = 11"), F.lit("?")).otherwise(F.col("run_id")))), "select count(*) as n, count(*) < 12 as ok, case when count(*) >= 12 then 11::bigint end as first_broken_seq from ev", LEDGER[0])
_b.add("aud_03_mirror", _mirrored, "select seq, run_id, h as entry_hash from ca", LEDGER[0], *CHAIN_ALL)
_b.add("aud_04_merkle", lambda t: ledger.merkle_roots(audit.build_chain(_events(t))), "select run_id, h as merkle_root from lv where n = 1", *LEDGER,
       "lv(run_id, i, h, n) as (select run_id, seq - 1, h, count(*) over (partition by run_id) from ch union all select c.run_id, c.i // 2, sha256(unhex(min_by(c.h, c.i)) || unhex(max_by(c.h, c.i))), (any_value(c.n) + 1) // 2 from lv c where c.n > 1 group by c.run_id, c.i // 2)")
_ROW = ["finding_id", "entity_id", "signal_id", "value", "score", "severity", "confidence", "is_flagged"]


def _index(t) -> versions.VersionedTable:
    spark = t.cases.sparkSession
    index = versions.finding_index(spark, shared_dir(spark, "findings"))
    for run in ("run-1", "run-2", "run-2"):
        index.upsert(found(t).select(*_ROW).withColumn("run_id", F.lit(run)).filter((F.col("run_id") == "run-2") | F.col("is_flagged")), run)
    return index


def _looked_up(t) -> DataFrame:
    """All findings of one entity, by their ids."""
    index, spark = _index(t), t.cases.sparkSession
    ids = [*(x.id for x in signals.SIGNALS), *signals.COMPOSITES]  # ids of the rules
    keys = spark.createDataFrame([(i,) for i in ids], "s string").select(finding_id(F.col("s"), F.lit("NATION_7"), F.lit("")).alias("k")).collect()
    return index.lookup([r["k"] for r in keys]).select("run_id", "entity_id", "signal_id", "score", "is_flagged")


_RUNS = "ru as (select 'run-1' as run_id, entity_id, signal_id, score, is_flagged from results where is_flagged union all select 'run-2', entity_id, signal_id, score, is_flagged from results)"
_b.add("snk_09_finding_index", lambda t: _index(t).read().select("run_id", "entity_id", "signal_id", "score", "is_flagged"), "select run_id, entity_id, signal_id, round(score, 6) as score, is_flagged from ru", *RESULTS, _RUNS)
_b.add("rpt_11_finding_lookup", _looked_up, "select run_id, entity_id, signal_id, round(score, 6) as score, is_flagged from ru where entity_id = 'NATION_7'", *RESULTS, _RUNS)
_b.add("aud_06_verify_runs", lambda t: audit.verify_runs(audit.build_chain(_events(t))), "select distinct run_id, true as all_ok from ev", LEDGER[0])

# Validation against planted labels: the planted entities by signal, as text "signal:key,key".
PLANTED = {"EG-002": (6, 14, 22), "EG-003": (8, 16), "EG-008": (19,), "EG-009": (3, 9, 15, 21), "EG-011": (5, 15, 23), "EG-012": (12, 20), "EG-013": (11,), "EG-014": (13, 21), "EG-006": (7,), "NS-010": (2, 10, 18), "NS-001": (3, 17)}


def labels(t) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(s).alias("signal_id"), F.array(*map(F.lit, ks)).alias("keys")) for s, ks in PLANTED.items()))
    d = t.registry.select("entity_id", "nk", F.inline(pairs))
    return d.select("entity_id", "signal_id", F.concat(F.lit("S"), F.col("nk") % 3).alias("scenario_id"), F.when(F.array_contains("keys", F.col("nk")), "HIGH").otherwise("LOW").alias("severity"), F.lit("").alias("note"))


LABELS = "lab as (select r.entity_id, p.signal_id, 'S' || (r.nk % 3) as scenario_id, list_contains(p.keys, r.nk) as positive from registry r cross join (" + " union all ".join(f"select '{s}' as signal_id, {list(k)} as keys" for s, k in PLANTED.items()) + ") p)"
CELLS = "cel as (select coalesce(a.entity_id, b.entity_id) as entity_id, coalesce(a.signal_id, b.signal_id) as signal_id, a.entity_id is not null as predicted, b.entity_id is not null as actual from (select * from results where is_flagged) a full join (select * from lab where positive) b on a.entity_id = b.entity_id and a.signal_id = b.signal_id)"
_V = [*RESULTS, LABELS, CELLS]
_flag = lambda t: found(t).filter("is_flagged")
_b.add("vld_01_expected", lambda t: validation.expected(labels(t)), "select entity_id, signal_id from lab where positive", LABELS)
_b.add("vld_04_ranked", lambda t: validation.ranked(_flag(t)).select("entity_id", "signal_id", F.col("rank").cast("long").alias("rank")), "select entity_id, signal_id, row_number() over (order by list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) desc, round(score, 9) desc, entity_id, signal_id) as rank from results where is_flagged", *_V)
_b.add("vld_05_precision", lambda t: validation.precision_at(_flag(t), validation.expected(labels(t))))
_b.add("vld_06_recall", lambda t: validation.by_scenario(labels(t), _flag(t)), "select scenario_id, count(*) filter (where positive) as positives, count(*) filter (where positive and is_flagged) as hits, round(coalesce(count(*) filter (where positive and is_flagged) / nullif(count(*) filter (where positive), 0), 1.0), 6) as recall from (select l.*, coalesce(r.is_flagged, false) as is_flagged from lab l left join results r using (entity_id, signal_id)) group by 1", *_V)
_FAM = "case when signal_id like 'NS-%' then 'negative_space' when signal_id like 'COMP-%' then 'composite' else 'execution_gap' end"
_b.add("vld_07_family", lambda t: validation.family_scores(_flag(t), validation.expected(labels(t))), f"select family, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from (select {_FAM} as family, coalesce(count(*) filter (where predicted and actual) / nullif(count(*) filter (where predicted), 0), 1.0) as p, coalesce(count(*) filter (where predicted and actual) / nullif(count(*) filter (where actual), 0), 1.0) as r from cel group by 1)", *_V)
_b.add("vld_10_compare", lambda t: validation.compare(_flag(t), labels(t)))
_b.add("vld_11_ablation", lambda t: validation.ablate(_flag(t), labels(t)), f"select disabled, round(avg(predicted::int::double), 6) as baseline, round(avg((predicted and {_FAM} <> disabled)::int::double), 6) as recall, round(avg(predicted::int::double) - avg((predicted and {_FAM} <> disabled)::int::double), 6) as drop from cel cross join (select unnest(['execution_gap', 'negative_space', 'composite']) as disabled) where actual group by 1", *_V)
_b.add("vld_12_disagreements", lambda t: validation.disagreements(_flag(t), labels(t)), "select entity_id, signal_id, case when predicted then 'flagged_only' else 'expected_only' end as kind from cel where predicted <> actual", *_V)

# Reports

_b.add("rpt_01_findings", lambda t: reports.findings_table(r := found(t), evidence.bundles(r, _rows(t)), evidence.counterfactuals(r)).select("entity_id", "signal_id", "severity", "score", "n_supporting", "clearing_value"))
_IDS = [*(x.id for x in signals.SIGNALS), *signals.COMPOSITES]
_plain = lambda i: i.lower().replace("-", "_")
_b.add("rpt_07_heatmap", lambda t: reports.heatmap(found(t), _IDS).toDF("entity_id", *map(_plain, _IDS)), "select entity_id, " + ", ".join(f"round(max(score) filter (where signal_id = '{i}'), 6) as {_plain(i)}" for i in _IDS) + " from results group by 1", *RESULTS)
_b.add("rpt_08_latency_histogram", lambda t: reports.latency_histogram(t.cases), f"select entity_id, cast(least(bins - 1, coalesce(floor((x - lo) / nullif((hi - lo) / bins, 0)), 0)) as int) as bin, count(*) as n from (select entity_id, x, min(x) over w as lo, max(x) over w as hi, least(20, greatest(5, floor(count(*) over w / 5))) as bins from (select entity_id, {mins('open_ts', 'close_ts')} as x from cases) where x >= 0 window w as (partition by entity_id)) group by 1, 2")
_b.add("rpt_09_entities", lambda t: reports.select_rows(t.registry.select("entity_id", "sector"), ["entity_id"], sector="ASIA"), "select entity_id, sector from registry where sector = 'ASIA'")

QUERIES, ORACLES = _b.queries, _b.oracles
