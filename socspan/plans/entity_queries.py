"""Queries of the temporal, workflow, text, coverage, asset and peer operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import coverage, peers, temporal, text, vectors, workflow
from ..params import DEFAULT, EXPECTED_SOURCES, PLACEHOLDER, SEVERITIES, TAXONOMY, TIERS, Params
from .common import Book

_b = Book()

# Shared SQL. mins() is minutes between two times; share() is the share of rows.
def mins(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 6e7)"


def sh(cond: str, among: str = "true") -> str:
    return f"coalesce(avg(case when {cond} then 1.0::double else 0.0 end) filter (where {among}), 0.0)"


ALERTS_AS_OF, CASES_AS_OF = "timestamp '2024-02-01 00:00:00'", "timestamp '2002-01-01 00:00:00'"
CX = "cx as (select k.*, e.case_id is not null as escalated, " + mins("k.open_ts", "k.close_ts") + " as m from cases k left join (select distinct entity_id, case_id from escalations) e on e.entity_id = k.entity_id and e.case_id = k.case_id)"
RATES = (
    "rates as (select entity_id, count(*) as n_cases, count(close_ts) as n_closed, count(*) filter (where severity_norm = 'CRITICAL') as n_critical, count(*) filter (where severity_norm = 'CRITICAL' and close_ts is not null) as n_critical_closed, "
    + sh("m >= 0 and m < 5", "severity_norm = 'CRITICAL' and close_ts is not null") + " as premature_rate, "
    + sh("reopen_count >= 2") + " as reopen_rate, " + sh("not escalated", "severity_norm = 'CRITICAL'") + " as bypass_rate, "
    + sh("m / 60 > 72", "close_ts is not null") + " as sla_breach_rate, " + sh("hour(close_ts) >= 22 or hour(close_ts) < 6", "close_ts is not null") + " as night_fraction, "
    + sh("isodow(detected_ts) >= 6", "detected_ts is not null") + " as weekend_fraction, " + sh("alert_ref is null") + " as orphan_case_rate, "
    + sh("disposition_code = 'DUPLICATE'") + " as duplicate_share, " + sh("status = 'CLOSED'") + " as closure_rate, " + sh("disposition_code = 'TRUE_POSITIVE'") + " as root_cause_rate, "
    + sh("m / 60 <= 72", "m >= 0") + " as sla_met, avg(m / 60) filter (where m >= 0) as mean_hours, stddev_samp(m / 60) filter (where m >= 0) as std_hours, "
    + ", ".join(f"coalesce(avg(m) filter (where tier = '{t}'), 0.0) as tier_dwell_{t}" for t in TIERS) + ", "
    + ", ".join(sh(f"severity_norm = '{s}'") + f" as case_share_{s}" for s in SEVERITIES) + " from cx group by 1)"
)
AVG3 = lambda c: f"round(coalesce(avg({c}), 0.0), 6) as {c}_mean, round(coalesce(median({c}), 0.0), 6) as {c}_median, round(coalesce(quantile_cont({c}, 0.9), 0.0), 6) as {c}_p90"
R = lambda *cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)

# Scalars

_b.add("fn_times_and_guards", lambda t: t.alerts.select("alert_id", fn.to_utc(F.date_format("detected_ts", "yyyy-MM-dd HH:mm:ss")).alias("at"), fn.minutes_between(F.col("detected_ts"), F.col("ack_ts")).alias("minutes"), fn.clamp01(fn.minutes_between(F.col("detected_ts"), F.col("ack_ts")) / 60).alias("clamped"), fn.clean_float(F.when(F.col("status") == "OPEN", F.lit(float("nan"))).otherwise(F.lit(2.0))).alias("cleaned")),
       "select alert_id, date_trunc('second', detected_ts) as at, round(" + mins("detected_ts", "ack_ts") + ", 6) as minutes, round(least(1.0, greatest(0.0, " + mins("detected_ts", "ack_ts") + " / 60)), 6) as clamped, case when status = 'OPEN' then 0.0::double else 2.0::double end as cleaned from alerts")
_b.add("fn_hashes", lambda t: t.assets.select("asset_id", fn.pseudonym(F.col("hostname"), "unit-salt").alias("pseudonym"), fn.evidence_id(F.array("hostname", "asset_id", "entity_id")).alias("evidence_id"), fn.strip_formula(F.concat(F.lit("=+@"), "hostname")).alias("plain"), fn.finding_id(F.lit("EG-001"), F.col("asset_id"), F.lit("w")).substr(15, 1).alias("uuid_version"), fn.hmac_matches(F.col("hostname"), "key", fn.hmac_sha256(F.col("hostname"), "key")).alias("signed")),
       "select asset_id, sha256(hostname || 'unit-salt') as pseudonym, sha256(array_to_string(list_sort([hostname, asset_id, entity_id]), '|')) as evidence_id, hostname as plain, '5' as uuid_version, true as signed from assets")
_b.add("fn_tokens", lambda t: t.investigations.select("investigation_id", F.size(fn.tokens(F.col("notes"))).alias("n_tokens"), F.array_join(F.slice(fn.tokens(F.col("notes")), 1, 3), " ").alias("first_three")),
       "select investigation_id, cast(len(regexp_extract_all(lower(notes), '[a-z0-9]+')) as int) as n_tokens, array_to_string(regexp_extract_all(lower(notes), '[a-z0-9]+')[1:3], ' ') as first_three from investigations")

# Temporal

_b.add("tmp_01_alert_latency", lambda t: temporal.alert_latencies(t.alerts).select("alert_id", "is_future", *temporal.LATENCIES),
       f"select alert_id, greatest(detected_ts, ack_ts) > {ALERTS_AS_OF} + interval 60 second as is_future, case when not greatest(detected_ts, ack_ts) > {ALERTS_AS_OF} + interval 60 second then round({mins('detected_ts', 'ack_ts')}, 6) end as ack_latency, null::double as triage_duration, null::double as investigation_duration, null::double as total_dwell, null::double as close_latency_after_ack from alerts")
_b.add("tmp_02_case_duration", lambda t: temporal.case_durations(t.cases).select("case_id", "case_duration", "reopen_gap"),
       "select case_id, round(d, 6) as case_duration, case when reopen_count > 0 then round(reopen_count * coalesce(median(d) over (partition by entity_id), 0.0), 6) end as reopen_gap from (select *, case when m >= 0 then m end as d from cx)", CX)
_b.add("tmp_03_bursts", lambda t: temporal.bursts(t.cases).select("entity_id", "analyst_id", "disposition_code", "burst_size", "burst_duration", "window_start", "max_window_count"),
       """, pick(entity_id, analyst_id, disposition_code, k) as (
         select entity_id, analyst_id, disposition_code, min(k) from ready group by all
         union all
         select p.entity_id, p.analyst_id, p.disposition_code, (select min(r.k) from ready r where r.entity_id = p.entity_id and r.analyst_id = p.analyst_id and r.disposition_code = p.disposition_code and r.k >= p.k + 50) from pick p where p.k is not null)
       select p.entity_id, p.analyst_id, p.disposition_code, 50 as burst_size, round((epoch_us(r.close_ts) - epoch_us(r.start)) / 1e6, 6) as burst_duration, r.start as window_start, n.most as max_window_count
       from pick p join ready r on r.entity_id = p.entity_id and r.analyst_id = p.analyst_id and r.disposition_code = p.disposition_code and r.k = p.k join near n on n.entity_id = p.entity_id and n.analyst_id = p.analyst_id and n.disposition_code = p.disposition_code""",
       "numbered as (select *, row_number() over w as k, lag(close_ts, 49) over w as start, count(*) over (partition by entity_id, analyst_id, disposition_code order by close_ts range between interval 60 second preceding and current row) as near_n from cases where close_ts is not null window w as (partition by entity_id, analyst_id, disposition_code order by close_ts, case_id))",
       "ready as (select * from numbered where epoch_us(close_ts) - epoch_us(start) <= 60000000)",
       "near as (select entity_id, analyst_id, disposition_code, max(near_n) as most from numbered group by all)")
_b.oracles["tmp_03_bursts"] = _b.oracles["tmp_03_bursts"].replace("with registry as", "with recursive registry as", 1).replace("\n, pick(", ",\npick(")
_b.add("tmp_04_time_profile", lambda t: temporal.time_profile(t.cases),
       "select entity_id, part, cast(bin as int) as bin, round(n / sum(n) over (partition by entity_id, part), 6) as share from (select entity_id, part, bin, count(*)::double as n from (select entity_id, 'hour' as part, hour(close_ts) as bin from cases where close_ts is not null union all select entity_id, 'weekday', isodow(close_ts) - 1 from cases where close_ts is not null) group by all)")
_b.add("tmp_05_latency_summary", lambda t: temporal.latency_summary(temporal.case_durations(t.cases), ["case_duration", "reopen_gap"]),
       "select entity_id, " + AVG3("case_duration") + ", " + AVG3("reopen_gap") + " from (select entity_id, case when m >= 0 then m end as case_duration, case when reopen_count > 0 then reopen_count * median(case when m >= 0 then m end) over (partition by entity_id) end as reopen_gap from cx) group by 1", CX)
_b.add("tmp_05_ack_summary", lambda t: temporal.latency_summary(temporal.alert_latencies(t.alerts), ["ack_latency"]),
       f"select entity_id, {AVG3('ack_latency')} from (select entity_id, case when not greatest(detected_ts, ack_ts) > {ALERTS_AS_OF} + interval 60 second then {mins('detected_ts', 'ack_ts')} end as ack_latency from alerts) group by 1")

# Workflow and entity rates

_b.add("wfl_01_escalation_rate", lambda t: workflow.escalation_rates(t.cases, t.escalations), "select entity_id, severity_norm, round(count(distinct case when escalated then case_id end) / count(distinct case_id), 6) as rate from cx group by 1, 2", CX)
_b.add("wfl_02_bypass_rate", lambda t: workflow.bypass_rate(t.cases, t.escalations), "select entity_id, round(bypass_rate, 6) as bypass_rate from rates", CX, RATES)
_b.add("wfl_03_tier_dwell", lambda t: workflow.tier_dwell(t.cases), "select entity_id, " + R(*(f"tier_dwell_{x}" for x in TIERS)) + " from rates", CX, RATES)
_b.add("wfl_04_reopen_rate", lambda t: workflow.reopen_rate(t.cases), "select entity_id, round(reopen_rate, 6) as reopen_rate from rates", CX, RATES)
CHAIN = "chain(entity_id, case_id, next, depth) as (select entity_id, case_id, is_duplicate_of, 1 from cases where is_duplicate_of is not null union all select c.entity_id, c.case_id, k.is_duplicate_of, c.depth + 1 from chain c join cases k on k.entity_id = c.entity_id and k.case_id = c.next where k.is_duplicate_of is not null and c.depth < 50)"
DEPTH = "depths as (select entity_id, max(depth) + 1 as depth from chain group by 1)"
_b.add("wfl_05_duplicate_depth", lambda t: workflow.duplicate_depth(t.cases), "select entity_id, cast(depth as bigint) as depth from depths", CHAIN, DEPTH)
_b.add("wfl_06_orphan_cases", lambda t: workflow.orphan_cases(t.cases).select("entity_id", "case_id"), "select entity_id, case_id from cases where alert_ref is null")
LOST = f"lost as (select a.* from alerts a where not exists (select 1 from cases k where k.entity_id = a.entity_id and k.alert_ref = a.alert_id) and ({mins('a.detected_ts', ALERTS_AS_OF)} > 72 * 60 or a.detected_ts is null))"
_b.add("wfl_07_orphan_alerts", lambda t: workflow.orphan_alerts(t.alerts, t.cases).select("entity_id", "alert_id"), "select entity_id, alert_id from lost", LOST)
LATE = mins("detected_ts", "ingest_ts") + " > 30 * 1440"
_b.add("wfl_08_backfill", lambda t: workflow.backfilled(t.alerts).select("entity_id", "alert_id"), f"select entity_id, alert_id from alerts where {LATE}")
SUMMARY = ("summary as (select r.entity_id, e.escalation_rate, r.bypass_rate, r.reopen_rate, r.orphan_case_rate, r.tier_dwell_T1, r.tier_dwell_T2, r.tier_dwell_T3, coalesce(d.depth, 0) as duplicate_chain_depth, coalesce(l.n / a.n, 0.0) as orphan_alert_rate, coalesce(a.backfill_rate, 0.0) as backfill_rate "
           "from rates r left join (select entity_id, avg(rate) as escalation_rate from (select entity_id, severity_norm, count(distinct case when escalated then case_id end) / count(distinct case_id) as rate from cx group by 1, 2) group by 1) e using (entity_id) "
           f"left join (select entity_id, count(*)::double as n, {sh(LATE)} as backfill_rate from alerts group by 1) a using (entity_id) left join (select entity_id, count(*)::double as n from lost group by 1) l using (entity_id) left join depths d using (entity_id))")
_b.add("wfl_09_summary", lambda t: workflow.workflow_summary(t.cases, t.escalations, t.alerts),
       "select entity_id, cast(duplicate_chain_depth as bigint) as duplicate_chain_depth, " + R("escalation_rate", "bypass_rate", "reopen_rate", "orphan_case_rate", "tier_dwell_T1", "tier_dwell_T2", "tier_dwell_T3", "orphan_alert_rate", "backfill_rate") + " from summary", CX, RATES, CHAIN, DEPTH, LOST, SUMMARY)
_b.add("ent_01_04_case_rates", lambda t: workflow.case_rates(t.cases, t.escalations), "select entity_id, n_cases, n_closed, n_critical, n_critical_closed, " + R("premature_rate", "reopen_rate", "bypass_rate", "sla_breach_rate", "night_fraction", "weekend_fraction", "orphan_case_rate", "duplicate_share", "closure_rate", "root_cause_rate", "sla_met", "mean_hours", "std_hours", *(f"tier_dwell_{x}" for x in TIERS), *(f"case_share_{s}" for s in SEVERITIES)) + " from rates", CX, RATES)

# Text

RICH = "t as (select entity_id, analyst_id, investigation_id, notes, regexp_extract_all(lower(notes), '[a-z0-9]+') as w from investigations)"
_b.add("txt_04_richness", lambda t: t.investigations.groupBy("entity_id").agg(F.coalesce(F.avg(text.richness()), F.lit(0.0)).alias("vocabulary_richness")), "select entity_id, round(coalesce(avg(case when len(w) > 0 then len(list_distinct(w)) / len(w) * (0.5 + 0.5 * least(1.0, len(w) / 50.0::double)) end), 0.0), 6) as vocabulary_richness from t group by 1", RICH)
_b.add("txt_06_placeholder", lambda t: t.investigations.groupBy("entity_id").agg(fn.share(text.is_placeholder()).alias("placeholder_ratio")), "select entity_id, round(" + sh(f"regexp_matches(notes, '^\\s*$') or regexp_matches(notes, '{PLACEHOLDER}')") + ", 6) as placeholder_ratio from investigations group by 1")
TFIDF = [
    "nt as (select entity_id, investigation_id as id, lower(case when trim(regexp_replace(notes, '\\s+', ' ', 'g')) = '' then 'empty note placeholder' else notes end) as x from investigations)",
    "wd as (select entity_id, id, regexp_extract_all(x, '\\w\\w+') as w, regexp_replace(x, '\\s\\s+', ' ', 'g') as c from nt)",
    "gr as (select entity_id, id, 'w' as kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from wd union all select entity_id, id, 'c', unnest(list_concat(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)), list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)))) from wd)",
    "tf as (select entity_id, kind, id, g, count(*) as n from gr group by all)",
    "df as (select entity_id, kind, g, count(*) as df from tf group by all)",
    "nn as (select entity_id, count(*)::double as n from nt group by 1)",
    "wt as (select tf.*, (1 + ln(tf.n)) * (ln((1 + nn.n) / (1 + df.df)) + 1) as w from tf join df using (entity_id, kind, g) join nn using (entity_id))",
    "nm as (select entity_id, kind, id, sqrt(sum(w * w)) as norm from wt group by all)",
    "pr as (select entity_id, kind, sum(s * s) as sq from (select wt.entity_id, wt.kind, wt.g, sum(wt.w / nm.norm) as s from wt join nm using (entity_id, kind, id) group by all) group by all)",
    "sm as (select nn.entity_id, nn.n, case when nn.n > 1 then least(1.0, greatest(0.0, sum(pr.sq - o.n1) / 2 / (nn.n * (nn.n - 1)))) else 0.0 end as similarity from nn join pr using (entity_id) join (select entity_id, kind, count(*) as n1 from nm group by all) o using (entity_id, kind) group by nn.entity_id, nn.n)",
]
_b.add("txt_01_note_similarity", lambda t: text.note_similarity(t.investigations, ["entity_id"]), "select entity_id, cast(n as bigint) as n_notes, round(similarity, 6) as similarity from sm", *TFIDF)
_b.add("txt_02_analyst_similarity", lambda t: text.note_similarity(t.investigations, ["entity_id", "analyst_id"]), "select k.entity_id, k.analyst_id, cast(n as bigint) as n_notes, round(similarity, 6) as similarity from sm join (select distinct entity_id, analyst_id from investigations) k on k.entity_id || '/' || k.analyst_id = sm.entity_id", *[TFIDF[0].replace("select entity_id, inv", "select entity_id || '/' || analyst_id as entity_id, inv"), *TFIDF[1:]])
_b.add_raw("txt_03_embedding_similarity", lambda s, d: text.embedding_similarity(s.read.parquet(f"{d}/embeddings.parquet"), ["label"]),
           "with v as (select label, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select label, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from v), n as (select label, count(*) as n, count(*) filter (where norm > 0) as n1 from u group by 1), e as (select label, generate_subscripts(v, 1) as i, unnest(v) / norm as x from u where norm > 0), s as (select label, sum(s * s) as sq from (select label, i, sum(x) as s from e group by all) group by 1) select n.label, n.n as n_vectors, case when n.n > 1 then round((s.sq - n.n1) / (n.n * (n.n - 1)), 6) else 0.0 end as similarity from n left join s using (label)")
COPY = [
    RICH,
    "st as (select entity_id, investigation_id as id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from t)",
    "ex as (select entity_id, id, len(s) as k, unnest(s) as g from st)",
    "cm as (select a.entity_id, a.id, b.id as id2, a.k, b.k as k2, count(*) as common from ex a join ex b on a.entity_id = b.entity_id and a.g = b.g and a.id < b.id group by all)",
    "cp as (select st.entity_id, case when count(*) > 1 then coalesce(max(h.hits), 0) / (count(*) * (count(*) - 1) / 2) else 0.0 end as copy_paste_ratio from st left join (select entity_id, count(*)::double as hits from cm where common >= 0.9 * (k + k2 - common) group by 1) h on h.entity_id = st.entity_id group by 1)",
]
_b.add("txt_05_copy_paste", lambda t: text.copy_paste(t.investigations, ["entity_id"]), "select entity_id, round(copy_paste_ratio, 6) as copy_paste_ratio from cp", *COPY)
_b.add("txt_07_summary", lambda t: text.text_summary(t.investigations))
_b.add_raw("txt_07_documents_copy_paste", lambda s, d: text.copy_paste(s.read.parquet(f"{d}/documents.parquet").select("lang", F.col("text").alias("notes")), ["lang"]))
_b.add("txt_08_vectors", lambda t: vectors.text_vectors(t.investigations, "investigation_id"))
_b.add("txt_09_topics", lambda t: text.topic_table(text.topics(t.investigations, "investigation_id").join(t.investigations, "investigation_id")))
_b.add("txt_10_labels", lambda t: text.topic_labels(t.investigations.select(F.col("entity_id").alias("topic"), "notes")),
       "select topic, term, round(weight, 6) as weight, rank from (select topic, term, weight, row_number() over (partition by topic order by round(weight, 9) desc, term) as rank from (select f.topic, f.term, sum(f.c * (ln((1 + n.total) / (1 + d.df)) + 1)) / max(m.members) as weight from f join d using (term) join m using (topic) cross join n group by 1, 2)) where rank <= 8",
       "x as (select entity_id as topic, investigation_id as id, unnest(regexp_extract_all(lower(notes), '[a-z0-9]+')) as term from investigations)", "f as (select topic, id, term, count(*) as c from x group by all)", "d as (select term, count(*) as df from f group by 1)", "m as (select entity_id as topic, count(*) as members from investigations group by 1)", "n as (select count(*)::double as total from investigations)")

# Coverage and assets

EXPECT = "expected as (select a.*, coalesce(p.sources, ['edr']) as sources from assets a left join (" + " union all ".join(f"select '{k}' as profile, {v!r} as sources" for k, v in EXPECTED_SOURCES.items()) + ") p on p.profile = lower(a.criticality) || '|' || a.environment || '|' || a.os_family || '|' || a.internet_facing)"
SPACE = "space as (select x.entity_id, x.asset_id, x.expected_source, x.critical, not exists (select 1 from telemetry t where t.entity_id = x.entity_id and t.asset_id = x.asset_id and t.source = x.expected_source) as gap_flag from (select entity_id, asset_id, unnest(sources) as expected_source, upper(criticality) in ('HIGH', 'CRITICAL') as critical from expected) x)"
_b.add("cov_01_expected_sources", lambda t: coverage.expected_sources(t.assets).select("entity_id", "asset_id", F.array_join("expected", ",").alias("expected")), "select entity_id, asset_id, array_to_string(sources, ',') as expected from expected", EXPECT)
_b.add("cov_02_negative_space", lambda t: coverage.negative_space(t.assets, t.telemetry), "select entity_id, asset_id, expected_source, not gap_flag as observed, gap_flag, cast(case when gap_flag then 30 else 0 end as int) as silence_days, critical from space", EXPECT, SPACE)
DAYS = "days as (select entity_id, cast(detected_ts as date) as day, count(*) as cnt from alerts where detected_ts is not null group by 1, 2)"
DETREND = "detrend as (select *, cnt - median(cnt) over (partition by entity_id order by day rows between 83 preceding and current row) as residual from days)"
_b.add("cov_03_detrended", lambda t: coverage.detrended(coverage.daily_alerts(t.alerts)), "select entity_id, day, cnt, round(residual, 6) as residual from detrend", DAYS, DETREND)
COVER = ("cover as (select r.entity_id, coalesce(g.gap_assets / greatest(1, c.n), 0.0) as telemetry_gap_ratio, coalesce(g.silence, 0.0) as silence_max, 7 - coalesce(k.n_cats, 0) as category_missing, 1 - (7 - coalesce(k.n_cats, 0)) / 7.0::double as category_coverage, coalesce(k.n_tactics, 0) / 3.0::double as tactic_coverage, coalesce(g.absent, 0) as expected_absent_count, coalesce(g.pairs, 0) as space_rows from registry r "
         "left join (select entity_id, count(distinct asset_id) as n from assets where upper(criticality) in ('HIGH', 'CRITICAL') group by 1) c using (entity_id) left join (select entity_id, count(distinct case when critical and gap_flag then asset_id end)::double as gap_assets, max(case when gap_flag then 30.0::double else 0 end) as silence, count(*) filter (where gap_flag) as absent, count(*) as pairs from space group by 1) g using (entity_id) "
         f"left join (select entity_id, count(distinct category) filter (where category in ({', '.join(map(repr, TAXONOMY))})) as n_cats, count(distinct category) filter (where category in ('MALWARE', 'INTRUSION', 'DATA_EXFIL')) as n_tactics from alerts group by 1) k using (entity_id))")
_b.add("cov_06_summary", lambda t: coverage.coverage_summary(t.registry, t.assets, t.telemetry, t.alerts), "select entity_id, " + R("telemetry_gap_ratio", "silence_max", "category_coverage", "tactic_coverage") + ", cast(category_missing as int) as category_missing, expected_absent_count, space_rows from cover", EXPECT, SPACE, COVER)
_b.add("cov_08_perimeter_blind", lambda t: coverage.perimeter_blind(t.assets, t.telemetry).select("entity_id", "asset_id"), "select entity_id, asset_id from assets a where internet_facing and not exists (select 1 from telemetry t where t.entity_id = a.entity_id and t.asset_id = a.asset_id and t.source in ('firewall', 'ids'))")
_b.add("ast_01_shadow_assets", lambda t: coverage.resolve_assets(t.alerts, t.assets.filter("cast(asset_id as int) % 11 <> 0")).select("entity_id", "asset_id", "criticality"),
       "select entity_id, asset_id, criticality from assets where asset_id::int % 11 <> 0 union all select distinct entity_id, asset_id, 'UNKNOWN' from alerts where asset_id::int % 11 = 0")
_b.add("ast_02_alert_density", lambda t: coverage.alert_density(t.alerts, t.assets), "select a.entity_id, a.asset_id, count(x.alert_id) as n from assets a left join alerts x on x.entity_id = a.entity_id and x.asset_id = a.asset_id group by 1, 2")
ASSETS = ("af as (select a.entity_id, avg(n) / 30 as alert_density_mean, count(*) filter (where crit and n > 0) / greatest(1, count(*) filter (where crit)) as critical_asset_coverage, count(*) filter (where internet_facing and n > 0) / greatest(1, count(*) filter (where internet_facing)) as internet_facing_alert_rate, max(coalesce(k.cased, 0)) / count(*) as case_asset_coverage, 0::bigint as shadow_asset_count, count(*) as asset_count_resolved "
          "from (select a.*, upper(a.criticality) in ('HIGH', 'CRITICAL') as crit, coalesce(x.n, 0) as n from assets a left join (select entity_id, asset_id, count(*) as n from alerts group by 1, 2) x on x.entity_id = a.entity_id and x.asset_id = a.asset_id) a left join (select entity_id, count(distinct asset_id) as cased from cases group by 1) k on k.entity_id = a.entity_id group by 1)")
_b.add("ast_03_asset_features", lambda t: coverage.asset_features(t.alerts, t.cases, t.assets), "select entity_id, " + R("alert_density_mean", "critical_asset_coverage", "internet_facing_alert_rate", "case_asset_coverage") + ", shadow_asset_count, asset_count_resolved from af", ASSETS)

# Peers

_METRICS = ["premature_rate", "reopen_rate", "bypass_rate", "sla_breach_rate", "orphan_case_rate", "duplicate_share"]
LONG = "v as (" + " union all ".join(f"select entity_id, '{m}' as metric, {m} as value from rates" for m in _METRICS) + ")"
Z = [
    "pv as (select a.entity_id, a.metric, a.value, b.value as peer from v a join v b on a.metric = b.metric and a.entity_id <> b.entity_id)",
    "ps as (select entity_id, metric, any_value(value) as value, count(*) as n_peers, median(peer) as med, quantile_cont(peer, 0.75) - quantile_cont(peer, 0.25) as iqr, max(peer) - min(peer) as span from pv group by 1, 2)",
    "pz as (select s.entity_id, s.metric, s.value, s.med, m.mad, s.n_peers, case when m.mad > 0 then 0.6745 * (s.value - s.med) / m.mad when s.iqr > 0 then 0.7413 * (s.value - s.med) / s.iqr when s.span > 0 then (s.value - s.med) / s.span else 0.0 end as z, case when m.mad > 0 then 'MAD' when s.iqr > 0 then 'IQR' when s.span > 0 then 'RANGE' else 'SKIP' end as method from ps s join (select p.entity_id, p.metric, median(abs(p.peer - s.med)) as mad from pv p join ps s on s.entity_id = p.entity_id and s.metric = p.metric group by 1, 2) m on m.entity_id = s.entity_id and m.metric = s.metric)",
]
_b.add("peer_01_modified_z", lambda t: peers.modified_z(peers.long_form(workflow.case_rates(t.cases, t.escalations), _METRICS)), "select entity_id, metric, round(value, 6) as value, round(med, 6) as median, round(mad, 6) as mad, n_peers, round(z, 6) as z, method from pz", CX, RATES, LONG, *Z)
_b.add("peer_02_cohorts", lambda t: peers.cohorts(t.registry), "select entity_id, cohort_id from registry")


def _benchmark(least: int) -> None:
    """PEER-03 with cohorts that count from so many peers on; the regions have four."""
    p = Params(cohort_min=least)
    pairs = "pc as (select a.entity_id, a.metric, a.value, b.value as peer, ra.cohort_id = rb.cohort_id as same from v a join v b on a.metric = b.metric and a.entity_id <> b.entity_id join registry ra on ra.entity_id = a.entity_id join registry rb on rb.entity_id = b.entity_id)"
    size = "cn as (select entity_id, metric, count(*) filter (where same) as n from pc group by 1, 2)"
    used = f"pv as (select entity_id, metric, value, peer from pc join cn using (entity_id, metric) where n < {least} or same)"
    _b.add("peer_03_benchmark" if least == DEFAULT.cohort_min else f"peer_03_cohorts_of_{least}", lambda t: peers.benchmark(workflow.case_rates(t.cases, t.escalations), t.registry, _METRICS, p).select("entity_id", "metric", "value", "z", "method", "cohort_n", "fell_back", "penalty", "percentile_rank"),
           f"select z.entity_id, z.metric, round(z.value, 6) as value, round(z.z, 6) as z, z.method, cn.n as cohort_n, cn.n < {least} as fell_back, case when cn.n >= {least} then 0.0 when cn.n <= 1 then {p.cohort_penalty_most} else {p.cohort_penalty} end::double as penalty, round(k.r, 6) as percentile_rank from pz z join cn using (entity_id, metric) join (select entity_id, metric, count(*) filter (where peer < value) / count(*) as r from pv group by 1, 2) k using (entity_id, metric)", CX, RATES, LONG, pairs, size, used, *Z[1:])


_benchmark(DEFAULT.cohort_min)
_benchmark(4)
_b.add("peer_04_peer_values", lambda t: peers.peer_values(peers.long_form(workflow.case_rates(t.cases, t.escalations), _METRICS)).groupBy("entity_id", "metric").agg(F.count("peer").alias("n"), F.sum("peer").alias("total")), "select entity_id, metric, count(*) as n, round(sum(peer), 6) as total from pv group by 1, 2", CX, RATES, LONG, Z[0])
_b.add("ent_08_benjamini_hochberg", lambda t: peers.benjamini_hochberg(peers.long_form(workflow.case_rates(t.cases, t.escalations), _METRICS).withColumnRenamed("value", "p"), ["entity_id"]),
       "select entity_id, metric, round(p, 6) as p, round(least(1.0, min(raw) over (partition by entity_id order by p, metric rows between current row and unbounded following)), 6) as p_adjusted from (select entity_id, metric, value as p, value * count(*) over (partition by entity_id) / row_number() over (partition by entity_id order by value, metric) as raw from v)", CX, RATES, LONG)

QUERIES, ORACLES = _b.queries, _b.oracles
