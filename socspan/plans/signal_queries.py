"""Queries of the signals and composites, with their SQL."""

from __future__ import annotations

from ..functions.tables import written
from ..operators import signals
from ..operators.signals import COMPOSITES, SIGNALS
from ..params import SEVERITY_RANK
from . import entity_queries as q
from .common import Book

_b = Book()

_RANK = "case severity_norm " + " ".join(f"when '{k}' then {v}" for k, v in SEVERITY_RANK.items()) + " end"
CTES = [
    q.CX, q.RATES, q.CHAIN, q.DEPTH, *q.TFIDF, q.EXPECT, q.SPACE, q.COVER, q.DAYS, q.DETREND,
    "game as (select r.entity_id, (r.closure_rate >= g.a)::int + (r.reopen_rate >= g.b)::int + (r.root_cause_rate <= g.c)::int as gaming, g.n as n_peers from rates r cross join (select quantile_cont(closure_rate, 0.75) as a, quantile_cont(reopen_rate, 0.75) as b, quantile_cont(root_cause_rate, 0.25) as c, count(*) - 1 as n from rates) g)",
    f"al as (select entity_id, count(*) as n_alerts, {q.sh(q.LATE)} as backfill_rate, avg({_RANK}) as alert_rank from alerts group by 1)",
    f"cr as (select entity_id, avg({_RANK}) as case_rank from cases group by 1)",
    "bn as (select *, lag(close_ts, 49) over (partition by entity_id, analyst_id, disposition_code order by close_ts, case_id) as start from cases where close_ts is not null)",
    "bm as (select entity_id, max(case when epoch_us(close_ts) - epoch_us(start) <= 60000000 then 50 else 0 end) as burst_max from bn group by 1)",
    "es as (select e.entity_id, count(*) as n_escalations, " + q.sh("e.accepted_ts is null and k.status = 'CLOSED' and k.tier = e.from_tier") + " as nowhere_rate from escalations e left join cases k on k.entity_id = e.entity_id and k.case_id = e.case_id group by 1)",
    "cv as (select a.entity_id, a.category_missing::double as value, b.category_missing::double as peer from cover a join cover b on a.entity_id <> b.entity_id)",
    "cs as (select entity_id, any_value(value) as value, median(peer) as med, quantile_cont(peer, 0.75) - quantile_cont(peer, 0.25) as iqr, max(peer) - min(peer) as span from cv group by 1)",
    "cz as (select s.entity_id, case when m.mad > 0 then 0.6745 * (s.value - s.med) / m.mad when s.iqr > 0 then 0.7413 * (s.value - s.med) / s.iqr when s.span > 0 then (s.value - s.med) / s.span else 0.0 end as category_z from cs s join (select cv.entity_id, median(abs(cv.peer - cs.med)) as mad from cv join cs using (entity_id) group by 1) m using (entity_id))",
    "ac as (select a.entity_id, count(*) as n_assets, count(*) filter (where crit) as n_critical_assets, count(*) filter (where crit and not alerted) as critical_silent, count(*) filter (where internet_facing) as n_facing, count(*) filter (where internet_facing and not alerted) as facing_silent, bool_or(upper(criticality) = 'HIGH') as high_band, count(*) filter (where internet_facing and not perimeter) as perimeter_blind from (select a.*, upper(criticality) in ('HIGH', 'CRITICAL') as crit, exists (select 1 from alerts x where x.entity_id = a.entity_id and x.asset_id = a.asset_id) as alerted, exists (select 1 from telemetry t where t.entity_id = a.entity_id and t.asset_id = a.asset_id and t.source in ('firewall', 'ids')) as perimeter from assets a) a group by 1)",
    "act as (select entity_id, count(*) as n_days, avg(residual) filter (where back <= 7) as residual_mean_7, coalesce(nullif(stddev_samp(residual), 0), 1.0) as residual_std from (select *, row_number() over (partition by entity_id order by day desc) as back from detrend) group by 1)",
    "fw as (select entity_id, time_bucket(interval '7 days', detected_ts, timestamp '1970-01-01') as w, count(*) as cnt from alerts group by 1, 2)",
    "fb as (select entity_id, max(k) as n_windows, max_by(mean, k) as feed_baseline, max_by(cnt, k) as feed_now from (select *, row_number() over (partition by entity_id order by w) as k, avg(cnt) over (partition by entity_id order by w rows between 3 preceding and current row) as mean from fw) group by 1)",
]

_PARTS = {
    "game.gaming gaming|game.n_peers n_peers": "game",
    "coalesce(n_alerts,0) n_alerts|coalesce(backfill_rate,0) backfill_rate|coalesce(alert_rank,0) alert_rank": "al",
    "case_rank case_rank": "cr",
    "coalesce(burst_max,0) burst_max": "bm",
    "coalesce(depths.depth,0) chain_depth": "depths",
    "coalesce(sm.n,0) n_notes|coalesce(sm.similarity,0) template_similarity": "sm",
    "coalesce(n_escalations,0) n_escalations|coalesce(nowhere_rate,0) nowhere_rate": "es",
    "telemetry_gap_ratio telemetry_gap_ratio|silence_max silence_max|tactic_coverage tactic_coverage|expected_absent_count expected_absent_count|space_rows space_rows": "cover",
    "coalesce(category_z,0) category_z": "cz",
    "n_assets n_assets|n_critical_assets n_critical_assets|critical_silent critical_silent|n_facing n_facing|facing_silent facing_silent|high_band high_band|perimeter_blind perimeter_blind": "ac",
    "coalesce(n_days,0) n_days|coalesce(residual_mean_7,0) residual_mean_7|residual_std residual_std": "act",
    "coalesce(n_windows,0) n_windows|feed_baseline feed_baseline|coalesce(feed_now,0) feed_now": "fb",
}


def wide(only: set[str] | None = None) -> list[str]:
    """The CTEs up to m, the inputs of the signals that read the columns named by only."""
    columns, joins = [], []
    for part, table in _PARTS.items():
        mine = [c.rsplit(" ", 1) for c in part.split("|")]
        if only is None or only & {name for _, name in mine}:
            columns += [f"{x} as {name}" for x, name in mine]
            joins.append(f"left join {table} using (entity_id)")
    return [*CTES, "m as (select r.entity_id, r.feed_explanation <> '' as feed_explained, rates.* exclude (entity_id), " + ", ".join(columns) + ", case when mean_hours > 0 then std_hours / mean_hours else 0.0 end as cv from registry r left join rates using (entity_id) " + " ".join(joins) + ")"]


def rule(s: signals.Signal) -> str:
    """The result rows of a signal, from m."""
    gate = f"coalesce({(s.gate or s.n + ' >= {min_n}').format(min_n=5, perfect_min=10)}, false)"
    value = f"case when {gate} then coalesce(cast({s.value} as double), 0.0) else 0.0 end"
    flag = s.flag or f"{value} >= {s.threshold}"
    return (f"select entity_id, high_band, '{s.id}' as signal_id, {value} as value, {float(s.threshold)}::double as threshold, cast({s.n} as bigint) as sample_size, {gate} and coalesce({flag}, false) as is_flagged, "
            f"case when {gate} then least(1.0, greatest(0.0, {value} / {s.threshold})) else 0.0 end as score, case when {gate} then '{s.severity}' else 'INFO' end as severity, case when {gate} then '{s.confidence}' else 'LOW' end as confidence, not {gate} as insufficient_data from m")


COLUMNS = ["entity_id", "signal_id", "value", "threshold", "sample_size", "is_flagged", "score", "severity", "confidence", "insufficient_data"]
SELECT = "entity_id, signal_id, round(value, 6) as value, threshold, sample_size, is_flagged, round(score, 6) as score, severity, confidence, insufficient_data"
RESULTS = "results as (" + " union all ".join(map(rule, SIGNALS)) + ")"


def _inputs(s: signals.Signal):
    return lambda t: signals.evaluate(signals.metrics(t, only=signals.needed([s])), signals=[s]).select(*COLUMNS)


for _s in SIGNALS:
    _b.add("sig_" + _s.id.lower().replace("-", "_"), _inputs(_s), f"select {SELECT} from ({rule(_s)})", *wide(signals.needed([_s])))
_b.add("sig_all", lambda t: signals.evaluate(written(signals.metrics(t.stored()), "signal-inputs")).select(*COLUMNS), f"select {SELECT} from results", *wide(), RESULTS)


def _tree(t) -> str:
    if isinstance(t, str):
        return "bool_or(high_band)" if t == "high_band" else f"bool_or(signal_id = '{t}' and is_flagged)"
    return "(" + f" {t[0]} ".join(map(_tree, t[1:])) + ")"


_ORDER = "list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1"


def composite(comp: str) -> str:
    tree = COMPOSITES[comp][1]
    ids = [x for x in signals.members(tree) if x != "high_band"]
    mine = "signal_id in (" + ", ".join(f"'{i}'" for i in ids) + ") and is_flagged"
    return (f"select entity_id, '{comp}' as signal_id, case when {_tree(tree)} then 1.0::double else 0.0 end as value, {_tree(tree)} as is_flagged, count(*) filter (where {mine}) as members_fired, "
            f"case when count(*) filter (where {mine}) = 0 then 'LOW' else ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(0, max({_ORDER}) filter (where {mine}) - case when count(*) filter (where {mine}) < {len(ids)} then 1 else 0 end) + 1] end as severity, "
            f"coalesce(['LOW', 'MEDIUM', 'HIGH'][min(list_position(['LOW', 'MEDIUM', 'HIGH'], confidence)) filter (where {mine})], 'LOW') as confidence from results group by entity_id")


for _c, (_, _t) in COMPOSITES.items():
    _m = [x for x in SIGNALS if x.id in signals.members(_t)]
    _b.add("sig_" + _c.lower().replace("-", "_"), lambda t, c=_c, m=_m: signals.composites(signals.evaluate(signals.metrics(t, only=signals.needed(m)), signals=m), {c: COMPOSITES[c]}).selectExpr("entity_id", "signal_id", "value", "is_flagged", "cast(members_fired as bigint) as members_fired", "severity", "confidence"),
           composite(_c), *wide(signals.needed(_m)), "results as (" + " union all ".join(map(rule, _m)) + ")")

QUERIES, ORACLES = _b.queries, _b.oracles
