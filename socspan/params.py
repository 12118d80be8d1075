"""Job parameters. Fixed values of the analysis, stated once; pass a changed copy to a job to override them."""

from __future__ import annotations

from dataclasses import dataclass

# Enumerations.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN"]
STATUSES = ["OPEN", "ACKED", "TRIAGED", "CLOSED", "REOPENED"]
DISPOSITIONS = ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN", "DUPLICATE", "INCONCLUSIVE"]
TIERS = ["T1", "T2", "T3"]
TAXONOMY = ["MALWARE", "PHISHING", "INTRUSION", "POLICY_VIOLATION", "VULNERABILITY", "DATA_EXFIL", "OTHER"]
TACTICS = ["MALWARE", "INTRUSION", "DATA_EXFIL"]

# Lookups.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0, "UNKNOWN": -1}
SEVERITY_MAP = {"P1": "CRITICAL", "P2": "HIGH", "P3": "MEDIUM", "P4": "LOW", "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "MED": "MEDIUM", "LOW": "LOW", "INFO": "INFO", "INFORMATIONAL": "INFO"}
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.85, "MEDIUM": 0.60, "LOW": 0.35, "INFO": 0.15, "UNKNOWN": 0.30}
#: Expected telemetry by criticality|environment|os|internet-facing; edr for any other profile.
EXPECTED_SOURCES = {
    "high|production|linux|true": ["edr", "firewall", "ids", "auth"],
    "high|production|windows|true": ["edr", "firewall", "ids", "auth", "sysmon"],
    "high|production|linux|false": ["edr", "auth"],
    "medium|production|linux|true": ["edr", "firewall", "auth"],
    "medium|production|windows|true": ["edr", "firewall", "auth"],
    "medium|staging|linux|false": ["edr"],
    "medium|production|linux|false": ["edr", "auth"],
    "low|development|linux|false": ["edr"],
}
EXPECTED_DEFAULT = ["edr"]
DOMAIN_WEIGHTS = {"detection_coverage": 0.20, "investigation_quality": 0.20, "escalation_integrity": 0.15, "operational_discipline": 0.15, "governance": 0.10, "peer_divergence": 0.10, "negative_space": 0.10}
#: Notes that say nothing.
PLACEHOLDER = r"(?i)^\s*(n/?a|none|-|done|checked|see above|as above|ok|tbd)\s*\.?\s*$|\b(see above|as above)\b"


@dataclass(frozen=True)
class Params:
    """Thresholds and windows of a run; as_of stands for the clock, so that results don't depend on it."""

    cases_as_of: str = "2002-01-01 00:00:00"
    alerts_as_of: str = "2024-02-01 00:00:00"
    days: float = 30.0
    min_n: int = 5
    burst_seconds: int = 60
    burst_count: int = 50
    premature_minutes: int = 5
    sla_hours: int = 72
    reopens: int = 2
    orphan_hours: int = 72
    backfill_days: int = 30
    night_start: int = 22
    night_end: int = 6
    future_seconds: int = 60
    copy_paste: float = 0.9
    cohort_min: int = 5
    cohort_penalty: float = 0.20
    cohort_penalty_most: float = 0.40
    breadth_k: float = 0.8
    trailing_windows: int = 4
    window_days: int = 7
    baseline_days: int = 84
    perfect_min: int = 10


DEFAULT = Params()
