"""Confidence, samples for review and the portfolio (SCR-08, SCR-11, SCR-13)."""

import hashlib

from socspan.operators import peers, scoring


def test_confidence_names_its_grounds(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.95), ("d", 0.4), ("e", 1.0), ("f", 1.0)], "entity_id string, adequate_share double")
    complete = spark.createDataFrame([("a", 0.95, 0.0), ("b", 0.95, 0.0), ("c", 0.95, 0.2), ("d", 0.95, 0.0), ("e", 0.5, 0.0), ("f", 0.95, 0.0)], "entity_id string, completeness double, null_share double")
    sizes = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False), ("e", False)], "entity_id string, fell_back boolean")
    got = {x.entity_id: x for x in scoring.confidence(scores, complete, sizes).collect()}
    assert {k: x.confidence for k, x in got.items()} == {"a": "HIGH", "b": "HIGH", "c": "MEDIUM", "d": "LOW", "e": "LOW", "f": "MEDIUM"}
    assert [k for k, x in got.items() if x.capped] == ["e"]
    assert got["a"].confidence_reason == "completeness 0.95; 100% of signals have enough rows; cohort large enough for comparison; missing values 0.0%"
    assert "all entities" in got["b"].confidence_reason and "no peer comparison" in got["f"].confidence_reason


def test_cohort_sizes_count_others(spark):
    reg = spark.createDataFrame([(f"e{i}", "big" if i < 6 else None) for i in range(8)], "entity_id string, cohort_id string")
    got = {x.entity_id: (x.cohort_n, x.fell_back) for x in peers.cohort_sizes(reg).collect()}
    assert got["e0"] == (5, False) and got["e7"] == (1, True)


def test_samples_are_known_alerts_in_a_drawn_order(spark):
    rows = [("x", "S1", "supports", f"{i}") for i in range(9)] * 2 + [("x", "S1", "counters", "20"), ("x", "S2", "supports", "c1"), ("x", "S3", "supports", "asset")]
    alerts = spark.createDataFrame([("x", f"{i}") for i in range(1, 30)] + [("y", "0")], "entity_id string, alert_id string")
    got = {x.signal_id: x for x in scoring.sample_ids(spark.createDataFrame(rows, "entity_id string, signal_id string, side string, row_id string"), alerts, {"S1": "alerts", "S2": "cases", "S3": "assets"}).collect()}
    want = sorted((str(i) for i in range(1, 9)), key=lambda i: hashlib.sha256(f"42|S1:alert|{i}".encode()).hexdigest())[:5]
    assert got["S1"].alert_ids == want and got["S1"].case_ids == [] and got["S2"].case_ids == ["c1"] and "S3" not in got


def test_portfolio(spark):
    scored = spark.createDataFrame([(f"e{i}", 10.0 * i, "LOW") for i in range(7)], "entity_id string, score double, band string")
    reg = spark.createDataFrame([("e0", "bank"), ("e1", "bank"), ("e2", None)], "entity_id string, sector string")
    read = lambda prior: {(x.kind, x.name): x.value for x in scoring.portfolio(scored, reg, prior).collect()}
    got = read(None)
    assert got[("band", "LOW")] == 7 and got[("band", "HIGH")] == 0 and got[("sector_median", "bank")] == 5 and got[("sector_median", "unknown")] == 40
    assert [k[1] for k in sorted((k for k in got if k[0] == "top"), key=got.get)] == ["e6", "e5", "e4", "e3", "e2"]
    for prior, name in (([27.0], "DETERIORATING"), ([28.0], "STABLE"), ([33.0, 40.0], "IMPROVING"), (None, "STABLE")):
        df = prior and spark.createDataFrame([("e1", x) for x in prior], "entity_id string, score double")
        assert [k[1] for k in read(df) if k[0] == "trend"] == [name]
    assert {k for k in read(None) if k[0] == "trend"} == {("trend", "STABLE")}
