"""Evidence bundles, narratives and their guard, and the saved calibrator."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from socspan.operators import evidence, scoring

RESULT = "finding_id string, entity_id string, signal_id string, value double, threshold double, sample_size long, is_flagged boolean, score double, severity string, confidence string, insufficient_data boolean"


def results(spark):
    rows = [("f1", "e", "EG-002", 0.4, 0.15, 9, True, 1.0, "MEDIUM", "MEDIUM", False), ("f2", "x", "EG-002", 0.1, 0.15, 9, False, 0.6, "MEDIUM", "MEDIUM", False), ("f3", "e", "EG-007", 0.0, 1.0, 1, False, 0.0, "INFO", "LOW", True), ("f4", "e", "COMP-003", 1.0, 1.0, 3, True, 1.0, "HIGH", "LOW", False)]
    return spark.createDataFrame(rows, RESULT)


def rows(spark):
    return spark.createDataFrame([("e", "EG-002", "supports", f"c{i}", f'{{"case_id":"c{i}"}}') for i in range(3)] + [("e", "EG-002", "counters", "c9", '{"case_id":"c9"}')], "entity_id string, signal_id string, side string, row_id string, row_json string")


def test_rules_cover_all_signals():
    from socspan.operators.signals import SIGNALS

    assert {r.signal_id for r in evidence.RULES} == {s.id for s in SIGNALS} and {r.table for r in evidence.RULES} <= set(evidence.SHOWN)


def test_rows_are_bounded_and_sided(spark):
    cases = spark.createDataFrame([("e", f"c{i:02d}", i % 3) for i in range(40)] + [("n", None, 2), ("n", "c1", None)], "entity_id string, case_id string, reopen_count int").withColumns({c: F.lit("x") for c in ("severity_norm", "status")})
    t, keep = SimpleNamespace(), evidence.facts
    try:
        evidence.facts = lambda *_: {"cases": cases}
        got = evidence.evidence_rows(t, rules=[r for r in evidence.RULES if r.signal_id == "EG-002"]).collect()
    finally:
        evidence.facts = keep
    by = lambda e, s: sorted((r.row_id for r in got if r.entity_id == e and r.side == s), key=str)
    assert by("e", "supports") == ["c02", "c05", "c08", "c11", "c14"] and by("e", "counters") == ["c00", "c01", "c03", "c04", "c06"]
    assert by("n", "supports") == [None] and by("n", "counters") == ["c1"]


def test_rows_are_cut_down_before_they_are_repeated_for_their_sides(spark):
    rules = [evidence.Rule(f"S{i}", "cases", f"reopen_count % {i + 2} = 0", f"reopen_count % 5 <> {i}") for i in range(4)]
    rows = [(e, f"c{i * 7919 % 1000:03d}", i % 30) for i in range(300) for e in "ab"]
    cases = spark.createDataFrame(rows, "entity_id string, case_id string, reopen_count int").withColumns({c: F.lit("x") for c in ("severity_norm", "status")})
    keep = evidence.facts
    try:
        evidence.facts = lambda *_: {"cases": cases}
        d = evidence.evidence_rows(None, rules=rules)
    finally:
        evidence.facts = keep
    got = {}
    for r in d.collect():
        got.setdefault((r.entity_id, r.signal_id, r.side), []).append(r.row_id)
    want = {}
    for e, c, n in sorted(rows):
        for i in range(4):
            if n % 5 != i:
                want.setdefault((e, f"S{i}", "supports" if n % (i + 2) == 0 else "counters"), []).append(c)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[: evidence.ROWS] for k, v in want.items()}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.rindex("Generate") :]  # printed from the last step to the first


def test_bundles(spark):
    got = {r.finding_id: r for r in evidence.bundles(results(spark), rows(spark)).collect()}
    assert got["f1"].row_ids == ["c0", "c1", "c2"] and got["f1"].counter == ['{"case_id":"c9"}'] and got["f1"].absent_reason is None and got["f1"].counter_none_reason is None
    assert tuple(got["f1"].cohort) == (1, 0.1, 1.0) and got["f2"].absent_reason == "no row supports this signal" and got["f3"].absent_reason == "not enough rows"
    assert got["f4"].counter == ['{"member":"EG-007","is_flagged":false}'] and got["f4"].cohort.n_peers == 0
    assert got["f2"].evidence_id == got["f3"].evidence_id != got["f1"].evidence_id


def test_narratives_pass_their_guard(spark):
    b = evidence.bundles(results(spark), rows(spark))
    texts = evidence.narratives(results(spark), b)
    got = {r.finding_id: r for r in texts.collect()}
    assert set(got) == {"f1", "f4"} and all(r[f].strip() for r in got.values() for f in evidence.FIELDS)
    assert "c0 and c1" in got["f1"].rationale and "median is 0.100" in got["f1"].peer_context and "no other entities" in got["f4"].peer_context
    guarded = evidence.guard_cited(texts.select("finding_id", F.col("narrative").alias("text")), b).collect()
    assert {r.finding_id: r.failed for r in guarded} == {"f1": None, "f4": None}
    assert {r.finding_id: r.narrative for r in evidence.narratives(results(spark), b).collect()} == {k: r.narrative for k, r in got.items()}


@pytest.mark.parametrize("finding, text, failed", [
    ("f1", "see c0 and c1", None), ("f1", "see c0, c1 and c77", "unknown identifier"), ("f1", "see c0 and c9", "fewer than two rows cited"), ("f1", None, "fewer than two rows cited"),
    ("f1", "c0 c1 mail a@b.cd", "personal data"), ("f1", "c0 c1 you must", "prescriptive"), ("f1", "c0 c1 " + "x " * 2500, "too long"), ("f2", "nothing", None), ("f2", "asset12", "unknown identifier"), ("zz", "c0", "unknown identifier"),
])
def test_guard(spark, finding, text, failed):
    texts = spark.createDataFrame([(finding, text)], "finding_id string, text string")
    assert evidence.guard_cited(texts, evidence.bundles(results(spark), rows(spark))).collect() == [(finding, failed)]


def test_saved_calibrator(spark, tmp_path):
    for n in (40, 200):  # logistic, isotonic
        data = spark.createDataFrame([(i / n, int(i * 7 % n > n / 2)) for i in range(n)], "score double, label int")
        model, path = scoring.train_calibrator(data), f"file://{tmp_path}/m{n}"
        assert scoring.load_calibrator(spark, path, data, ["a"]) == (None, "no calibrator")
        scoring.save_calibrator(model, data, ["a", "b"], path)
        again, why = scoring.load_calibrator(spark, path, data.orderBy(F.desc("score")), ["a", "b"])
        assert not why and scoring.calibrate(data, again).collect() == scoring.calibrate(data, model).collect()
        assert scoring.load_calibrator(spark, path, data, ["b", "a"]) == (None, "other features")
        drifted, why = scoring.load_calibrator(spark, path, data.filter("score > 0"), ["a", "b"])
        assert (drifted, why) == (None, "other training rows")
        raw = scoring.calibrate(data.limit(1), drifted).first()
        assert (raw.calibrated_score, raw.calibrated) == (raw.score * 100, False)


def test_a_query_stores_its_tables_once(monkeypatch):
    """signals and evidence rows of a query read the same stored tables; each wrote all of them for itself."""
    from socspan.plans import score_queries as sc

    class Tables:
        times = 0

        def stored(self):
            self.times += 1
            return f"stored {self.times}"

    t, read = Tables(), []
    monkeypatch.setattr(sc.signals, "run_all", read.append)
    monkeypatch.setattr(sc.evidence, "evidence_rows", read.append)
    monkeypatch.setattr(sc, "written", lambda df, name: df)
    sc.found(t)
    sc._rows(t)
    assert read == ["stored 1"] * 2 and t.times == 1
