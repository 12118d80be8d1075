"""Known values on small literal frames."""

import hashlib
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from socspan.functions import scalars as fn
from socspan.operators import audit, coverage, evidence, peers, scoring, signals, temporal, text, validation, workflow
from socspan.sources import ingest, records, sinks, submission

T0 = datetime(2024, 1, 1, 12)


def values(df, key="metric"):
    return {r[key]: r for r in df.collect()}


def test_modified_z(spark):
    rows = [("x", "a", 10.0), *((f"p{i}", "a", float(v)) for i, v in enumerate([8, 9, 9, 10, 11])), ("x", "b", 5.0), *((f"p{i}", "b", float(v)) for i, v in enumerate([2, 2, 2, 4, 6])), ("x", "c", 3.0), *((f"p{i}", "c", 3.0) for i in range(3))]
    v = spark.createDataFrame(rows, "entity_id string, metric string, value double")
    z = values(peers.modified_z(v).filter("entity_id = 'x'"))
    assert (z["a"]["median"], z["a"]["mad"], z["a"]["method"]) == (9, 1, "MAD") and math.isclose(z["a"]["z"], 0.6745)
    assert z["b"]["method"] == "IQR" and (z["c"]["method"], z["c"]["z"]) == ("SKIP", 0)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("e", m, p) for m, p in zip("abc", (0.01, 0.04, 0.5), strict=True)], "entity_id string, metric string, p double")
    got = values(peers.benjamini_hochberg(df, ["entity_id"]))
    assert [round(got[m]["p_adjusted"], 9) for m in "abc"] == [0.03, 0.06, 0.5]


def test_normal_pvalue_and_ids(spark):
    import uuid

    r = spark.range(1).select(fn.normal_pvalue(F.lit(1.96)).alias("p"), fn.finding_id(F.lit("EG-001"), F.lit("e"), F.lit("w")).alias("u"), fn.pseudonym(F.lit("alice"), "unit-salt").alias("h"), fn.hmac_sha256(F.lit("data"), "key").alias("s"), fn.strip_formula(F.lit("=CMD|calc")).alias("c")).first()
    import hmac

    assert math.isclose(r.p, math.erfc(1.96 / math.sqrt(2))) and r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "EG-001|e|w|42"))
    assert r.h == hashlib.sha256(b"aliceunit-salt").hexdigest() and r.s == hmac.new(b"key", b"data", "sha256").hexdigest() and r.c == "CMD|calc"


@pytest.mark.parametrize("n,want", [(49, 0), (50, 1), (150, 3)])
def test_bursts(spark, n, want):
    rows = [("e", "a", "BENIGN", f"c{i:03d}", T0 + timedelta(seconds=i * 20 / n)) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, analyst_id string, disposition_code string, case_id string, close_ts timestamp")
    assert temporal.bursts(df).count() == want


def test_duplicate_depth_survives_cycles(spark):
    rows = [("e", "1", None), ("e", "2", "1"), ("e", "3", "2"), ("f", "a", "b"), ("f", "b", "a"), ("g", "x", "x")]
    got = dict(map(tuple, workflow.duplicate_depth(spark.createDataFrame(rows, "entity_id string, case_id string, is_duplicate_of string")).collect()))
    assert got["e"] == 3 and got["f"] >= 2 and "g" not in got


def test_note_similarity_equals_pairs(spark):
    notes = ["the host was checked and closed", "the host was checked and closed", "a different text altogether", "", None]
    df = spark.createDataFrame([("e", n) for n in notes] + [("one", "alone")], "entity_id string, notes string")
    got = {r.entity_id: r.similarity for r in text.note_similarity(df, ["entity_id"]).collect()}
    import re

    docs = [n if (n or "").strip() else text.BLANK for n in notes]

    def vectors(grams):
        bags = [grams(d.lower()) for d in docs]
        out = []
        for b in bags:
            v = {g: (1 + math.log(b.count(g))) * (math.log((1 + len(docs)) / (1 + sum(g in x for x in bags))) + 1) for g in set(b)}
            norm = math.sqrt(sum(x * x for x in v.values()))
            out.append({g: x / norm for g, x in v.items()})
        return out

    def words(d):
        w = re.findall(r"\w\w+", d)
        return w + [" ".join(p) for p in zip(w, w[1:], strict=False)]

    sims = []
    for vs in (vectors(words), vectors(lambda d: [d[i : i + k] for k in (2, 3) for i in range(len(d) - k + 1)])):
        sims.append(sum(sum(a.get(g, 0) * x for g, x in b.items()) for i, a in enumerate(vs) for j, b in enumerate(vs) if i != j) / (len(vs) * (len(vs) - 1)))
    assert math.isclose(got["e"], sum(sims) / 2, rel_tol=1e-9) and got["one"] == 0


def test_note_similarity_over_many_blocks(spark, monkeypatch):
    """Blocks of a few notes, groups with nulls among their keys, and blank notes of any white space, against one block a group; no stored row outgrows its note."""
    words = "the host was checked and closed as expected after a scan of mail".split()
    notes = [" ".join(words[(i * k) % len(words)] for k in range(1, 3 + i % 9)) for i in range(300)] + ["", " \t\n", "a", None] * 5
    df = spark.createDataFrame([(("x", None, "y")[i % 3], (None, "p")[i % 2], n) for i, n in enumerate(notes)], "entity_id string, analyst_id string, notes string").coalesce(1)
    whole = {(r.entity_id, r.analyst_id): (r.n_notes, r.similarity) for r in text.note_similarity(df, ["entity_id", "analyst_id"]).collect()}
    stored = []
    monkeypatch.setattr(text, "written", lambda d, name, w=text.written: stored.append(w(d, name)) or stored[-1])
    monkeypatch.setattr(text, "BLOCK_CHARS", 200)
    monkeypatch.setattr(text, "GROUPS_AT_ONCE", 4)
    cut = {(r.entity_id, r.analyst_id): (r.n_notes, r.similarity) for r in text.note_similarity(df, ["entity_id", "analyst_id"]).collect()}
    assert len(whole) == 6 and cut.keys() == whole.keys() and all(cut[k][0] == n and math.isclose(cut[k][1], s, rel_tol=1e-9) for k, (n, s) in whole.items())
    assert stored[0].select("block").distinct().count() > 30 and stored[0].count() == len(notes)
    assert stored[0].agg(F.max(F.length("note"))).first()[0] < 100


def test_note_similarity_over_many_parts(spark, monkeypatch):
    """Grams dealt to many parts, against one part a group; a block's grams of a part are one row, not a row each."""
    words = "the host was checked and closed as expected after a scan of mail".split()
    notes = [" ".join(words[(i * k) % len(words)] for k in range(1, 3 + i % 9)) + f" {i}" for i in range(300)] + ["a", None]
    df = spark.createDataFrame([("xy"[i % 2], n) for i, n in enumerate(notes)], "entity_id string, notes string").repartition(3)
    whole = {r.entity_id: r.similarity for r in text.note_similarity(df, ["entity_id"]).collect()}
    stored = {}
    monkeypatch.setattr(text, "written", lambda d, name, w=text.written: stored.setdefault(name, w(d, name)))
    monkeypatch.setattr(text, "BLOCK_CHARS", 400)
    monkeypatch.setattr(text, "PART_CHARS", 500)
    cut = {r.entity_id: r.similarity for r in text.note_similarity(df, ["entity_id"]).collect()}
    assert len(whole) == 2 and all(math.isclose(cut[k], s, rel_tol=1e-9) for k, s in whole.items())
    assert stored["note-groups"].agg(F.min("parts")).first()[0] >= 8
    rows = stored["note-counts"].groupBy("block", "part").count()
    assert rows.count() == stored["note-counts"].count() and rows.select("part").distinct().count() >= 8


def test_text_summary_leaves_no_tables_of_notes(spark, monkeypatch):
    """what the comparisons wrote on the way is gone, but for their results, and the setting that they changed is back."""
    from pathlib import Path

    from socspan.functions import tables

    notes = [("xy"[i % 2], f"p{i % 3}", f"checked the host {i % 7} and closed it as expected {i}") for i in range(60)]
    df = spark.createDataFrame(notes, "entity_id string, analyst_id string, notes string")
    named = []
    monkeypatch.setattr(tables, "shared_dir", lambda s, name, f=tables.shared_dir: named.append((name, f(s, name))) or named[-1][1])
    assert text.text_summary(df).count() == 2
    assert len(named) > 10 and sorted(n for n, path in named if Path(path.removeprefix("file://")).exists()) == ["copy-paste", "note-similarity", "note-similarity"]
    assert spark.conf.get(tables._CLEAN) == "false"


def test_copy_paste_and_richness(spark):
    rows = [("e", "one two three four five six seven eight nine ten eleven twelve"), ("e", "one two three four five six seven eight nine ten eleven twelve"), ("e", "x"), ("e", None)]
    df = spark.createDataFrame(rows, "entity_id string, notes string")
    assert math.isclose(text.copy_paste(df, ["entity_id"]).first().copy_paste_ratio, 1 / 6)
    assert math.isclose(df.filter("notes = 'x'").select(text.richness().alias("r")).first().r, 0.5 + 0.5 / 50)
    assert [r[0] for r in spark.createDataFrame([("N/A",), ("done.",), ("see above",), ("real words",), ("",)], "notes string").select(text.is_placeholder()).collect()] == [True, True, True, False, True]


def test_copy_paste_equals_all_pairs(spark, monkeypatch):
    """Copies, near copies and a phrase that all notes share, in groups with nulls among their keys, against all pairs; a shingle is stored as a number, and only the filter's are exchanged."""
    import re

    notes = []
    for i in range(40):
        w = [f"w{i // 4}x{j}" for j in range(30 + i // 4)] + "closed as expected after a scan".split()
        w[i % 4 : i % 4 + (i % 4 > 1)] = [f"y{i}"] * (i % 4 > 1)
        notes.append(" ".join(w).upper() if i % 2 else ", ".join(w))
    notes += ["", None, "one", "one two", "One  Two"] * 3
    rows = [((None, "p")[k], n) for n in notes for k in range(2)]
    stored = {}
    monkeypatch.setattr(text, "FAMILY_BLOCK", 2)
    monkeypatch.setattr(text, "written", lambda d, name, w=text.written: stored.setdefault(name, w(d, name)))
    got = {r.lang: r.copy_paste_ratio for r in text.copy_paste(spark.createDataFrame(rows, "lang string, notes string").repartition(5), ["lang"]).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := re.findall("[a-z0-9]+", (n or "").lower())) else set() for n in notes]
    hits = sum(len(a & b) >= 0.9 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert hits > 20 and all(math.isclose(got[k], hits / (len(notes) * (len(notes) - 1) / 2)) for k in (None, "p"))
    assert dict(stored["note-sets"].dtypes)["s"] == "array<bigint>"
    assert stored["note-shingles"].count() < 0.2 * stored["note-sets"].agg(F.sum("k")).first()[0]


def results(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, signal_id string, value double, threshold double, is_flagged boolean, score double, severity string, confidence string, insufficient_data boolean, high_band boolean, sample_size long, finding_id string")


def flag(sig, on=True, severity="HIGH", score=1.0, band=False):
    return ("e", sig, 1.0, 1.0, on, score, severity, "MEDIUM", False, band, 9, f"id-{sig}")


def test_composites(spark):
    got = values(signals.composites(results(spark, [flag("EG-003"), flag("NS-005", severity="MEDIUM"), flag("NS-006", False), flag("EG-013", severity="MEDIUM"), flag("NS-001", band=True), flag("NS-010", band=True), flag("EG-007", False)])), "signal_id")
    assert got["COMP-001"].is_flagged and got["COMP-001"].severity == "MEDIUM"  # one of four members is silent: a step lower
    assert got["COMP-002"].is_flagged and got["COMP-002"].severity == "HIGH"
    assert not got["COMP-003"].is_flagged and got["COMP-003"].severity == "LOW"


def test_domain_scores_and_bands(spark):
    r = results(spark, [flag("EG-001", score=0.8, severity="CRITICAL"), flag("EG-008", score=0.6, severity="CRITICAL"), flag("NS-003", score=0.5, severity="CRITICAL")])
    got = values(scoring.domain_scores(r), "domain")
    assert math.isclose(got["operational_discipline"].domain_score, 80 * (1 - math.exp(-1.6))) and math.isclose(got["peer_divergence"].domain_score, 50 * (1 - math.exp(-0.8)))
    assert len(got) == 7 and got["governance"].domain_score == 0
    assert [x[0] for x in spark.createDataFrame([(s,) for s in (24.9, 25.0, 50.0, 75.0)], "s double").select(scoring.band(F.col("s"))).collect()] == ["LOW", "MODERATE", "ELEVATED", "HIGH"]


def test_queue_weights(spark):
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    runs = spark.createDataFrame([("r1", 1, "a"), ("r2", 2, "a")], "run_id string, seq int, entity_id string")
    assert {r.entity_id: r.novelty for r in scoring.novelty(e, runs).collect()} == {"a": 0.4, "b": 1.0}
    seen = spark.createDataFrame([("a", T0)], "entity_id string, ts timestamp")
    assert {r.entity_id: r.coverage_gap for r in scoring.coverage_gap(e, seen, "2024-01-05 00:00:00").collect()} == {"a": 1.0, "b": 1.25}
    hist = spark.createDataFrame([("a", i, s) for i, s in enumerate((60.0, 40.0, 20.0))] + [("b", 0, 1.0)], "entity_id string, seq int, score double")
    assert {r.entity_id: r.direction for r in scoring.trends(hist).collect()} == {"a": "IMPROVING", "b": "INSUFFICIENT_HISTORY"}


def test_calibration(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.8, 0)], "score double, label int")
    out = scoring.calibrate(rows, scoring.train_calibrator(rows)).collect()
    assert [(r.calibrated_score, r.calibrated) for r in out] == [(20.0, False), (80.0, False)]
    many = spark.createDataFrame([(i / 100, int(i > 50)) for i in range(100)], "score double, label int")
    got = {r.score: r.calibrated_score for r in scoring.calibrate(many, scoring.train_calibrator(many)).collect()}
    assert got[0.1] == 0 and got[0.9] == 100


def test_ledger(spark):
    ev = spark.createDataFrame([("r", i, "t", "X", f'{{"entity_id":"{i}"}}') for i in range(5)], "run_id string, seq int, ts string, event_type string, payload_json string")
    chain = audit.build_chain(ev).cache()
    prev = "0" * 64
    hashes = []
    for r in sorted(chain.collect(), key=lambda r: r.seq):
        assert r.prev_hash == prev
        prev = hashlib.sha256(f"{prev}||{r.payload_json}||{r.seq}||t||r||X".encode()).hexdigest()
        hashes.append(prev)
        assert r.entry_hash == prev
    assert audit.verify_chain(chain).first().ok
    assert audit.verify_chain(chain.withColumn("payload_json", F.when(F.col("seq") == 1, "x").otherwise(F.col("payload_json")))).first().first_broken_seq == 1
    assert audit.verify_chain(chain.filter("seq <> 2")).first().first_broken_seq == 3
    level = [bytes.fromhex(h) for h in hashes]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + (level[i + 1] if i + 1 < len(level) else level[i])).digest() for i in range(0, len(level), 2)]
    assert audit.merkle_roots(chain).first().merkle_root == level[0].hex()


def test_ingest(spark):
    raw = spark.createDataFrame([("e", "=a1", "h1", "P1 ", "2024-01-02T03:04:05+0530", "closed"), ("e", "a2", "h2", "odd", "02/01/2024 03:04", None)], "entity_id string, `Alert ID` string, `host-id` string, Severity string, created_at string, state string")
    a, b = sorted(submission.map_table(raw, "alerts", "2024-02-01 00:00:00", zone="Asia/Kolkata").collect(), key=lambda r: r.alert_id)
    assert (a.alert_id, a.severity_norm, a.status, a.detected_ts, a.detected_ts_orig_offset) == ("a1", "CRITICAL", "CLOSED", datetime(2024, 1, 1, 21, 34, 5), "+0530")
    assert (b.severity_norm, b.status, b.detected_ts) == ("UNKNOWN", "OPEN", datetime(2024, 1, 1, 21, 34))
    rows = spark.createDataFrame([("e", "1", T0, T0, "HIGH"), ("e", "2", T0, T0 - timedelta(hours=1), "HIGH"), ("e", "3", T0 + timedelta(days=99), T0, "HIGH"), ("e", None, T0, T0, "HIGH"), ("e", "5", T0, T0, "BANANA"), ("e", "6", None, None, None)], "entity_id string, alert_id string, detected_ts timestamp, ack_ts timestamp, severity_norm string")
    got = ingest.check(rows, "2024-02-01 00:00:00", ["alert_id"], {"severity_norm": ["HIGH"]}).cache()
    assert {r.alert_id: r.reason for r in got.collect()} == {"1": None, "2": "NON_MONOTONIC", "3": "FUTURE_TIMESTAMP", None: "REQUIRED_MISSING", "5": "ENUM_INVALID", "6": None}
    q = ingest.quarantine(got, "run-1")
    assert q.count() == 4 and ingest.append_new(ingest.quarantine(got, "run-2"), q).count() == 0
    card = ingest.scorecard(got).first()
    assert (card.total_rows, card.valid_rows, card.reasons["ENUM_INVALID"]) == (6, 2, 1)


def test_files(spark, tmp_path):
    for e in ("a", "b"):
        (tmp_path / e).mkdir()
        (tmp_path / e / "alerts.csv").write_text("id,severity\n007,HIGH\n")
        (tmp_path / e / "cases.json").write_text('{"records": [{"case_id": 1}, {"case_id": 2}]}')
        (tmp_path / e / "assets.jsonl").write_text('{"asset_id": 1}\n\n{"asset_id": 2}\n')
    assert sorted((r.entity_id, r.id) for r in ingest.read_submissions(spark, str(tmp_path), "alerts", "csv").collect()) == [("a", "007"), ("b", "007")]
    assert ingest.read_submissions(spark, str(tmp_path), "cases", "json").count() == 4
    assert ingest.read_submissions(spark, str(tmp_path), "assets", "jsonl").count() == 4
    df = spark.createDataFrame([("a", 1), ("b", 2)], "entity_id string, x int")
    sinks.write_canonical(df, f"{tmp_path}/out")
    sinks.write_canonical(spark.createDataFrame([("a", 5)], "entity_id string, x int"), f"{tmp_path}/out")
    assert {(r.entity_id, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 5), ("b", 2)}


def test_submission(spark, tmp_path):
    raw = {
        "alerts": spark.createDataFrame([("e", "a1", " ", "P1", "2024-01-02 03:04:05"), ("e", "", "h", None, "no time"), ("f", "a1", None, "P2", None)], "entity_id string, id string, hostname string, priority string, timestamp string"),
        "escalations": spark.createDataFrame([("e", "x", "c", " t 1 ", "extra")], "entity_id string, id string, incident_id string, source_tier string, other string"),
    }
    s = submission.materialize(raw, "r", "2024-02-01 00:00:00", {"escalations": {"escalation_id": submission.Field("id"), "case_id": submission.Field("incident_id", hashed=True), "from_tier": submission.Field("source_tier")}}, salt="s")
    counts = {(r.entity_id, r.record_type): (r.total_rows, r.valid_rows) for r in s.report.collect()}
    assert counts == {("e", "alerts"): (2, 1), ("f", "alerts"): (1, 0), ("e", "cases"): (2, 1), ("f", "cases"): (1, 0), ("e", "assets"): (2, 2), ("e", "telemetry"): (2, 2), ("e", "escalations"): (1, 0)}
    a = s.tables["alerts"].first()
    assert (a.alert_id, a.asset_id, a.severity_norm, a.status, a.category) == ("a1", "AST-e-01", "CRITICAL", "OPEN", "SECURITY") and a.title.startswith("Alert ") and len(a.record_hash) == 64
    assert {(r.record_type, r.entity_id, r.reason_code) for r in s.rejected.collect()} == {("alerts", "e", "REQUIRED_MISSING"), ("alerts", "f", "REQUIRED_MISSING"), ("cases", "e", "REQUIRED_MISSING"), ("cases", "f", "REQUIRED_MISSING"), ("escalations", "e", "ENUM_INVALID")}
    submission.write_submission(s, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/assets").count() == 2 and spark.read.json(f"{tmp_path}/out/ingest_report").count() == 7
    none = submission.materialize({t: df.limit(0) for t, df in raw.items()}, "r", "2024-02-01 00:00:00")
    assert none.report.count() == 0 and none.rejected.count() == 0
    with pytest.raises(ValueError):
        submission.materialize({}, "r", "2024-02-01 00:00:00")
    hundred = spark.range(300).select(F.lit("e").alias("entity_id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert sorted(r.i for r in submission.numbered(hundred, "h").collect()) == list(range(300))


def test_quarantine_keeps_copies(spark):
    long = "x" * 600
    rows = spark.createDataFrame([("e", long + "1", "R"), ("e", long + "2", "R"), ("e", long + "2", "R"), ("e", None, "R"), ("e", "fine", None)], "entity_id string, v string, reason string")
    q = ingest.quarantine(rows, "run")
    assert sorted(r.copies for r in q.collect()) == [1, 1, 2] and q.select("_fingerprint").distinct().count() == 3


def test_readers(spark, tmp_path):
    labels = spark.createDataFrame([("e", "EG-001", "", 1, None, "why"), ("f", "EG-002", "MEDIUM", 0, 0.5, "")], "entity_id string, signal_id string, severity string, expected_flag int, confidence double, rationale string")
    assert sorted((r.entity_id, r.severity, r.confidence, r.note) for r in records.expert_labels(labels).collect()) == [("e", "HIGH", 0.0, "why"), ("f", "MEDIUM", 0.5, None)]
    other = spark.createDataFrame([("e", "S1", "n")], "entity_id string, issue_type string, note string")
    assert records.expert_labels(other).first() == ("e", "S1", "LOW", "synthetic", 1.0, "n")
    assert records.training_labels(other) is None and records.training_labels(labels.limit(0)) is None and records.training_labels(labels).count() == 2
    for read in (records.ledger, records.adjudications):
        assert read(spark, f"{tmp_path}/none").count() == 0
    runs, last = records.review_runs(spark, f"{tmp_path}/none.json")
    assert runs.count() == 0 and last.count() == 0
    (tmp_path / "h.json").write_text('{"runs": [{"run_id": "r0", "queue": [{"entity_id": "e", "signal_id": "s"}]},\n {"run_id": "r1", "queue": []}], "last_reviewed": {"e": "2024-01-01T00:00:00"}}')
    runs, last = records.review_runs(spark, f"{tmp_path}/h.json")
    assert [tuple(r) for r in runs.collect()] == [("r0", 0, "e", "s")] and [tuple(r) for r in last.collect()] == [("e", datetime(2024, 1, 1))]
    (tmp_path / "l.jsonl").write_text('{"run_id": "r", "seq": 1}\n\n{"run_id": "r", "seq": 2}\n')
    assert records.ledger(spark, f"{tmp_path}/l.jsonl").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"run_id": "r", "seq": 1}\n{oops\n')
    with pytest.raises(Exception):
        records.ledger(spark, f"{tmp_path}/bad.jsonl").collect()
    (tmp_path / "v.jsonl").write_text('{"disagreement_id": "d", "verdict": "agree"}\n')
    assert records.adjudications(spark, f"{tmp_path}/v.jsonl").first().verdict == "agree"
    (tmp_path / "a.csv").write_bytes(b"x")
    assert submission.file_hashes(spark, f"{tmp_path}/a.csv").first().source_file_hash == hashlib.sha256(b"x").hexdigest()


def test_oracles_are_sql():
    import __spark_entry__ as entry

    assert all(isinstance(v, str) and "select" in v for v in entry.oracle_sql().values()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_validation(spark):
    labels = spark.createDataFrame([("e", "EG-001", "S1", "HIGH", ""), ("e", "NS-001", None, "LOW", "planted"), ("f", "EG-001", "S1", "LOW", "not planted")], "entity_id string, signal_id string, scenario_id string, severity string, note string")
    found = spark.createDataFrame([("e", "EG-001", "HIGH", 1.0), ("f", "EG-001", "HIGH", 0.5)], "entity_id string, signal_id string, severity string, score double")
    r = validation.compare(found, labels).first()
    assert (r.cells, r.hits, r.misses, r.false_alarms) == (3, 1, 1, 1)
    assert {x.scenario_id: x.recall for x in validation.by_scenario(labels, found).collect()} == {"S1": 1.0, "SX": 0.0}
    same = spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")
    k = validation.agreement(same).first()
    assert k.kappa == 1.0 and k.alpha == 1.0


def test_guard_and_coverage(spark):
    t = spark.createDataFrame([(1, "mail a@b.cd"), (2, "you must go"), (3, "x" * 5000), (4, "fine"), (5, None)], "id int, text string")
    assert {r.id: r.failed for r in evidence.guard(t, "id").collect()} == {1: "personal data", 2: "prescriptive", 3: "too long", 4: None, 5: None}
    assets = spark.createDataFrame([("e", "1", "high", "production", "linux", True), ("e", "2", "odd", "x", "y", False)], "entity_id string, asset_id string, criticality string, environment string, os_family string, internet_facing boolean")
    tele = spark.createDataFrame([("e", "1", "edr")], "entity_id string, asset_id string, source string")
    space = coverage.negative_space(assets, tele)
    assert space.filter("gap_flag").count() == 4 and space.count() == 5


def test_find_finding(spark):
    r = spark.createDataFrame([("f1", "e"), ("f2", "e")], "finding_id string, entity_id string")
    assert evidence.find_finding(r, "f2").count() == 1
    with pytest.raises(KeyError):
        evidence.find_finding(r, "f3")


def test_signal_invariants(spark):
    from socspan.plans.views import canonical

    t = canonical(spark, "/root/testdata/sf0.001")
    rules = [s for s in signals.SIGNALS if s.id != "EG-010"]
    r = signals.evaluate(signals.metrics(t, only=signals.needed(rules)), signals=rules).collect()
    assert len(r) == 25 * len(rules)
    for x in r:
        assert 0 <= x.score <= 1 and not math.isnan(x.value)
        assert not (x.insufficient_data and (x.is_flagged or x.value))


def test_topics_read_the_notes_a_few_times_whatever_the_iterations(spark):
    from socspan.operators import text

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    notes = spark.createDataFrame([(i, f"word{i % 3} other{i % 5} same") for i in range(40)], "id long, notes string").mapInPandas(count, "id long, notes string")
    assert sorted(r.id for r in text.topics(notes, "id", k=2, iterations=6).collect()) == list(range(40))
    assert seen.value <= 3 * 40


def test_all_signals_come_from_one_wide_row(spark):
    from socspan.plans import signal_queries

    files = signal_queries.QUERIES["sig_all"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/signal-inputs" in f for f in files)
