"""SQLite files as a data source: ranges, differing columns, tables without rowid, and a submission from them."""

import sqlite3

import pytest

from socspan.sources import sqlite, submission


def database(path, tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    c = sqlite3.connect(path)
    for name, (columns, rows, *more) in tables.items():
        c.execute(f'create table "{name}" ({columns}) {"".join(more)}')
        if rows:
            c.executemany(f'insert into "{name}" values ({",".join("?" * len(rows[0]))})', rows)
    c.commit()
    c.close()


def test_tables_of_many_files(spark, tmp_path):
    database(tmp_path / "e1" / "x.sqlite", {"Alerts": ("id integer, title text, severity", [(i, f"t{i}", None if i % 7 else "high") for i in range(1000)]), "cases": ("case_id text primary key, status", [("c1", "Open")], "without rowid"), "other": ("a", [(1,)])})
    database(tmp_path / "e2" / "x.sqlite", {"alerts": ("id text, \"odd \"\"name\" real, Severity text, entity_id text", [("007", 1.5, "é", "not this")]), "telemetry": ("source text", [])})
    got = sqlite.read_databases(spark, f"{tmp_path}/*/x.sqlite", rows=100)
    assert list(got) == ["alerts", "cases", "telemetry"]
    alerts = got["alerts"]
    assert alerts.columns == ["id", "title", "severity", 'odd "name', "entity_id"] and alerts.rdd.getNumPartitions() == 11
    rows = alerts.collect()
    assert len(rows) == 1001 and sorted(int(r.id) for r in rows if r.entity_id == "e1") == list(range(1000))
    assert [tuple(r) for r in rows if r.entity_id == "e2"] == [("007", None, "é", "1.5", "e2")]
    assert sum(r.severity == "high" for r in rows) == 143 and all(r.title == f"t{r.id}" for r in rows if r.entity_id == "e1")
    assert [tuple(r) for r in got["cases"].collect()] == [("c1", "Open", "e1")] and got["telemetry"].count() == 0


def test_gaps_in_row_numbers_and_empty_files(spark, tmp_path):
    database(tmp_path / "e" / "x.db", {"assets": ("asset_id integer primary key", [(i,) for i in (-5, 1, 2, 700, 10**6)])})
    got = sqlite.read_databases(spark, f"{tmp_path}/*/x.db", rows=400_000)["assets"]
    assert sorted(int(r.asset_id) for r in got.collect()) == [-5, 1, 2, 700, 10**6]
    database(tmp_path / "f" / "x.db", {"other": ("a", [(1,)])})
    with pytest.raises(ValueError, match="f/x.db"):
        sqlite.read_databases(spark, f"{tmp_path}/*/x.db")


def test_a_submission_from_databases(spark, tmp_path):
    database(tmp_path / "e1" / "s.sqlite", {"alerts": ("id text, host_id text, title text, severity text, created_at text", [(f"a{i}", "h1", "t", "P1", "2024-01-02T03:04:05.5Z") for i in range(5)])})
    s = submission.materialize(sqlite.read_databases(spark, f"{tmp_path}/*/s.sqlite"), "run", "2024-02-01 00:00:00")
    rows = s.tables["alerts"].collect()
    assert len(rows) == 5 and {(r.entity_id, r.severity_norm, str(r.detected_ts)) for r in rows} == {("e1", "CRITICAL", "2024-01-02 03:04:05.500000")}
    assert s.tables["cases"].count() == 5
