"""SQLite stores as a source: types, ranges, conditions in SQLite's own statement, and the store's typed tables."""

import json
import os
import sqlite3
from contextlib import closing
from datetime import datetime

import pytest

from lectern.sources import sqlite_store

ITEM = """CREATE TABLE item (run_id TEXT NOT NULL, configuration_id TEXT NOT NULL, topic_key TEXT NOT NULL, item_index INTEGER NOT NULL,
 state TEXT NOT NULL, generation_attempts INTEGER NOT NULL DEFAULT 0, filter_attempts INTEGER NOT NULL DEFAULT 0, item_json TEXT, decision_json TEXT,
 calls_json TEXT, failure TEXT, updated_at TEXT NOT NULL, difficulty INTEGER NOT NULL DEFAULT 50, PRIMARY KEY (run_id, configuration_id, topic_key, item_index))"""


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "runs.db")
    with closing(sqlite3.connect(path)) as c:
        c.execute(ITEM)
        c.execute("CREATE INDEX item_by_state ON item (run_id, state)")
        c.execute("CREATE TABLE verdict (item_rowid INTEGER NOT NULL, judge_model TEXT, scope TEXT, accepted INTEGER, decision_json TEXT, created_at TEXT, PRIMARY KEY (item_rowid, judge_model, scope))")
        body = {"type": "single-choice", "title": "T", "questionText": "Why?", "options": [{"text": "a", "correct": True, "hint": None, "explanation": "e"}]}
        decision = {"accepted": True, "aggregateScore": 0.9, "meanSeverity": 0.1, "modeVerdicts": {"OFF_TOPIC": {"severity": 0.1, "triggered": False, "justification": "j"}}, "filterModel": "m"}
        calls = [{"requestId": "r", "stage": "generation", "promptTokens": 7, "wallClockMs": 12, "outcome": "success"}]
        for i in range(500):
            if i % 7:  # gaps between row ids
                row = (i, f"run-{i % 2}", "c", "t", i, "FILTERED" if i % 3 else "PENDING", 1, 1, json.dumps(body) if i % 3 else None, json.dumps(decision), json.dumps(calls), None, "2025-03-04T05:06:07.123456Z")
                c.execute("INSERT INTO item (rowid, run_id, configuration_id, topic_key, item_index, state, generation_attempts, filter_attempts, item_json, decision_json, calls_json, failure, updated_at) VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?)", row)
        c.execute("INSERT INTO verdict VALUES (5, 'j', 'GENERAL', 1, ?, '2025-03-04T05:06:07Z')", (json.dumps(decision),))
        c.execute("CREATE TABLE odd (a INTEGER, b REAL, c BLOB, d TEXT)")
        c.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", [(1, 2, b"x", "y"), (None, 2.5, None, "")])
        c.execute("CREATE TABLE wrong (a INTEGER)")
        c.execute("INSERT INTO wrong VALUES ('text')")
        c.execute("CREATE TABLE none (a INTEGER)")
        c.commit()
    return path


def test_scan_equals_the_table(spark, store):
    with closing(sqlite3.connect(store)) as c:
        rows = c.execute("SELECT rowid, topic_key, item_index, state, failure FROM item ORDER BY rowid").fetchall()
    found = sqlite_store.scan(spark, store, "item", ["rowid", "topic_key", "item_index", "state", "failure"], rows=60)
    assert found.rdd.getNumPartitions() == 8 and sorted(map(tuple, found.collect())) == rows
    assert sqlite_store.scan(spark, f"file://{store}", "odd").collect() == [(1, 1, 2.0, b"x", "y"), (2, None, 2.5, None, "")]
    assert sqlite_store.scan(spark, store, "none").count() == 0
    for args, why in ((("wrong",), "which is no bigint"), (("missing",), "no table"), (("item", ["nope"]), "no column")):
        with pytest.raises(Exception, match=why):
            sqlite_store.scan(spark, store, *args).collect()


def test_conditions_are_part_of_the_statement(spark, store):
    where = [["run_id", "=", "run-1"], ["state", "IN", ["PENDING", "FILTERING"]], ["failure", "IS NULL"]]
    sql, values = sqlite_store.statement("item", ["item_index"], where, 10, 90)
    assert values == ["run-1", "PENDING", "FILTERING", 10, 90]
    with closing(sqlite_store.connect(store)) as c:
        told = []
        c.set_trace_callback(told.append)
        rows = c.execute(sql, values).fetchall()
        assert "\"run_id\" = 'run-1'" in told[0] and "rowid BETWEEN 10 AND 90" in told[0]
        plan = " ".join(r[3] for r in c.execute("EXPLAIN QUERY PLAN " + sql, values))
        assert "SEARCH item USING INDEX item_by_state" in plan
        with pytest.raises(sqlite3.OperationalError):
            c.execute("DELETE FROM item")
    expected = [i for i in range(500) if i % 7 and i % 2 == 1 and i % 3 == 0]
    assert [r[0] for r in rows] == [i for i in expected if 10 <= i <= 90]
    found = sqlite_store.scan(spark, store, "item", ["item_index"], where, rows=100)
    assert sorted(r.item_index for r in found.collect()) == expected
    with pytest.raises(Exception, match="is none of"):
        sqlite_store.scan(spark, store, "item", where=[["state", "= '' OR 1 =", 1]]).collect()


def test_typed_tables_of_a_store(spark, store):
    item = sqlite_store.read_table(spark, store, "item", [["item_index", "=", 5]]).first()
    assert (item.item_id, item.run_id, item.item_index, item.updated_at) == (5, "run-1", 5, datetime(2025, 3, 4, 5, 6, 7, 123456))
    assert item["item"].question_text == "Why?" and item["item"].options[0].correct and item.provenance is None and item.course_key is None
    assert item.decision.mode_verdicts["OFF_TOPIC"].severity == 0.1 and item.decision.aggregate_score == 0.9 and item.calls[0].prompt_tokens == 7
    verdict = sqlite_store.read_table(spark, store, "verdict").first()
    assert (verdict.item_id, verdict.judge_model, verdict.accepted, verdict.decision.filter_model) == (5, "j", True, "m")


def test_stores_in_a_folder_and_in_use(spark, store, tmp_path):
    with closing(sqlite3.connect(store)) as c:
        c.execute("PRAGMA journal_mode=WAL")
        c.execute("UPDATE odd SET d = 'new' WHERE a IS NULL")
        c.commit()
        os.makedirs(tmp_path / "x")
        sqlite_store.snapshot(store, str(tmp_path / "x" / "one.db"))
        sqlite_store.snapshot(store, str(tmp_path / "two.db"))
        c.execute("PRAGMA journal_mode=DELETE")
    assert sorted(r.d for r in sqlite_store.scan(spark, str(tmp_path), "odd").collect()) == ["new", "new", "y", "y"]
