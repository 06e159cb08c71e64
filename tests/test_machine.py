"""The live state machine against a plain loop over the same events, over restarts, and what it keeps."""

import collections
import random
from datetime import datetime, timedelta

import pytest

from lectern.streaming import machine

START = datetime(2025, 1, 1)
RULES = machine.Rules(attempts=3, stale_ms=600_000)
TRANSIENT = ("TIMEOUT", "TRANSPORT", "RATE_LIMIT")


def loop(events, rules=RULES, end=None):
    """Final state, attempts and failure of every item, None for an item that was never there."""
    items, open_claims = {}, {}

    def back(key):
        s, g, f, why = items[key]
        items[key] = ("PENDING" if s == "GENERATING" else "GENERATED", g, f, why)
        del open_claims[key]

    for run, item, _, at, kind, failure in sorted(events, key=lambda e: (e[3], e[2])):
        key = (run, item)
        if key in open_claims and (at - open_claims[key]).total_seconds() * 1000 >= rules.stale_ms:
            back(key)
        s, g, f, why = items.get(key, (None, 0, 0, None))
        closed = s is None or s == "FILTERED" or (s.startswith("FAILED") and why not in TRANSIENT)
        if closed:
            if kind == "ENQUEUE":
                items[key] = ("PENDING", 0, 0, None)
        elif kind == "CLAIM" and s in ("PENDING", "GENERATED"):
            items[key] = ({"PENDING": "GENERATING", "GENERATED": "FILTERING"}[s], g, f, why)
            open_claims[key] = at
        elif kind == "RELEASE" and s in ("GENERATING", "FILTERING"):
            back(key)
        elif kind in ("SUCCESS", "FAILURE") and s in ("GENERATING", "FILTERING"):
            first = s == "GENERATING"
            g, f = g + first, f + (not first)
            again = (g if first else f) < rules.attempts and failure not in rules.permanent
            if kind == "SUCCESS":
                items[key] = ("GENERATED" if first else "FILTERED", g, f, None)
            elif again:
                items[key] = ("PENDING" if first else "GENERATED", g, f, failure)
            else:
                items[key] = ("FAILED_GENERATION" if first else "FAILED_FILTER", g, f, failure)
            del open_claims[key]
        elif kind == "REVIVE" and s.startswith("FAILED"):
            items[key] = ("PENDING", 0, f, None) if s == "FAILED_GENERATION" else ("GENERATED", g, 0, None)
    for key, at in list(open_claims.items()):
        if (end - at).total_seconds() * 1000 > rules.stale_ms:
            back(key)
    return items


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    kinds = ["ENQUEUE", "CLAIM", "CLAIM", "SUCCESS", "SUCCESS", "FAILURE", "REVIVE", "RELEASE"]
    out = []
    for seq in range(3000):
        at = START + timedelta(seconds=seq * 7 + rng.random())
        item = 0 if seq % 3 == 0 else rng.randrange(1, 60)  # a third of all events are of one item
        out.append((f"run-{item % 2}", item, seq, at, rng.choice(kinds), rng.choice(["TIMEOUT", "AUTH", "RATE_LIMIT", "VALIDATION_VIOLATION", None])))
    return out


def got(changes):
    return {(r.run_id, r.item_id): (r.state, r.generation_attempts, r.filter_attempts, r.failure) for r in machine.states(changes).collect()}


def test_stream_equals_a_loop_over_the_log(spark, events, tmp_path):
    df = spark.createDataFrame([*events, (None, 1, 1, START, "ENQUEUE", None), ("run-1", None, 1, START, "ENQUEUE", None), ("run-1", 1, 1, START, None, None)], machine.EVENT)
    changes = machine.replay(df, str(tmp_path), 3, RULES)
    expected = loop(events, end=max(e[3] for e in events))
    assert got(changes) == expected
    assert {r.cause for r in changes.select("cause").distinct().collect()} == {*machine.KINDS, "STALE"}
    # each change leaves the state that the one before led to
    lives = {}
    for r in sorted(changes.collect(), key=lambda r: (r.at, r.seq is not None, r.seq)):
        key = (r.run_id, r.item_id)
        if r.cause != "ENQUEUE":
            assert lives[key] == r.from_state
        lives[key] = r.state

    machine.count_states(spark, f"{tmp_path}/changes", f"{tmp_path}/cc", f"{tmp_path}/counts")
    counts = {(r.run_id, r.state): r.items for r in machine.latest_counts(spark, f"{tmp_path}/counts").collect()}
    whole = collections.Counter()
    for r in changes.collect():
        whole[r.run_id, r.state] += 1
        if r.from_state:
            whole[r.run_id, r.from_state] -= 1
    assert counts == {k: n for k, n in whole.items() if n}


def test_only_open_items_are_kept_and_stale_claims_go_back_by_themselves(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    log, checkpoint, out = (f"{tmp_path}/{x}" for x in ("log", "cp", "out"))

    def add(rows):
        spark.createDataFrame(rows, machine.EVENT).write.mode("append").parquet(log)
        return machine.advance(spark, log, checkpoint, out, RULES)[-1]["stateOperators"][0]["numRowsTotal"]

    done = ["ENQUEUE", "CLAIM", "SUCCESS", "CLAIM", "SUCCESS"]
    first = [("r", i, k, at(k), kind, None) for i in range(20) for k, kind in enumerate(done)]
    add([*first, ("r", 99, 7, at(1), "ENQUEUE", None), ("r", 99, 8, at(4), "CLAIM", None)])
    assert got(spark.read.parquet(out))["r", 99] == ("GENERATING", 0, 0, None)
    # no event of item 99 any more: time alone takes the claim back, and what is late doesn't count
    add([("r", 100, 9, at(60), "ENQUEUE", None), ("r", 99, 10, at(2), "SUCCESS", None)])
    now = got(spark.read.parquet(out))
    assert now["r", 99] == ("PENDING", 0, 0, None) and now["r", 5] == ("FILTERED", 1, 1, None)
    assert [r.at for r in spark.read.parquet(out).where("cause = 'STALE'").collect()] == [at(14)]
    # twenty finished items left nothing behind
    assert add([("r", 100, 11, at(61), "SUCCESS", None)]) <= 4
    before = spark.read.parquet(out).count()
    machine.advance(spark, log, checkpoint, out, RULES)  # nothing new: nothing happens
    assert spark.read.parquet(out).count() == before


def test_replay_of_no_events(spark, tmp_path):
    none = machine.replay(spark.createDataFrame([], machine.EVENT), str(tmp_path))
    assert machine.states(none).count() == 0
