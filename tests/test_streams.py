"""Streams with state: cuts into batches, restarts in mid-stream, batches that run twice."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.plans.streams import in_turns
from spanloom.streaming import chain
from spanloom.streaming.changelog import ChangeLog

T0 = datetime(2024, 5, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Lost(Exception):
    pass


def losing(fold, when):
    """``fold`` on a driver that is lost once in batch ``when``, after the work is done but before the stream has noted it."""
    lost = []

    def run(batch, batch_id):
        fold(batch, batch_id)
        if batch_id == when and not lost:
            lost.append(batch_id)
            raise Lost

    return run


def fed(spark, rows, schema, fold, path, when=1):
    """Feeds ``rows`` (…, turn) turn by turn; the driver is lost in one of them and the stream starts again."""
    turns = max(r[-1] for r in rows) + 1
    df = spark.createDataFrame(rows, schema + ", turn int")
    run = losing(fold, when)
    try:
        in_turns(spark, df, "turn", turns, run, path)
    except Exception as e:  # the stream passes the loss on
        assert "Lost" in str(e)
        from spanloom.streaming.live import drain_batches

        names = [f.name for f in df.schema.fields if f.name != "turn"]
        for k in range(when + 1, turns + 1):
            drain_batches(spark.readStream.schema(df.select(*names).schema).parquet(f"{path}/in"), path, run)
            if k < turns:
                df.where(F.col("turn") == k).select(*names).write.mode("append").parquet(f"{path}/in")


def test_change_log(spark, tmp_path):
    r = random.Random(2)
    log, state, states = ChangeLog(str(tmp_path / "log"), "k long, a string, n long", ["k"], every=3), {}, []
    for b in range(11):
        states.append(dict(state))
        changes = {k: (k, r.choice(["x", None]), b) for k in r.sample(range(8), r.randrange(4))}
        for _ in range(1 + b % 2):  # every second batch runs twice
            assert {x.k: tuple(x) for x in log.before(spark, b).collect()} == state
            log.write(spark.createDataFrame(list(changes.values()), "k long, a string, n long"), b)
        state |= changes
    assert {x.k: tuple(x) for x in log.state(spark).collect()} == state
    assert all({x.k: tuple(x) for x in log.before(spark, b).collect()} == states[b] for b in (1, 3, 4, 7, 10))


ASKED = "graph_id string, trace_id string, run_key string, agent_name string, started_at timestamp, target_name string"


@pytest.mark.parametrize("seed", [1, 2])
def test_deferred_delegations_do_not_depend_on_cuts(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, turns = [], 3
    for g in range(12):
        for k in range(r.randint(1, 6)):
            key = f"g{g}r{k}"
            rows.append((f"g{g}", f"t{r.randrange(2)}", key, r.choice("abc"), at(r.randrange(3)), None, r.randrange(turns)))
            if r.random() < 0.7:
                rows.append((f"g{g}", rows[-1][1], key, None, None, r.choice("abcd"), r.randrange(turns)))
    runs = [x for x in rows if x[5] is None]
    want, open_ = set(), set()
    for graph, trace, owner, _, _, target, _ in rows:
        if target:
            found = sorted((x[1] != trace, x[4], x[2]) for x in runs if x[0] == graph and x[3] == target and x[2] != owner)
            (want.add((graph, found[0][2], owner)) if found else open_.add((owner, target)))
    state = chain.DeferredDelegations(str(tmp_path))
    fed(spark, rows + rows[:7], ASKED, state.fold, str(tmp_path))
    assert {(x.graph_id, x.from_key, x.to_key) for x in state.edges(spark).collect()} == want
    # a request whose only answer would be its own run stays open too
    assert {tuple(x) for x in state.unresolved(spark).collect()} == open_


def test_generations(spark, tmp_path):
    run = lambda g, i, s, turn, closes=False: (g, i, at(s), closes, turn)
    rows = [run(1, 1, 0, 0), run(1, 2, 1, 0, True), run(1, 3, 9, 2), run(1, 1, 20, 2), run(1, 4, 30, 3),  # grows in two later turns; one row is a redelivery
            run(2, 1, 0, 0), run(2, 1, 5, 1), (2, None, None, True, 1), run(2, 1, 9, 2),  # never grows
            (3, None, None, True, 0), run(3, 1, 4, 2),  # complete without runs, then some come
            run(4, 1, 0, 0), run(4, 2, 0, 3)]  # never complete
    analysed = []
    state = chain.Generations(str(tmp_path), lambda told, runs, b: analysed.append((b, sorted((x.graph_id, x.generation) for x in told.collect()), runs.count())))
    fed(spark, rows, "graph_id long, run_id long, arrival_ts timestamp, closes boolean", state.fold, str(tmp_path), when=2)
    got = sorted((x.graph_id, x.generation, x.run_count, x.late_count, x.late_at) for x in state.announced.state(spark).collect())
    assert got == [(1, 1, 2, 0, None), (1, 2, 3, 1, at(9)), (1, 3, 4, 2, at(30)), (2, 1, 1, 0, None), (3, 1, 1, 1, at(4))]
    third = (2, [(1, 2), (3, 1)], 4)
    assert analysed == [(0, [(1, 1)], 2), (1, [(2, 1)], 1), third, third, (3, [(1, 3)], 4)]  # the batch that ran twice gave the same


def test_breakers_open_close_and_open_again(spark, tmp_path):
    row = lambda agent, i, status, s, turn: (agent, i, status, at(s), turn)
    rows = [row("a", i, "open", i, 0) for i in range(3)] + [row("b", i, "open", i, 0) for i in range(2)]
    rows += [row("a", 1, "resolved", 10, 1), row("b", 5, "open", 11, 1), row("b", 5, "superseded", 12, 1)]
    rows += [row("a", 1, "open", 20, 2), row("a", 1, "open", 21, 2)] + [row("a", 9, "open", 30, 3)]
    state = chain.Breakers(str(tmp_path))
    fed(spark, rows, "agent_name string, incident_id long, status string, at timestamp", state.fold, str(tmp_path))
    signals = sorted(((x.at, x.agent_name, x.from_state, x.to_state) for x in state.signals.changes(spark).collect()))
    assert signals == [(at(2), "a", "closed", "open"), (at(10), "a", "open", "closed"), (at(21), "a", "closed", "open")]
    got = {x.agent_name: (x.state, x.open_incidents, x.opened_at) for x in state.agents.state(spark).collect()}
    assert got == {"a": ("open", 4, at(21)), "b": ("closed", 2, None)}


def test_deliveries_are_counted_once(spark, tmp_path):
    rows = [(i, f"m{i}", 0) for i in range(4)] + [(10 + t, "tick", t) for t in range(1, 8)] + [(0, "again", 2)]
    seen = []

    def handle(due):
        seen.append(sorted((x.id, x.deliveries) for x in due.collect()))
        return due.where("id >= 10 or id = 1 or (id = 2 and deliveries = 5)")

    state = chain.Deliveries(str(tmp_path), handle)
    fed(spark, rows, "id long, payload string", state.fold, str(tmp_path), when=3)
    assert sorted(tuple(x) for x in state.dead_letters(spark).collect()) == [(0, 6, "m0"), (3, 6, "m3")]
    got = {x.id: (x.state, x.deliveries) for x in state.messages.state(spark).collect()}
    assert got[1] == ("done", 1) and got[2] == ("done", 5) and all(got[10 + t] == ("done", 1) for t in range(1, 8))
    assert seen[3] == seen[4] == [(0, 4), (2, 4), (3, 4), (13, 1)]  # the lost batch


def test_analysis(spark, tmp_path):
    # graph_id, run_id, root, ended, failed, score, arrival
    row = lambda g, i, root, ended, failed, score, s, turn: (g, i, root, ended, failed, score, at(s), turn)
    rows = [row(1, 1, True, True, False, 0.9, 0, 0), row(1, 2, False, False, True, 0.1, 1, 0),  # root ended: flagged twice over
            row(2, 1, True, False, False, 0.1, 0, 0), row(2, 2, False, True, False, 0.9, 5, 1),  # quiet in the third turn
            row(3, 1, True, False, True, None, 0, 0), row(3, 1, True, True, True, None, 70, 2),  # its root ends in the third
            row(4, 1, False, True, False, 0.9, 100, 2)]  # no root, not quiet
    rows += [row(1, 2, False, False, True, 0.1, 1, 2)]  # delivered again
    state = chain.Analysis(str(tmp_path), "50 seconds", 0)
    fed(spark, rows, "graph_id long, run_id long, root boolean, ended boolean, failed boolean, score double, arrival_ts timestamp", state.fold, str(tmp_path))
    graphs = {x.graph_id: x.complete for x in state.graphs.state(spark).collect()}
    assert graphs == {1: "root_ended", 2: "quiet", 3: "root_ended", 4: None}
    got = sorted((x.graph_id, x.incident_key, x.trigger, x.is_new) for x in state.incidents.state(spark).collect())
    assert got == [(1, "low_score", "run_failed,low_score", True), (1, "run_failed", "run_failed,low_score", True), (2, "low_score", "low_score", True), (3, "run_failed", "run_failed", True)]
    assert {(x.graph_id, x.why) for x in state.deep.state(spark).collect()} == {(1, "flagged"), (2, "flagged"), (3, "flagged")}
    assert state.incidents.changes(spark).count() == 4  # each raised once
