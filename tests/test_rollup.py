"""Roll-up of runs in files: damage is named, a crash leaves the old version, the final stage adds to it."""

import json
import os

import pytest

from evalforge.operators import rollup
from evalforge.sources import ledger

RUNS = [("alpha", 1), ("alpha", 2), ("beta", 1)]


def put(root, run, name, rows):
    at = f"{root}/method_id={run[0]}/search_seed={run[1]}"
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/{name}", "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def state(rows, **more):
    return {"experiment_id": "e", "complete": True, "rows": rows, "proposed": 4, "screened": 3, "promoted": 1, "rejected": 0, "budget_limit": 9, "budget_complete": True, "selected": ["c1"], "cache_keys": ["k0", "k1"]} | more


def outcome(c, task, tokens=5, base=False):
    return {"candidate_id": c, "target_id": "t", "task_id": task, "seed": 1, "is_base": base, "correct": True, "input_tokens": tokens, "output_tokens": 1}


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "exp")
    for i, run in enumerate(RUNS):
        put(root, run, "outcomes", [outcome("base", "k1", base=True), outcome("c1", "k1"), outcome(f"own{i}", "k1")])
        put(root, run, "candidates", [{"candidate_id": "c1", "content_hash": "h", "parents": []}, {"candidate_id": f"own{i}", "content_hash": f"h{i}", "parents": ["c1"]}])
        put(root, run, "failures", [])
        put(root, run, "proposals", [{"event_id": f"p{i}", "accepted": True, "cache_hit": i == 0, "input_tokens": 7, "output_tokens": 2}])
        put(root, run, "state", [state({"outcomes": 3, "candidates": 2, "failures": 0, "proposals": 1})])
    return root


def expected(spark, more=()):
    return spark.createDataFrame([*RUNS, *more], "method_id string, search_seed long")


def found(spark, root, more=()):
    x = rollup.discover(spark, root, expected(spark, more), "e")
    return {(r.method_id, r.search_seed, r.problem, r.detail): r.fatal for r in rollup.problems(x).collect()}


def test_whole(spark, root):
    assert found(spark, root) == {}
    assert rollup.roll_up(spark, root, expected(spark), "e") == 1
    got = rollup.current(spark, root)
    assert {(r.candidate_id, r.runs) for r in got["outcomes"].collect()} == {("base", "alpha/1,alpha/2,beta/1"), ("c1", "alpha/1,alpha/2,beta/1"), ("own0", "alpha/1"), ("own1", "alpha/2"), ("own2", "beta/1")}
    t = got["totals"].first()
    assert (t.runs, t.matrix_complete, t.budget_complete, t.rows, t.tokens, t.proposals, t.calls, t.proposal_tokens, t.failures, t.cache_keys) == (3, True, True, 4, 24, 3, 2, 18, 0, 2)
    assert got["candidates"].count() == 4 and got["archive"].count() == 0 and got["index"].count() == 12  # empty files have none


def test_runs_that_are_left_out(spark, root):
    put(root, ("beta", 1), "state", [state({"outcomes": 3}, complete=False)])
    put(root, ("gamma", 1), "state", [state({}, experiment_id="x")])
    put(root, ("gamma", 1), "outcomes", [outcome("nobody", "k1")])
    assert found(spark, root, [("delta", 3)]) == {("delta", 3, "missing_run", None): False, ("gamma", 1, "unexpected_run", None): False, ("gamma", 1, "other_experiment", "x"): False, ("beta", 1, "incomplete_run", None): False}
    rollup.roll_up(spark, root, expected(spark, [("delta", 3)]), "e")
    got = rollup.current(spark, root)
    assert not got["totals"].first().matrix_complete and got["outcomes"].count() == 4 and got["left_out"].count() == 4


def test_damage_is_named(spark, root):
    put(root, ("alpha", 1), "outcomes", [outcome("base", "k1", base=True), outcome("c1", "k1"), '{"candidate_id": "own0", "tar'])
    put(root, ("alpha", 2), "outcomes", [outcome("c1", "k1", tokens=6), outcome("lost", "k2"), {**outcome("own1", "k1"), "task_id": None}])
    put(root, ("beta", 1), "candidates", [{"candidate_id": "own2", "content_hash": "h2", "parents": ["gone"]}])
    os.remove(f"{root}/method_id=beta/search_seed=1/failures")
    put(root, ("beta", 1), "state", [state({"outcomes": 3, "candidates": 1, "proposals": 1})])
    got = found(spark, root)
    assert set(got.values()) == {True}
    assert {k[2:] for k in got} == {("damaged_line", "outcomes:1"), ("row_count", "outcomes:3/2"), ("conflict", "outcomes:c1/t/k1/1"), ("unknown_candidate", "outcomes:lost"), ("no_key", "outcomes"), ("unknown_parent", "candidates:gone"), ("missing_ledger", "failures")}
    with pytest.raises(rollup.RollUpError, match="damaged_line"):
        rollup.roll_up(spark, root, expected(spark), "e")
    assert rollup.current(spark, root) == {}


def test_states(spark, root):
    put(root, ("alpha", 1), "state", [state({}), state({})])
    put(root, ("alpha", 2), "state", [{"experiment_id": "e", "complete": True}])
    put(root, ("beta", 1), "state", [state({"outcomes": 3, "candidates": 2, "failures": 0, "proposals": 1}, screened=9)])
    kinds = {(k[0], k[1], k[2]) for k in found(spark, root)}
    assert {("alpha", 1, "repeated_state"), ("alpha", 2, "malformed_state"), ("beta", 1, "malformed_state")} <= kinds


def test_a_crash_leaves_the_old_version(spark, root, monkeypatch):
    rollup.roll_up(spark, root, expected(spark), "e")
    before = sorted(map(tuple, rollup.current(spark, root)["outcomes"].collect()))
    put(root, ("beta", 1), "outcomes", [outcome("base", "k1", base=True), outcome("c1", "k1"), outcome("own2", "k9")])
    write = ledger.write_json
    monkeypatch.setattr(ledger, "write_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):  # all tables are written, the marker isn't
        rollup.roll_up(spark, root, expected(spark), "e")
    assert sorted(map(tuple, rollup.current(spark, root)["outcomes"].collect())) == before
    monkeypatch.setattr(ledger, "write_json", write)
    assert rollup.roll_up(spark, root, expected(spark), "e") == 3  # what the crash left is never written over
    assert any(r.task_id == "k9" for r in rollup.current(spark, root)["outcomes"].collect())


def test_final_stage(spark, root):
    final = spark.createDataFrame([("c1", "t", "k1", 1, False, True, 5, 1), ("c1", "t", "held", 1, False, False, 8, 2)], rollup.OUTCOMES.schema)
    with pytest.raises(rollup.RollUpError, match="no roll-up"):
        rollup.add_final(spark, root, final, {})
    rollup.roll_up(spark, root, expected(spark), "e")
    candidates = sorted(map(tuple, rollup.current(spark, root)["candidates"].collect()))
    for _ in range(2):  # again, as after a crash: the same totals
        rollup.add_final(spark, root, final, {"fronts": spark.range(3)})
        got = rollup.current(spark, root)
        t = got["totals"].first()
        assert (t.rows, t.final_rows, t.total_rows, t.total_tokens) == (4, 2, 6, 40)
        assert {r.runs for r in got["outcomes"].where("candidate_id = 'c1'").collect()} == {"alpha/1,alpha/2,beta/1,final", "final"}
        assert got["fronts"].count() == 3 and sorted(map(tuple, got["candidates"].collect())) == candidates
    bad = spark.createDataFrame([("c1", "t", "k1", 1, False, False, 5, 1)], rollup.OUTCOMES.schema)
    with pytest.raises(ledger.LedgerError, match="disagree"):
        rollup.add_final(spark, root, bad, {})
