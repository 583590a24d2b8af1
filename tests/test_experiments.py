"""Controllers, the search loop, configurations, verifiers, roll-ups and snapshots."""

import copy
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evalforge.functions import canonical
from evalforge.operators import archive, bootstrap, controllers, finals, lineage, objectives, pareto, search, selection
from evalforge.plans import evaluation
from evalforge.sources import ledger, manifest

IDS = ["a", "b", "c", "d", "e"]


def value(subset):
    """Made-up scores: more patches are more accurate but dearer, "c" spoils."""
    return (len(subset) / 5 - 0.3 * ("c" in subset), 1 - len(subset) / 5, 0.5)


def feedback(asked, start=0):
    return [controllers.Scored(s, f"id-{'-'.join(s)}", f"h-{'-'.join(s)}", value(s)) for s in reversed(asked)]


def test_common_order():
    order = controllers.CommonOrder.drawn(IDS, 12, 0.5, 3)
    a, b = order.fork(), order.fork()
    assert a.ask(4) == b.ask(4) and a.fork(True).ask(2) == b.ask(2) and a.fork().ask(1) == order.subsets[:1]
    with pytest.raises(controllers.SearchError):
        a.ask(9)
    assert len(set(order.subsets)) == 12


@pytest.mark.parametrize("method", ["top_k", "annealed", "initial_design", "genetic", "adapted"])
def test_controllers_go_on_from_their_state(spark, method):
    class Next:
        def propose(self, observed, count):
            all_ = [tuple(x for i, x in enumerate(IDS) if n >> i & 1) for n in range(1, 32)]
            return [s for s in all_ if s not in {o.subset for o in observed}][:count]

    make = lambda: controllers.controller(method, IDS, 5, 12, budget=12, reference=(0.0, 0.0, 0.0), adapter=Next())
    one, two = make(), make()
    for step in range(3):
        asked = one.ask(4)
        assert len(set(asked)) == 4 and all(s and set(s) <= set(IDS) for s in asked)
        with pytest.raises(controllers.SearchError):
            one.ask(1)
        with pytest.raises(controllers.SearchError):
            one.tell(feedback(asked)[:-1])
        one.tell(feedback(asked))
        two = controllers.restore(json.loads(json.dumps(two.state())), Next())
        assert two.ask(4) == asked
        two = controllers.restore(json.loads(json.dumps(two.state())), Next())
        two.tell(feedback(asked))
        assert two.state() == one.state()
    subsets = [s.subset for s in one.observed]
    assert len(set(subsets)) == 12
    if method == "top_k":
        assert [s.subset for s in one.incumbents] == sorted(subsets, key=lambda s: (-value(s)[0], f"h-{'-'.join(s)}"))[:8]
    if method == "annealed":
        assert one.spent == 12 and [d["turn"] for d in one.decisions] == list(range(12)) and one.decisions[0]["accepted"] and one.decisions[0]["parent_id"] is None
        with pytest.raises(controllers.SearchError):
            one.ask(1)
    if method == "genetic":
        dom = lambda x, y: all(p >= q for p, q in zip(x, y)) and x != y
        assert one.generation == 3 and len(one.population) == 12
        front = {s for s in subsets if not any(dom(value(t), value(s)) for t in subsets)}
        assert front <= {s.subset for s in one.population}


def test_invalid_proposals_are_never_accepted():
    c = controllers.controller("annealed", IDS, 1, 6, budget=6, reference=(0.0, 0.0, 0.0))
    asked = c.ask(2)
    c.tell([controllers.Scored(s, str(s), str(s), (0.9, 0.9, 0.9), 0, i > 0) for i, s in enumerate(asked)])
    assert [d["accepted"] for d in c.decisions] == [False, True] and c.spent == 0


def test_static_methods():
    assert controllers.static_subsets("base", IDS, 5, 1) == []
    assert controllers.static_subsets("full_merge", IDS, 5, 1) == [tuple(IDS)]
    a = controllers.static_subsets("passive_archive", IDS, 9, 1)
    assert a == controllers.static_subsets("annealed", IDS, 9, 1) and len(a) == 9
    assert len(controllers.static_subsets("random_composition", IDS, 99, 1)) == 31
    assert controllers.static_subsets("accuracy", IDS, 3, 1)[0] == tuple(IDS)
    names = selection.builtin().plugins
    assert len(names) == 12 and names["full_merge"].propose(IDS, 4, 1) == [tuple(IDS)]


def a_run(spark, path, identity="run-1"):
    def materialise(subset):
        return ("same" if subset in (("a",), ("b",)) else "h" + "".join(subset), "no_such_block" if subset == ("d",) else None)

    def score(rows):
        n = F.size("subset")
        return rows.select("candidate_id", (n / 5).alias("v1"), (1 - n / 5).alias("v2"), F.lit(3).alias("cost"))

    subsets = [("a",), ("d",), ("b",), ("a", "b"), ("c",), ("c", "d")]
    return controllers.SearchRun(spark, path, identity, controllers.TopK(order=controllers.CommonOrder(subsets), k=3), materialise, score, (0.0, -100.0), 99.0)


def test_search_run(spark, tmp_path):
    path = str(tmp_path / "run")
    run = a_run(spark, path)
    assert run.resume() == 0 and not run.complete()
    first = {tuple(r.subset): r for r in run.step(3).collect()}
    assert first["a",].valid and first["d",].reason == "no_such_block" and first["b",].reason == "repeated_content"
    assert first["d",].candidate_id.startswith("invalid-") and first["d",].cost == 0
    again = a_run(spark, path)
    assert again.resume() == 1 and again.strategy.state() == run.strategy.state() and again.contents == run.contents
    again.step(3)
    # a batch that was written but not committed is done again
    third = a_run(spark, path)
    assert third.resume() == 2
    third.finish()
    assert third.complete() and third.consumed().count() == 6
    assert [s.subset for s in third.strategy.incumbents][0] in {("a", "b"), ("c", "d")}
    with pytest.raises(controllers.SearchError):
        a_run(spark, path, "run-2").resume()
    spark.read.parquet(f"{path}/feedback/batch=0").limit(2).write.parquet(f"{path}/cut")
    import shutil

    shutil.rmtree(f"{path}/feedback/batch=0")
    os.rename(f"{path}/cut", f"{path}/feedback/batch=0")
    with pytest.raises(controllers.SearchError):
        a_run(spark, path).resume()


def test_rejected_and_promoted(spark):
    r = controllers.rejected(("b", "a"), "why", 10.0)
    assert (r["accuracy"], r["transfer"], r["token_cost"], r["regression"], r["cost"]) == (0.0, 0.0, 11.0, 1.0, 0)
    assert r["content_hash"] == canonical.digest({"patch_ids": ["b", "a"], "reason": "why"})
    events = controllers.attempts(spark.createDataFrame([("x", 2, 3), ("y", 9, 1), ("z", 0, 1)], "request_fingerprint string, fails int, retry_limit int"))
    assert sorted((e.request_fingerprint, e.attempt_number, e.will_retry) for e in events.collect()) == [("x", 1, True), ("x", 2, True), ("y", 1, True), ("y", 2, False)]


def test_expand(spark):
    rows = [("r", "p", [], 0.2, 0.9), ("r", "q", [], 0.9, 0.1)]
    entries = spark.createDataFrame(rows, "run_id string, candidate_id string, reasons array<string>, v1 double, v2 double")
    evidence = spark.createDataFrame([("e", ["transfer"])], "evidence_id string, tags array<string>")
    asked = []

    def propose(parent, direction, turn):
        asked.append((parent, direction))
        return spark.createDataFrame([(f"n{turn}", turn)], "candidate_id string, turn int")

    score = lambda p: p.select(F.lit("r").alias("run_id"), "candidate_id", F.array().cast("array<string>").alias("reasons"), (F.col("turn") * 0.1 + 0.5).alias("v1"), F.lit(0.5).alias("v2"))
    out = controllers.expand(entries, evidence, propose, score, 2, 3, 4, 8)
    assert out.count() == 4 and len(asked) == 2 and {d for _, d in asked} == {"transfer"}


CONFIG = {
    "experiment": {"id": "demo", "search_seeds": [1, 2, 3], "execution_seeds": [5, 2]},
    "providers": {"p": {}},
    "models": {"m": {"provider": "p", "model_id": "m-1"}},
    "harnesses": {"h": {}},
    "domains": {"d": {"disjoint_from": ["x"]}, "x": {}},
    "targets": {"t0": {"model": "m", "harness": "h", "domain": "d", "split": "s"}, "t1": {"model": "m", "harness": "h", "domain": "x", "split": "s", "transfer_group": "g"}, "t2": {"model": "m", "harness": "h", "domain": "x", "phase": "final_only"}},
    "objectives": {"accuracy": {"target_ids": ["t0"]}, "transfer": {"target_ids": ["t1"]}},
    "constraints": {"epsilon": 0.02, "token_budget": 100},
    "budget": {"candidates": 2, "tasks": 3, "seeds": 2, "targets": 2, "executions": 24},
    "statistics": {"ranges": {"accuracy": [0, 1], "transfer": [0, 1], "token_cost": [-200, 0], "regression": [-1, 0]}, "reference": [0, 0, 0, 0]},
}


def test_configuration(spark):
    assert manifest.problems(CONFIG) == []
    c = manifest.constraints_of(CONFIG)
    assert (c.delta_floor, c.token_budget) == (-0.02, 100.0) and manifest.ranges_of(CONFIG)["token_cost"] == (-200.0, 0.0)
    assert manifest.execution_seeds(CONFIG) == [2, 5] and manifest.active_objectives(CONFIG) == objectives.OBJECTIVES
    assert not manifest.constraints_of(manifest.ablated(CONFIG | {"constraints": {"epsilon": 0.1, "token_budget": 5, "enabled": True}}, {"constraints.enabled": False})).enabled
    for path, bad in (("budget.executions", 23), ("models.m.provider", "q"), ("targets.t1.domain", "zz"), ("experiment.search_seeds", [1, 1, 2]), ("statistics.reference", [0, 0, 0, float("nan")]), ("statistics.ranges", {}), ("constraints.epsilon", 2), ("objectives.transfer", {"target_ids": ["t0"]}), ("experiment.id", " "), ("domains.d", {"disjoint_from": ["nope"]})):
        assert manifest.problems(manifest.ablated(CONFIG, {path: bad})), path
    with pytest.raises(manifest.ConfigError, match="is missing"):
        manifest.validated({})
    with pytest.raises(manifest.ConfigError):
        manifest.ablated(CONFIG, {"nothing.here": 1})
    got = {r.target_id: (r.objective_role, r.provider_id, r.model_id) for r in manifest.targets(spark, CONFIG).collect()}
    assert got == {"t0": ("id", "p", "m-1"), "t1": ("transfer", "p", "m-1"), "t2": ("final", "p", "m-1")}
    assert [r.target_id for r in manifest.targets(spark, CONFIG, "final_only").collect()] == ["t2"]
    broken = copy.deepcopy(CONFIG)
    broken["targets"]["t0"]["harness"] = "gone"
    with pytest.raises(manifest.ConfigError):
        manifest.targets(spark, broken)
    assert manifest.experiment_id(CONFIG).startswith("demo-") and manifest.experiment_id(CONFIG) != manifest.experiment_id(manifest.ablated(CONFIG, {"budget.tasks": 1}))
    row = manifest.run_metadata(spark, CONFIG, "search", False, "now", {"PYTHONHASHSEED": "0", "SECRET": "x"}).first()
    assert row.environment == {"PYTHONHASHSEED": "0"} and row.declared_id == "demo"


def test_frozen_values():
    x = manifest.freeze({"a": [1, {"b": None}], "c": True})
    with pytest.raises(TypeError):
        x["a"] = 1
    assert manifest.thaw(x) == {"a": [1, {"b": None}], "c": True}
    for bad in ({1: 2}, {"a": float("inf")}, {"a": object()}):
        with pytest.raises(manifest.ConfigError):
            manifest.freeze(bad)


def test_registries():
    def make_domain(n=1):
        return n

    r = manifest.Runtime((make_domain.__module__,))
    r.register("d", make_domain)
    assert r.build("d", n=4) == 4
    with pytest.raises(manifest.ConfigError):
        r.register("d", make_domain)
    with pytest.raises(manifest.ConfigError):
        r.register("e", make_domain, "0" * 64)
    with pytest.raises(manifest.ConfigError):
        manifest.Runtime(("other",)).register("d", make_domain)
    a = manifest.Ablations()
    a.register("small", {"budget.tasks": 1})
    assert a.apply("small", CONFIG)["budget"]["tasks"] == 1 and CONFIG["budget"]["tasks"] == 3
    with pytest.raises(manifest.ConfigError):
        a.apply("none", CONFIG)


def test_verifiers(spark):
    parse = manifest.Verifier.parse
    rows = spark.createDataFrame([(" Yes",), ('{"a": {"b": true}}',), ('{"a": {"b": 1}}',), ("4.99",), ("",)], "x string")
    told = lambda spec: [r.c for r in rows.select(parse(spec).column(F.col("x")).alias("c")).collect()]
    assert told({"kind": "exact_match", "expected": "yes", "case_sensitive": False}) == [True, False, False, False, False]
    assert told({"kind": "exact_match", "expected": {"a": {"b": 1}}}) == [False, False, True, False, False]
    assert told({"kind": "json_boolean", "field_path": ["a", "b"]}) == [False, True, False, False, False]
    assert told({"kind": "json_field", "field_path": ["a", "b"], "expected": 1}) == [False, False, True, False, False]
    assert told({"kind": "builtin", "rule": "nonempty"}) == [True, True, True, True, False]
    assert told({"kind": "builtin", "rule": "numeric_tolerance", "expected": 5, "absolute_tolerance": 0.1}) == [False, False, False, True, False]
    assert parse({"kind": "builtin", "rule": "contains", "expected": "x"}).digest() == parse({"kind": "builtin", "rule": "contains", "expected": "x", "case_sensitive": True}).digest()
    for bad in ({"kind": "nope"}, {"kind": "builtin", "rule": "exact_match"}, {"kind": "exact_match"}, {"kind": "json_boolean", "expected": 1}, {"kind": "builtin", "rule": "contains", "expected": 5}, {"kind": "builtin", "rule": "numeric_tolerance", "expected": 1, "absolute_tolerance": -1}, {"kind": "json_field", "field_path": "a", "expected": 1}, {"kind": "builtin", "rule": "nonempty", "strip": 1}, {"kind": "exact_match", "expected": "x", "more": 1}):
        with pytest.raises(manifest.ConfigError):
            parse(bad)
    with pytest.raises(Exception):
        parse({"kind": "builtin", "rule": "regex_fullmatch", "pattern": "("})


def test_failures(spark, tmp_path):
    event = dict(failure_id="f1", request_fingerprint="r", stage="s", error_type="e", attempt_number=1, retry_limit=2, will_retry=True)
    p = tmp_path / "f.jsonl"
    p.write_text("\n".join(map(json.dumps, [event, event, event | {"failure_id": "f2"}])))
    old = ledger.read_failures(spark, str(p))
    assert old.count() == 2
    ledger.write_failures(old.withColumn("failure_id", F.lit("f3")).limit(1), str(tmp_path / "out"), old)
    assert [r.failure_id for r in ledger.read_failures(spark, str(tmp_path / "out")).orderBy("failure_id").collect()] == ["f1", "f2", "f3"]
    for bad in ([event, event | {"stage": "t"}], [event | {"x": 1}], [{k: v for k, v in event.items() if k != "stage"}]):
        p.write_text("\n".join(map(json.dumps, bad)))
        with pytest.raises(ledger.LedgerError):
            ledger.read_failures(spark, str(p))


def test_caches(spark, tmp_path):
    c = ledger.GenerationCache(spark, str(tmp_path / "g"))
    rows = spark.createDataFrame([("ask", "answer"), ("ask2", None)], "request string, response string")
    assert c.store(rows) == 2 and c.store(rows) == 0 and c.problems().count() == 0
    keys = rows.select(F.sha2("request", 256).alias("cache_key"))
    assert c.get(keys).count() == 2
    bad = spark.createDataFrame([("0" * 64, 1, "other", "x", "ff")], "cache_key string, version int, request string, response string, prefix string")
    bad.write.mode("append").partitionBy("prefix").parquet(c.path)
    assert [(r.cache_key, r.problem) for r in c.problems().collect()] == [("0" * 64, "wrong_folder")]
    bad.withColumn("prefix", F.lit("00")).write.mode("append").partitionBy("prefix").parquet(c.path)
    with pytest.raises(ledger.LedgerError):
        c.get(bad.select("cache_key"))


def test_collections(spark, tmp_path):
    f = tmp_path / "tasks.json"
    f.write_text(json.dumps({"tasks": [{"task_id": "a"}, "b", {"id": "c"}]}))
    assert sorted(r.task_id for r in ledger.read_task_ids(spark, str(f)).collect()) == ["a", "b", "c"]
    f.write_text(json.dumps({"other": 1}))
    with pytest.raises(ledger.LedgerError):
        ledger.read_task_ids(spark, str(f)).collect()
    f.write_text(json.dumps(["a", "a"]))
    with pytest.raises(ledger.LedgerError):
        ledger.read_task_ids(spark, str(f))
    y = tmp_path / "tasks.yaml"
    y.write_text("task_ids:\n- a\n- task_id: b\n")
    pytest.importorskip("yaml")
    assert sorted(r.task_id for r in ledger.read_task_ids(spark, str(y)).collect()) == ["a", "b"]


def test_manifest_envelope(spark, tmp_path):
    f = tmp_path / "m.json"
    task = dict(task_id="k", split_id="s", objective_roles=["id", "transfer"], payload={"q": 1})
    f.write_text(json.dumps({"tasks": [task]}))
    got = ledger.read_manifest(spark, str(f), 1).collect()
    assert sorted(r.objective_role for r in got) == ["id", "transfer"] and json.loads(got[0].payload) == {"q": 1}
    for bad in (task | {"unknown": 1}, {k: v for k, v in task.items() if k != "objective_roles"}):
        f.write_text(json.dumps({"tasks": [bad]}))
        with pytest.raises(ledger.LedgerError):
            ledger.read_manifest(spark, str(f))


def test_artifacts(spark, tmp_path):
    d = tmp_path / "skill"
    (d / "sub").mkdir(parents=True)
    (d / "S.md").write_text("one\r\ntwo")
    (d / "sub" / "T.md").write_text("é")
    got = {r.path: r.content for r in ledger.read_artifact(spark, str(d)).collect()}
    assert got == {"S.md": "one\ntwo", "sub/T.md": "é"}
    assert ledger.read_artifact(spark, str(d / "S.md")).first().path == "S.md"
    j = tmp_path / "a.json"
    j.write_text(json.dumps({"files": {"./x.md": "y"}}))
    assert [tuple(r) for r in ledger.read_artifact(spark, str(j)).collect()] == [("x.md", "y")]
    j.write_text(json.dumps({"files": {"../x.md": "y"}}))
    with pytest.raises(ledger.LedgerError):
        ledger.read_artifact(spark, str(j))
    (d / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(ledger.LedgerError):
        ledger.read_artifact(spark, str(d))
    (d / "bad.md").unlink()
    (d / "link").symlink_to(d / "S.md")
    with pytest.raises(ledger.LedgerError):
        ledger.read_artifact(spark, str(d))


def test_write_json(spark, tmp_path):
    p = str(tmp_path / "x.json")
    for v in ({"b": 1, "a": [None]}, {"c": 2}):
        ledger.write_json(spark, v, p)
        assert json.loads(open(p).read()) == v
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".new")]


def test_snapshots(spark, tmp_path):
    rnd = random.Random(3)
    rows = [("r", i, f"c{i}", f"h{i % 20}", 1, ["x"] if i % 6 == 0 else [], float(rnd.randrange(9)), float(rnd.randrange(9))) for i in range(25)]
    e = spark.createDataFrame(rows, "run_id string, pos long, candidate_id string, content_hash string, cost int, reasons array<string>, v1 double, v2 double")
    archive.save(e, 4, 18, str(tmp_path / "a"))
    assert archive.load(spark, str(tmp_path / "a"), 4, 18)["entries"].count() == 25
    with pytest.raises(ValueError):
        archive.load(spark, str(tmp_path / "a"), 4, 10)
    by_id = archive.admitted(e, 4, 18).orderBy("pos").collect()
    assert [r.candidate_id for r in by_id] == sorted(r[2] for r in rows)
    v = spark.createDataFrame([("v1", None, "a"), ("v2", "v1", "b"), ("v3", "v1", "a")], "version_id string, parent_version_id string, content string").withColumn("content_hash", F.sha2("content", 256))
    lineage.save(v, str(tmp_path / "v"))
    contents, derived = lineage.load(spark, str(tmp_path / "v"))
    assert contents.count() == 2 and derived.count() == 3
    lineage.save(v.withColumn("parent_version_id", F.when(F.col("version_id") == "v1", "v2").otherwise(F.col("parent_version_id"))), str(tmp_path / "w"))
    with pytest.raises(ValueError):
        lineage.load(spark, str(tmp_path / "w"))


def test_admission_fold_against_rebuilding():
    """The incremental front and archive against fronts rebuilt at each arrival."""
    rnd = random.Random(9)
    for trial in range(20):
        a = archive.Archive(3, 1000, 2, tolerance=rnd.choice([0.0, 0.5]))
        seen = {}
        better = lambda x, y: all(p + a.tolerance >= q for p, q in zip(x, y)) and any(p > q + a.tolerance for p, q in zip(x, y))
        for i in range(40):
            v = (float(rnd.randrange(8)), float(rnd.randrange(8)))
            ok, reason, gone = a.arrive(f"c{i:02}", f"h{i}", 1, v, ())
            seen[f"c{i:02}"] = v
            whole = {k for k, x in seen.items() if not any(better(w, x) for w in seen.values())}
            assert set(a.front.members) == whole
            assert a.held == archive.roomiest({k: seen[k] for k in whole}, 3) and ok == (f"c{i:02}" in a.held)
            assert (reason.startswith("dominated_by:")) == (f"c{i:02}" not in whole)


def test_fronts_in_blocks(spark, monkeypatch):
    """Large fronts are compared block by block; with a tolerance, all rows are compared with the strict front."""
    rnd = random.Random(4)
    rows = [(f"c{i}", float(rnd.randrange(30)), float(rnd.randrange(30)), rnd.choice("ab")) for i in range(400)]
    d = spark.createDataFrame(rows, "candidate_id string, v1 double, v2 double, run string")
    for tolerance in (0.0, 1.5):
        dom = lambda a, b, t=tolerance: all(x + t >= y for x, y in zip(a[1:3], b[1:3])) and any(x > y + t for x, y in zip(a[1:3], b[1:3]))
        want = {b[0] for b in rows if not any(dom(a, b) for a in rows)}
        for meet in (50_000, 3):
            monkeypatch.setattr(pareto, "MEET", meet)
            assert {r.candidate_id for r in pareto.front(d.repartition(4), tolerance=tolerance).collect()} == want
        by = {b[0] for b in rows if not any(dom(a, b) for a in rows if a[3] == b[3])}
        assert {r.candidate_id for r in pareto.front(d.repartition(4), ["run"], tolerance).collect()} == by


def test_roll_up(spark, tmp_path):
    for m in ("x", "y"):
        for s in (1, 2):
            rows = spark.createDataFrame([(f"k{i}", i % 2 == 0, i) for i in range(s, s + 3)], "task_id string, correct boolean, tokens long")
            rows.write.json(str(tmp_path / f"root/method_id={m}/search_seed={s}/outcomes"))
    root, schema = str(tmp_path / "root"), "task_id string, correct boolean, tokens long"
    out = finals.roll_up(spark, root, schema, ["task_id"], ["correct", "tokens"])
    got = {r.task_id: r.runs for r in out["outcomes"].collect()}
    assert got == {"k1": "x/1,y/1", "k2": "x/1,x/2,y/1,y/2", "k3": "x/1,x/2,y/1,y/2", "k4": "x/2,y/2"} and out["index"].count() >= 4
    assert {r.name: r.rows for r in finals.add_final(spark, root, {"fronts": spark.range(3)}).collect()} == {"outcomes": 4, "fronts": 3}
    spark.createDataFrame([("k1", True, 99)], "task_id string, correct boolean, tokens long").write.mode("append").json(str(tmp_path / "root/method_id=x/search_seed=1/outcomes"))
    with pytest.raises(ledger.LedgerError):
        finals.roll_up(spark, root, schema, ["task_id"], ["correct", "tokens"])


def test_primary_analysis(spark):
    o = evaluation.outcomes(spark, "/root/testdata/sf0.001", 4, 8)
    rows = o.withColumn("content_hash", F.sha2("candidate_id", 256)).withColumn("role", F.col("split")).withColumn("execution_group", F.col("target_id"))
    runs = spark.createDataFrame([(m, s, f"c{(i + s) % 4}") for i, m in enumerate(("ours", "other", "third")) for s in (1, 2, 3)], "method_id string, search_seed long, candidate_id string")
    out = finals.primary_analysis(rows, runs, objectives.Constraints(0.0, 1000.0, -1.0), evaluation.RANGES, [0.0] * 4, "ours", ["other", "third"], [1, 2, 3], replicates=20)
    assert out["fronts"].count() == 9 and out["estimates"].count() == 4
    assert {r.comparison for r in out["contrasts"].collect()} == {"other", "third"} and out["contrasts"].where("p is null").count() == 0
    quick = finals.summaries(out["observations"], 10_000, 1, quick=True, token_bound=1e9)
    assert quick.count() == 4


def test_own_seeds(spark):
    import hashlib

    d = spark.createDataFrame([("c1", "t1")], "c string, t string")
    for seed in (0, 7, 2**40 + 3):
        got = d.select(bootstrap.own_seed(seed, F.concat_ws("\0", "c", "t")).alias("s")).first().s
        assert int(got) == seed ^ int(hashlib.sha256(b"c1\0t1").hexdigest()[:16], 16)


def test_strict_merge_and_flips(spark):
    from evalforge.operators import accounting, inference

    a = spark.createDataFrame([("k", 1)], "k string, v int")
    assert accounting.merged_strictly([a, a], ["k"], ["v"]).first().v == 1
    with pytest.raises(Exception, match="differ"):
        accounting.merged_strictly([a, a.withColumn("v", F.lit(2))], ["k"], ["v"]).collect()
    long_ = spark.createDataFrame([([1.0] * 41,)], "d array<double>")
    with pytest.raises(Exception, match="exact p"):
        long_.select(inference.sign_flip_p("d")).collect()


def test_search_diverse_is_stable():
    assert search.diverse(IDS, 12, 3) == search.diverse(list(reversed(IDS)), 12, 3) and len(set(search.diverse(IDS, 40, 1))) == 31


def test_names_of_versions():
    assert manifest.base_version("h") == manifest.base_version("h") != manifest.base_version("i")
    assert manifest.EMPTY_SHA256.startswith("e3b0c442")


def test_tree_digests(spark):
    import hashlib

    files = {"b/x.md": b"one\0two", "a.md": "é".encode(), "b.md": b""}
    df = spark.createDataFrame([("t", p, bytearray(c)) for p, c in files.items()], "tree string, path string, content binary")
    h = hashlib.sha256()
    for p in sorted(files):
        h.update(p.encode() + b"\0" + files[p] + b"\0")
    assert manifest.content_sha256(df, ["tree"]).first().sha256 == h.hexdigest()
    own = "".join(f"{p}\0{hashlib.sha256(files[p]).hexdigest()}\0" for p in sorted(files))
    assert manifest.tree_digest(df.select("path", F.sha2("content", 256).alias("sha256"))).first().sha256 == hashlib.sha256(own.encode()).hexdigest()


def test_generations_come_from_the_cache(spark, tmp_path):
    cache, seen = ledger.GenerationCache(spark, str(tmp_path / "g")), []

    def generate(missing):
        seen.append(sorted(r.request for r in missing.collect()))
        return missing.withColumn("response", F.upper("request"))

    one = spark.createDataFrame([("a",), ("b",), ("a",)], "request string")
    got = {r.request: (r.response, r.cache_hit) for r in manifest.generated(one, cache, generate).collect()}
    assert got == {"a": ("A", False), "b": ("B", False)}
    got = {r.request: r.cache_hit for r in manifest.generated(spark.createDataFrame([("b",), ("c",)], "request string"), cache, generate).collect()}
    assert got == {"b": True, "c": False} and seen == [["a", "b"], ["c"]]


def test_profiles(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"a": {"b": 1}, "profiles": {"quick": {"a.b": 2, "a.c": 3}}}')
    assert ledger.load_config(str(f), profile="quick") == {"a": {"b": 2, "c": 3}}
    assert ledger.load_config(str(f), {"a.b": 9}, profile="quick")["a"] == {"b": 9, "c": 3}
    with pytest.raises(ledger.LedgerError):
        ledger.load_config(str(f), profile="none")


@pytest.mark.parametrize("active", [(), ("accuracy", "accuracy"), ("accuracy", "speed"), ("Accuracy",)])
def test_unknown_objectives(spark, active):
    from evalforge.operators import objectives

    with pytest.raises(ValueError, match="each once"):
        objectives.maximised(spark.range(1), active)


def test_some_objectives(spark):
    from evalforge.operators import objectives

    row = spark.createDataFrame([(0.5, 0.25, 9.0, 0.125)], "accuracy double, transfer double, token_cost double, regression double")
    got = objectives.maximised(row, ("regression", "accuracy")).first()
    assert (got.v1, got.v2) == (0.5, -0.125) and "v3" not in got.asDict()


def test_what_a_harness_needs(spark):
    """Whatever has the methods can stand in for a harness, a cache or a domain, and the runtime runs with them."""
    from evalforge.sources import manifest

    class Echo:
        def evaluate(self, requests):
            return requests.withColumn("correct", F.lit(True))

    class Held:
        def __init__(self):
            self.rows = None

        def get(self, keys):
            return keys.limit(0) if self.rows is None else self.rows.join(keys, "key", "left_semi")

        def put(self, rows):
            self.rows = rows
            return rows.count()

    class Tasks:
        def tasks(self, split):
            return spark.createDataFrame([(split, "k1")], "split string, task_id string")

    harness: manifest.Harness = Echo()
    cache: manifest.EvaluationCache = Held()
    domain: manifest.DomainAdapter = Tasks()
    got = harness.evaluate(domain.tasks("heldout").withColumnRenamed("task_id", "key"))
    assert cache.get(got.select("key")).count() == 0 and cache.put(got) == 1
    assert cache.get(got.select("key")).first().correct is True
