"""Configuration rules as joins: a sound configuration breaks none, and each rule has one that breaks it."""

import copy
import json

import pytest

from evalforge.operators import configrules
from evalforge.operators.configrules import Rule
from evalforge.sources import protocol

SOUND = {
    "schema_version": "1.0",
    "experiment": {"id": "demo", "minimum_search_seeds": 3, "mode": "dry-run"},
    "safety": {"offline_by_default": True, "required_network_env": "NET", "required_network_value": "yes", "allowed_prefixes": ["own.a", "own.b"], "allow_network": False},
    "runtime_profiles": {"dry_run": {"provider": "mock", "data_adapter": "made", "network": False}, "real": {"provider": "api", "data_adapter": "files", "network": True}},
    "providers": {"mock": {"enabled": True, "network": False, "kind": "mock"}, "api": {"enabled": False, "network": True, "kind": "http"}},
    "reproducibility": {"reject_path_only_identity": True, "identity_inputs": ["implementation", "manifest", "tasks", "patches", "more"], "external": {"data": {"sha256": "ab" * 32}}},
    "models": {"small": {"provider": "mock"}, "large": {"provider": "api"}},
    "harnesses": {"h": {}},
    "datasets": {"main": {"total_tasks": 60}},
    "splits": {"evolution": {"dataset": "main", "expected_count": 30, "disjoint_from": ["heldout"]}, "validation": {"dataset": "main", "expected_count": 10}, "heldout": {"dataset": "main", "expected_count": 20}},
    "domains": {"d": {"disjoint_from": ["e"]}, "e": {}},
    "targets": {"t0": {"model": "small", "harness": "h", "domain": "d", "split": "validation", "role": "id", "phase": "search"}, "t1": {"model": "large", "harness": "h", "domain": "e", "split": "validation", "role": "transfer", "transfer_group": "g"}},
    "task_seed_blocks": {"search_seeds": [1, 2, 3], "execution_seeds": [7, 9], "shared_across_candidates": True, "paired_against_base": True, "retry_limit": 0, "infrastructure_retry_uses_same_seed": True, "exclude_only_verified_infrastructure_failures": True, "failure_taxonomy": {"eligible_for_retry_and_exclusion": ["outage"], "never_exclude_as_infrastructure": ["wrong"]}},
    "objectives": {"accuracy": {"enabled": True, "direction": "maximize", "target_ids": ["t0"]}, "transfer": {"enabled": True, "target_ids": ["t1"]}, "token_cost": {"enabled": True, "direction": "minimize", "target_ids": ["t0", "t1"]}, "regression": {"enabled": True, "target_ids": ["t0"]}},
    "constraints": {"enabled": True, "id_accuracy_floor": {"epsilon": 0.02, "expression": "base - e"}, "token_budget": {"budget": 900.5, "expression": "limit"}},
    "statistics": {"paired_design": True, "bootstrap_replicates": 2000, "minimum_effective_blocks_for_archive": 2, "confidence_level": 0.95, "dominance": {"primary": "pessimistic_bounds", "weak_all_strict_one": True}},
    "budgets": {"accounting_unit": "task_executions", "spending_limit": 5, "screen": {"tasks_per_target": 4, "execution_seeds_per_task": 1, "target_ids": ["t0", "t1"], "task_executions": 8, "is_subset_of_full_matrix": True}, "full": {"tasks_per_target": 10, "execution_seeds_per_task": 2, "target_ids": ["t0", "t1"], "task_executions": 40, "task_executions_including_screen_subset": 40, "incremental_task_executions_after_screen": 32}, "search_total_per_method": {"task_executions": 208, "screen_allocation_task_executions": 80, "incremental_promotion_allocation_task_executions": 128, "maximum_unique_screened_candidates": 10, "maximum_promoted_candidates": 4}},
    "methods": {"top_k": {"family": "f", "search": "s", "top_k": 4}, "fixed_scalarization": {"family": "f", "search": "s", "variants": [{"id": "a", "weights": {"accuracy": 1, "transfer": 0.5}}, {"id": "b", "weights": {"accuracy": 0}}]}},
    "ablations": [{"base_method": "top_k", "overrides": {"x": 1}}],
    "runner": {"smoke": {"max_candidates": 2, "blocks_per_target": 2, "candidate_limits": {"top_k": 1}}},
    "selection_protocol": {"search_uses_final_splits": False, "archive_capacity": {"max_entries": 32}, "working_archive": {"capacity": {"max_entries": 32}, "admission": {"require_conservative_feasibility": True, "require_not_robustly_dominated": True, "content_hash_deduplicate": True}}, "archive_admission": {"require_conservative_feasibility": True, "require_not_robustly_dominated": True, "content_hash_deduplicate": True}, "scientific_front": {"capacity": None}},
    "deployment": {"never_tune_on_final_test": True},
    "metrics": {g: ["one"] for g in ("primary", "frontier", "efficiency", "diagnostic")},
    "shared_search_controls": {k: "x" for k in ("base_skill", "trace_store", "patch_pool", "verifier")},
    "proposer": {"require_trace_evidence": True, "require_parent_version": True, "model": "large"},
    "outputs": {"root": "out", "required_files": ["resolved_manifest.yaml", "task_outcomes.jsonl", "candidates.jsonl", "lineage.jsonl", "archive.json", "checkpoint.json"]},
}


def at(config, path):
    """(holder, key) of the first node that a path names."""
    *parents, last = path.split(".")
    for p in parents:
        config = config[int(p)] if isinstance(config, list) and p != "*" else config[0] if isinstance(config, list) else config[next(iter(config)) if p == "*" else p]
    if last == "*":
        last = 0 if isinstance(config, list) else next(iter(config))
    return config, last


def broken(rule):
    """A sound configuration with one change that breaks the rule."""
    out = copy.deepcopy(SOUND)
    if rule.when:
        key, value = rule.when.split(".")[-1], rule.is_[0]
        if "*" in rule.when:  # the node of that kind
            name = next(n for n, t in out["targets"].items() if t[key] == value)
            rule = Rule(rule.id, rule.kind, rule.path.replace("*", name), rule.values, rule.other, rule.low)
        else:
            holder, k = at(out, rule.when)
            holder[k] = value
            out["safety"]["allow_network"] = value == "real"
    if rule.kind == "absent":
        holder, k = at(out, rule.path)
        holder[k] = "g"
        return out
    holder, k = at(out, rule.path)
    old = holder[k]
    bad = {"kind": 3.5, "filled": "  ", "value": "neither", "range": "many", "matches": "zz", "refers": ["nobody"] if isinstance(old, list) else "nobody", "unique": [1, 2, 2, 3], "contains": [], "equal": -1, "sum": -5, "product": 3, "disjoint": ["t0", "outage"]}
    if rule.kind == "range" and rule.low is not None:
        holder[k] = rule.low if rule.open_ else rule.low - 1
    else:
        holder[k] = bad[rule.kind]
    return out


def found(spark, configs, rules=protocol.ALL):
    df = spark.createDataFrame([(n, json.dumps(c) if not isinstance(c, str | None) else c) for n, c in configs.items()], "config_id string, json string")
    out = {n: {} for n in configs}
    for r in configrules.problems(df, rules).collect():
        out[r.config_id].setdefault(r.rule, set()).add((r.at, r.problem))
    return out


def test_each_rule_has_a_failing_example(spark):
    configs = {"sound": SOUND} | {r.id: broken(r) for r in protocol.ALL}
    got = found(spark, configs)
    assert got["sound"] == {}
    assert [r.id for r in protocol.ALL if r.id not in got[r.id]] == []
    assert len(protocol.ALL) > 120 and len(protocol.RULES) == 24


def test_missing_parts(spark):
    less = copy.deepcopy(SOUND)
    del less["budgets"], less["statistics"]["paired_design"], less["targets"]["t1"]["model"]
    got = found(spark, {"x": less})["x"]
    assert got["part:budgets"] == {("", "missing")} and got["statistics.paired_design"] == {("", "missing")} and got["targets.*.model"] == {("t1", "missing")}
    assert "budgets.accounting_unit" not in got  # what holds it is named, not everything in it


def test_not_configurations(spark):
    got = found(spark, {"a": "{", "b": "[1]", "c": None, "d": "{}"})
    assert all(got[k]["json"] == {("", "kind")} for k in "abc") and "json" not in got["d"] and got["d"]["part:models"] == {("", "missing")}


def test_kinds_of_rules(spark):
    rules = [Rule("frozen", "frozen", "f", ("a", "b")), Rule("open", "range", "r", low=0, high=1, open_=True), Rule("whole", "range", "w", ("integer",), low=1), Rule("sum", "sum", "g.*.total", terms=("g.*.x", "-g.*.y")), Rule("product", "product", "n", terms=("l", "k")), Rule("equal", "equal", "g.*.name", other="g.*.alias", optional=True)]
    good = {"f": ["a", "b"], "r": 0.5, "w": 3, "g": {"u": {"total": 1, "x": 3, "y": 2, "name": "z", "alias": "z"}, "v": {"total": -1.5, "x": 0.5, "y": 2}}, "n": 6, "l": [1, 1, 1], "k": 2}
    bad = {"f": ["b", "a"], "r": 1, "w": 3.0, "g": {"u": {"total": 2, "x": 3, "y": 2, "name": "z", "alias": "q"}, "v": {"total": 0, "x": 0}}, "n": 5, "l": [1, 1, 1], "k": 2}
    got = found(spark, {"good": good, "bad": bad, "bool": good | {"w": True, "f": ["a", "b", "c"]}}, rules)
    assert got["good"] == {}
    assert got["bad"] == {"frozen": {("", "frozen")}, "open": {("", "range")}, "whole": {("", "range")}, "sum": {("u", "sum"), ("v", "sum")}, "product": {("", "product")}, "equal": {("u", "equal")}}
    assert got["bool"] == {"whole": {("", "range")}, "frozen": {("", "frozen")}}
    with pytest.raises(ValueError, match="different"):
        found(spark, {"a": good}, [rules[0], rules[0]])
    with pytest.raises(ValueError, match="unknown kind"):
        Rule("x", "magic", "p")


def test_many_configurations(spark):
    configs = {f"c{i}": copy.deepcopy(SOUND) for i in range(60)}
    for i in range(0, 60, 7):
        configs[f"c{i}"]["models"]["small"]["provider"] = "gone"
    got = found(spark, configs)
    assert {n for n, p in got.items() if p} == {f"c{i}" for i in range(0, 60, 7)}
    assert all(p == {"models.*.provider": {("small", "refers")}} for p in got.values() if p)


def test_parsed_once(spark):
    """Configurations are parsed once, whatever the number of rules; rules' kinds read what was parsed."""
    df = spark.createDataFrame([("a", json.dumps({"x": {"y": 1, "z": [1, 1]}}))], "config_id string, json string")
    got = configrules.problems(df, [Rule("r", "range", "x.*", low=2), Rule("u", "unique", "x.z"), Rule("s", "sum", "x.y", terms=("x.y", "x.y"))])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
    assert {(r.rule, r["at"], r.problem) for r in got.collect()} == {("r", "y", "range"), ("r", "z", "range"), ("u", "", "unique"), ("s", "", "sum")}
