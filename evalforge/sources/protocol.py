"""The rules of an experiment's protocol, as data for ``operators.configrules``."""

from __future__ import annotations

from ..operators.configrules import Rule

#: Parts that a configuration has at its top.
PARTS = ("experiment", "safety", "runtime_profiles", "providers", "reproducibility", "models", "harnesses", "datasets", "splits", "domains", "targets", "task_seed_blocks", "objectives", "constraints", "statistics", "budgets", "methods", "selection_protocol", "deployment", "metrics", "shared_search_controls", "proposer", "outputs")


def _true(path: str, **more) -> Rule:
    return Rule(path, "value", path, ("true",), **more)


def _refers(path: str, to: str, **more) -> Rule:
    return Rule(path, "refers", path, other=to, **more)


def _range(path: str, low: float | None, high: float | None = None, whole: bool = False, **more) -> Rule:
    return Rule(path, "range", path, ("integer",) if whole else (), low=low, high=high, **more)


def _filled(path: str, **more) -> Rule:
    return Rule(path, "filled", path, **more)


#: Groups of rules; ids are paths, with a suffix where a path has several rules.
RULES = {
    "parts": [Rule(f"part:{p}", "kind", p, ("object",)) for p in PARTS] + [Rule("schema_version", "value", "schema_version", ("1.0",))],
    "experiment": [_filled("experiment.id"), _range("experiment.minimum_search_seeds", 3, whole=True), Rule("experiment.mode", "value", "experiment.mode", ("dry-run", "real", "replay"))],
    "safety": [_true("safety.offline_by_default"), _filled("safety.required_network_env"), _filled("safety.required_network_value"), Rule("safety.prefixes", "unique", "safety.allowed_prefixes", low=1, optional=True), Rule("safety.dry", "value", "safety.allow_network", ("false",), when="experiment.mode", is_=("dry-run",)), Rule("safety.real", "value", "safety.allow_network", ("true",), when="experiment.mode", is_=("real",))],
    "profiles": [_refers("runtime_profiles.*.provider", "providers"), _filled("runtime_profiles.*.data_adapter"), Rule("runtime_profiles.*.network", "kind", "runtime_profiles.*.network", ("boolean",)), Rule("profiles.offline", "value", "runtime_profiles.dry_run.network", ("false",), when="experiment.mode", is_=("dry-run",))],
    "providers": [Rule("providers.*.enabled", "kind", "providers.*.enabled", ("boolean",)), Rule("providers.*.network", "kind", "providers.*.network", ("boolean",)), _filled("providers.*.kind")],
    "reproducibility": [_true("reproducibility.reject_path_only_identity"), Rule("reproducibility.identity_inputs", "contains", "reproducibility.identity_inputs", ("implementation", "manifest", "tasks", "patches")), Rule("reproducibility.digests", "matches", "reproducibility.external.*.sha256", other="^[0-9a-f]{64}$")],
    "references": [_refers("models.*.provider", "providers"), _refers("splits.*.dataset", "datasets"), _refers("splits.*.disjoint_from", "splits", optional=True), _refers("domains.*.disjoint_from", "domains", optional=True), _refers("targets.*.model", "models"), _refers("targets.*.harness", "harnesses"), _refers("targets.*.domain", "domains"), _refers("targets.*.split", "splits")],
    "splits": [_range("splits.*.expected_count", 1, whole=True), Rule("splits.sum", "sum", "datasets.main.total_tasks", terms=("splits.evolution.expected_count", "splits.validation.expected_count", "splits.heldout.expected_count"))],
    "targets": [Rule("targets.*.phase", "value", "targets.*.phase", ("search", "final_only"), optional=True), Rule("targets.*.role", "value", "targets.*.role", ("id", "transfer")), Rule("targets.transfer_group", "filled", "targets.*.transfer_group", when="targets.*.role", is_=("transfer",)), Rule("targets.no_group", "absent", "targets.*.transfer_group", when="targets.*.role", is_=("id",))],
    "seeds": [Rule("task_seed_blocks.search_seeds", "unique", "task_seed_blocks.search_seeds", low=3), Rule("seeds.search", "kind", "task_seed_blocks.search_seeds.*", ("integer",)), Rule("task_seed_blocks.execution_seeds", "unique", "task_seed_blocks.execution_seeds", low=1), Rule("seeds.execution", "kind", "task_seed_blocks.execution_seeds.*", ("integer",)), _true("task_seed_blocks.shared_across_candidates"), _true("task_seed_blocks.paired_against_base"), _range("task_seed_blocks.retry_limit", 0, whole=True), _true("task_seed_blocks.infrastructure_retry_uses_same_seed"), _true("task_seed_blocks.exclude_only_verified_infrastructure_failures")],
    "failures": [Rule("failures.eligible", "unique", "task_seed_blocks.failure_taxonomy.eligible_for_retry_and_exclusion", low=1), Rule("failures.never", "unique", "task_seed_blocks.failure_taxonomy.never_exclude_as_infrastructure", low=1), Rule("failures.disjoint", "disjoint", "task_seed_blocks.failure_taxonomy.never_exclude_as_infrastructure", other="task_seed_blocks.failure_taxonomy.eligible_for_retry_and_exclusion")],
    "objectives": [Rule("objectives.four", "contains", "objectives", ("accuracy", "transfer", "token_cost", "regression")), _true("objectives.*.enabled"), Rule("objectives.maximised", "value", "objectives.accuracy.direction", ("maximize",)), Rule("objectives.minimised", "value", "objectives.token_cost.direction", ("minimize",)), _refers("objectives.*.target_ids", "targets"), Rule("objectives.disjoint", "disjoint", "objectives.transfer.target_ids", other="objectives.accuracy.target_ids")],
    "constraints": [Rule("constraints.enabled", "kind", "constraints.enabled", ("boolean",)), _range("constraints.id_accuracy_floor.epsilon", 0, 1), _filled("constraints.id_accuracy_floor.expression"), _range("constraints.token_budget.budget", 0), _filled("constraints.token_budget.expression")],
    "statistics": [_true("statistics.paired_design"), _range("statistics.bootstrap_replicates", 100, whole=True), _range("statistics.minimum_effective_blocks_for_archive", 2, whole=True), _range("statistics.confidence_level", 0, 1, open_=True), Rule("statistics.dominance.primary", "value", "statistics.dominance.primary", ("pessimistic_bounds", "point_estimates")), _true("statistics.dominance.weak_all_strict_one")],
    "budgets": [
        Rule("budgets.accounting_unit", "value", "budgets.accounting_unit", ("task_executions",)),
        *[_range(f"budgets.{s}.{k}", 1, whole=True) for s in ("screen", "full") for k in ("tasks_per_target", "execution_seeds_per_task")],
        *[_refers(f"budgets.{s}.target_ids", "targets") for s in ("screen", "full")],
        *[Rule(f"budgets.{s}.matrix", "product", f"budgets.{s}.task_executions", terms=(f"budgets.{s}.tasks_per_target", f"budgets.{s}.target_ids", f"budgets.{s}.execution_seeds_per_task")) for s in ("screen", "full")],
        _true("budgets.screen.is_subset_of_full_matrix"),
        Rule("budgets.including", "equal", "budgets.full.task_executions_including_screen_subset", other="budgets.full.task_executions"),
        Rule("budgets.incremental", "sum", "budgets.full.incremental_task_executions_after_screen", terms=("budgets.full.task_executions", "-budgets.screen.task_executions")),
        Rule("budgets.total", "sum", "budgets.search_total_per_method.task_executions", terms=("budgets.search_total_per_method.screen_allocation_task_executions", "budgets.search_total_per_method.incremental_promotion_allocation_task_executions")),
        *[_range(f"budgets.search_total_per_method.{k}", 1, whole=True) for k in ("maximum_unique_screened_candidates", "maximum_promoted_candidates")],
        Rule("budgets.screening", "product", "budgets.search_total_per_method.screen_allocation_task_executions", terms=("budgets.search_total_per_method.maximum_unique_screened_candidates", "budgets.screen.task_executions")),
        Rule("budgets.promotion", "product", "budgets.search_total_per_method.incremental_promotion_allocation_task_executions", terms=("budgets.search_total_per_method.maximum_promoted_candidates", "budgets.full.incremental_task_executions_after_screen")),
    ],
    "methods": [_filled("methods.*.family"), _filled("methods.*.search"), _range("methods.top_k.top_k", 1, whole=True), Rule("methods.variants", "filled", "methods.fixed_scalarization.variants.*.id"), _range("methods.fixed_scalarization.variants.*.weights.*", 0)],
    "ablations": [_refers("ablations.*.base_method", "methods"), Rule("ablations.*.overrides", "kind", "ablations.*.overrides", ("object",))],
    "runner": [_range("runner.smoke.max_candidates", 1, whole=True), _range("runner.smoke.blocks_per_target", 2, whole=True), _range("runner.smoke.candidate_limits.*", 1, whole=True)],
    "selection": [Rule("selection_protocol.search_uses_final_splits", "value", "selection_protocol.search_uses_final_splits", ("false",)), _range("selection_protocol.archive_capacity.max_entries", 1, whole=True), Rule("selection.alias", "equal", "selection_protocol.working_archive.capacity.max_entries", other="selection_protocol.archive_capacity.max_entries"), *[_true(f"selection_protocol.{at}.{k}") for at in ("working_archive.admission", "archive_admission") for k in ("require_conservative_feasibility", "require_not_robustly_dominated", "content_hash_deduplicate")], Rule("selection.unbounded", "kind", "selection_protocol.scientific_front.capacity", ("null",))],
    "deployment": [_true("deployment.never_tune_on_final_test")],
    "metrics": [Rule(f"metrics.{g}", "unique", f"metrics.{g}", low=1) for g in ("primary", "frontier", "efficiency", "diagnostic")],
    "controls": [_filled(f"shared_search_controls.{k}") for k in ("base_skill", "trace_store", "patch_pool", "verifier")] + [_true(f"proposer.{k}") for k in ("require_trace_evidence", "require_parent_version")] + [_refers("proposer.model", "models")],
    "outputs": [_filled("outputs.root"), Rule("outputs.required_files", "contains", "outputs.required_files", ("resolved_manifest.yaml", "task_outcomes.jsonl", "candidates.jsonl", "lineage.jsonl", "archive.json", "checkpoint.json"))],
    "real": [Rule("real.network", "value", "runtime_profiles.real.network", ("true",), when="experiment.mode", is_=("real",)), Rule("real.limit", "range", "budgets.spending_limit", low=0, open_=True, when="experiment.mode", is_=("real",))],
}
ALL = [r for group in RULES.values() for r in group]
