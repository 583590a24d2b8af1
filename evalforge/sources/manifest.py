"""Experiment configurations: validation, extractors, target tables, identities, verifiers and plugins."""

from __future__ import annotations

import copy
import hashlib
import math
import platform
import re
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..functions.durable import cut
from ..operators import checks, verify
from ..operators.objectives import OBJECTIVES, Constraints


class ConfigError(ValueError):
    """A configuration breaks its rules; the message has all of them."""


REQUIRED = ("experiment", "models", "harnesses", "domains", "providers", "targets", "objectives", "constraints", "budget", "statistics")


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def problems(config: Mapping[str, Any]) -> list[str]:
    """Everything that is wrong with a configuration: missing parts, broken references, ranges, and budget arithmetic."""
    found = [f"{k} is missing" for k in REQUIRED if not isinstance(config.get(k), Mapping)]
    part = lambda k: config[k] if isinstance(config.get(k), Mapping) else {}
    if not str(part("experiment").get("id", "")).strip():
        found.append("experiment.id is empty")
    seeds = part("experiment").get("search_seeds", [])
    if not isinstance(seeds, list) or len(seeds) < 3 or len(set(map(str, seeds))) != len(seeds):
        found.append("experiment.search_seeds must be three different seeds or more")
    for name, m in part("models").items():
        if m.get("provider") not in part("providers"):
            found.append(f"models.{name}.provider isn't declared")
    for name, t in part("targets").items():
        for key, where in (("model", "models"), ("harness", "harnesses"), ("domain", "domains")):
            if t.get(key) not in part(where):
                found.append(f"targets.{name}.{key} isn't declared")
        if t.get("phase", "search") not in ("search", "final_only"):
            found.append(f"targets.{name}.phase is unknown")
    sets = {k: part("objectives").get(k, {}).get("target_ids", []) for k in ("accuracy", "transfer")}
    for k, ids in sets.items():
        found += [f"objectives.{k} names the unknown target {i}" for i in ids if i not in part("targets")]
        if not ids:
            found.append(f"objectives.{k} has no targets")
    found += [f"target {i} is both of accuracy and of transfer" for i in sorted(set(sets["accuracy"]) & set(sets["transfer"]))]
    for name, d in part("domains").items():
        for other in d.get("disjoint_from", []):
            if other not in part("domains"):
                found.append(f"domains.{name}.disjoint_from names the unknown domain {other}")
    b = part("budget")
    sizes = [b.get(k) for k in ("candidates", "tasks", "seeds", "targets", "executions")]
    if not all(isinstance(x, int) and not isinstance(x, bool) and x > 0 for x in sizes):
        found.append("budget needs positive candidates, tasks, seeds, targets and executions")
    elif math.prod(sizes[:4]) > sizes[4]:
        found.append(f"budget.executions {sizes[4]} is less than the {math.prod(sizes[:4])} that the matrix takes")
    for check in (constraints_of, ranges_of, reference_of):
        try:
            check(config)
        except (ConfigError, KeyError, TypeError) as e:
            found.append(f"{check.__name__.removesuffix('_of')}: {e}")
    return found


def validated(config: Mapping[str, Any]) -> Mapping[str, Any]:
    """The configuration itself; all its problems are one error."""
    if found := problems(config):
        raise ConfigError("; ".join(found))
    return config


def constraints_of(config: Mapping[str, Any]) -> Constraints:
    """Paired floor and token budget."""
    c = config["constraints"]
    if not _number(c["epsilon"]) or not 0 <= c["epsilon"] <= 1 or not _number(c["token_budget"]) or c["token_budget"] <= 0:
        raise ConfigError("epsilon must lie in [0, 1], token_budget above 0")
    paired = Constraints.from_paired(float(c["epsilon"]), float(c["token_budget"]))
    return paired if c.get("enabled", True) else Constraints(0.0, paired.token_budget, None, False)


def ranges_of(config: Mapping[str, Any]) -> dict[str, tuple[float, float]]:
    """Frozen [low, high] of each objective, with a width."""
    raw = config["statistics"]["ranges"]
    if set(raw) != set(OBJECTIVES):
        raise ConfigError(f"ranges must be those of {OBJECTIVES}")
    for k, r in raw.items():
        if len(r) != 2 or not all(map(_number, r)) or r[1] <= r[0]:
            raise ConfigError(f"the range of {k} needs two finite numbers and a width")
    return {k: (float(raw[k][0]), float(raw[k][1])) for k in OBJECTIVES}


def reference_of(config: Mapping[str, Any]) -> list[float]:
    """Reference point of the volume, in normalised coordinates."""
    raw = config["statistics"]["reference"]
    if len(raw) != len(OBJECTIVES) or not all(map(_number, raw)):
        raise ConfigError(f"the reference needs {len(OBJECTIVES)} finite numbers")
    return [float(x) for x in raw]


def active_objectives(config: Mapping[str, Any]) -> tuple[str, ...]:
    """The objectives that aren't switched off, in canonical order."""
    off = config.get("ablation", {}).get("objectives_off", [])
    if set(off) - set(OBJECTIVES) or len(set(off)) == len(OBJECTIVES):
        raise ConfigError("unknown objectives are off, or all are")
    return tuple(o for o in OBJECTIVES if o not in off)


def execution_seeds(config: Mapping[str, Any]) -> list[int]:
    """Sorted seeds, each once."""
    seeds = config["experiment"].get("execution_seeds", [0])
    if any(isinstance(s, bool) or not isinstance(s, int) for s in seeds) or len(set(seeds)) != len(seeds):
        raise ConfigError("execution seeds must be different integers")
    return sorted(seeds)


def ablated(config: Mapping[str, Any], overrides: Mapping[str, Any]) -> dict:
    """A copy with dotted paths set anew; the paths must exist."""
    out = copy.deepcopy(dict(config))
    for dotted, value in overrides.items():
        *parents, last = dotted.split(".")
        at = out
        for p in parents:
            at = at.get(p) if isinstance(at, dict) else None
        if not isinstance(at, dict) or last not in at:
            raise ConfigError(f"nothing at {dotted}")
        at[last] = value
    return out


def targets(spark: SparkSession, config: Mapping[str, Any], phase: str | None = None) -> DataFrame:
    """Target table: target_id, phase, provider_id, model_id, harness_id, domain_id, split_id, transfer_group, objective_role.

    The role is that of the objective that lists the target, else "final" for targets of the last phase, else "diagnostic".
    """
    rows = [(i, t.get("phase", "search"), t.get("model"), t.get("harness"), t.get("domain"), t.get("split"), t.get("transfer_group")) for i, t in config["targets"].items()]
    t = spark.createDataFrame(rows, "target_id string, phase string, model string, harness_id string, domain_id string, split_id string, transfer_group string")
    models = spark.createDataFrame([(k, m.get("model_id", k), m.get("provider")) for k, m in config["models"].items()], "model string, model_id string, provider_id string")
    for column, table in (("model", "models"), ("harness_id", "harnesses"), ("domain_id", "domains")):
        known = spark.createDataFrame([(k,) for k in config[table]], "k string")
        if bad := [r[column] for r in checks.orphans(t, column, known, "k").collect()]:
            raise ConfigError(f"targets name {column} {sorted(bad)}, not declared")
    return roles(t if phase is None else t.where(F.col("phase") == phase), config["objectives"]["accuracy"]["target_ids"], config["objectives"]["transfer"]["target_ids"]).join(F.broadcast(models), "model").drop("model")


def roles(t: DataFrame, accuracy: list[str], transfer: list[str]) -> DataFrame:
    """Adds objective_role by membership, then by phase."""
    i = F.col("target_id")
    return t.withColumn("objective_role", F.when(i.isin(*accuracy), "id").when(i.isin(*transfer), "transfer").when(F.col("phase") == "final_only", "final").otherwise("diagnostic"))


def final_targets(t: DataFrame) -> DataFrame:
    """Targets of the last phase alone."""
    return t.where("phase = 'final_only'")


def of_split(tasks: DataFrame, split: str) -> DataFrame:
    """Tasks of one split."""
    return tasks.where(F.col("split_id") == split)


def experiment_id(config: Mapping[str, Any], implementation: str = "") -> str:
    """Declared id and 16 digits of the digest of the resolved configuration and of the code's digest."""
    return f"{config['experiment']['id']}-{digest({'resolved_manifest': thaw(freeze(config)), 'implementation_digest': implementation})[:16]}"


def run_metadata(spark: SparkSession, config: Mapping[str, Any], stage: str, complete: bool, started: str, environment: Mapping[str, str], allowed: tuple[str, ...] = ("PYTHONHASHSEED",)) -> DataFrame:
    """One row about a run: who, which stage, on what; of the environment only the allowed names."""
    kept = {k: environment[k] for k in allowed if k in environment}
    row = (experiment_id(config), config["experiment"]["id"], stage, complete, started, platform.python_version(), platform.platform(), spark.version, sys.argv[:1], kept)
    return spark.createDataFrame([row], "experiment_id string, declared_id string, stage string, complete boolean, started_at string, python string, system string, spark string, command array<string>, environment map<string,string>")


def freeze(x: Any) -> Any:
    """A JSON value that can't be changed; keys must be text and numbers finite."""
    if isinstance(x, Mapping):
        if not all(isinstance(k, str) for k in x):
            raise ConfigError("keys must be text")
        return MappingProxyType({k: freeze(v) for k, v in x.items()})
    if isinstance(x, (list, tuple)):
        return tuple(map(freeze, x))
    if x is None or isinstance(x, (str, bool)) or _number(x):
        return x
    raise ConfigError(f"{x!r} is no JSON value")


def thaw(x: Any) -> Any:
    """A plain copy of a frozen value."""
    if isinstance(x, Mapping):
        return {k: thaw(v) for k, v in x.items()}
    return [thaw(v) for v in x] if isinstance(x, tuple) else x


def keyed(df: DataFrame, columns: list[str], name: str = "cache_key") -> DataFrame:
    """Adds the digest of a JSON object of these columns, sorted by name, nulls kept.

    For columns of text, integers and booleans this is the canonical JSON, so any engine gives the same digest.
    """
    return df.withColumn(name, F.sha2(json_object(columns), 256))


def json_object(columns: list[str]) -> Column:
    """JSON text of columns sorted by name, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


#: What tells one execution from another; the candidate's name and whether it is the base don't.
REQUEST = ["experiment_id", "content_hash", "task_id", "seed", "target_id", "model_id"]
#: What tells one retried invocation from another; payloads take part by their digests.
INVOCATION = ["experiment_id", "candidate_id", "content_hash", "target_id", "task_id", "seed", "payload_sha256"]


def request_keys(df: DataFrame) -> DataFrame:
    """Adds cache_key."""
    return keyed(df, REQUEST)


def invocations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds request_fingerprint, in which the payload is but a digest."""
    return keyed(df.withColumn("payload_sha256", F.sha2(payload, 256)), INVOCATION, "request_fingerprint").drop("payload_sha256")


def tree_digest(files: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group.., sha256): one digest of all (path, sha256) in the order of their paths."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\0"))), "")
    return files.groupBy(*(group or [])).agg(F.sha2(text, 256).alias("sha256"))


def content_sha256(files: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group.., sha256): the digest of whole trees: each path, a zero byte, its bytes and a zero byte, by path.

    ``files``: (group.., path, content binary).  A tree is one row, so it must fit in memory; ``tree_digest`` needs no more
    than the files' own digests.
    """
    zero = F.lit(b"\0")
    part = lambda x: F.concat(F.encode(x["path"], "UTF-8"), zero, x["content"], zero)
    tree = F.array_sort(F.collect_list(F.struct("path", "content")))
    return files.groupBy(*(group or [])).agg(F.sha2(F.aggregate(tree, F.lit(b""), lambda a, x: F.concat(a, part(x))), 256).alias("sha256"))


def base_version(content_hash: str, label: str = "base") -> str:
    """Version id of a base artifact."""
    return f"{label}-{digest({'parent': None, 'content_hash': content_hash})[:16]}"


def rebound(patches: DataFrame, version: str) -> DataFrame:
    """Patches with another parent."""
    return patches.withColumn("parent_version_id", F.lit(version))


#: Digest of the empty artifact, which the control without a skill has (fixed value).
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def as_candidates(versions: DataFrame, with_control: bool = True) -> DataFrame:
    """(candidate_id, content_hash, injection_mode) of versions, and of the control without any skill."""
    v = versions.select(F.col("version_id").alias("candidate_id"), "content_hash", F.lit("replace").alias("injection_mode"))
    if not with_control:
        return v
    return v.unionByName(versions.sparkSession.createDataFrame([("no_skill", EMPTY_SHA256, "none")], v.schema))


_RULES: dict[str, tuple[set[str], set[str]]] = {
    "exact_match": ({"expected"}, {"strip", "case_sensitive"}),
    "json_boolean": (set(), {"expected", "field_path"}),
    "json_field": ({"expected", "field_path"}, set()),
    "nonempty": (set(), {"strip"}),
    "contains": ({"expected"}, {"case_sensitive"}),
    "regex_fullmatch": ({"pattern"}, {"case_sensitive"}),
    "numeric_tolerance": ({"expected", "absolute_tolerance"}, set()),
}


@dataclass(frozen=True)
class Verifier:
    """A parsed verifier: its rule and options with defaults filled in."""

    rule: str
    options: Mapping[str, Any]

    @classmethod
    def parse(cls, spec: Mapping[str, Any]) -> Verifier:
        """Checks a specification: the kind (a built-in names its rule), required and allowed keys, and types."""
        kind = spec.get("kind")
        rule = spec.get("rule") if kind == "builtin" else kind
        if rule not in _RULES or (kind == "builtin") != (rule in ("nonempty", "contains", "regex_fullmatch", "numeric_tolerance")):
            raise ConfigError(f"no verifier {kind!r} {spec.get('rule', '')!r}")
        needed, allowed = _RULES[rule]
        given = set(spec) - {"kind", "rule"}
        if needed - given or given - needed - allowed:
            raise ConfigError(f"{rule} lacks {sorted(needed - given)} or has {sorted(given - needed - allowed)} beyond its keys")
        o = {k: v for k, v in spec.items() if k not in ("kind", "rule")}
        if "strip" in allowed:
            o.setdefault("strip", True)
        if "case_sensitive" in allowed:
            o.setdefault("case_sensitive", True)
        if rule == "json_boolean":
            o.setdefault("expected", True)
            o.setdefault("field_path", [])
        types = {"strip": bool, "case_sensitive": bool, "pattern": str}
        wrong = [k for k, kind_ in types.items() if k in o and not isinstance(o[k], kind_)]
        if rule == "json_boolean" and not isinstance(o["expected"], bool) or rule == "contains" and not isinstance(o["expected"], str):
            wrong.append("expected")
        if rule == "numeric_tolerance" and not (_number(o["expected"]) and _number(o["absolute_tolerance"]) and o["absolute_tolerance"] >= 0):
            wrong.append("absolute_tolerance")
        if "field_path" in o and not (isinstance(o["field_path"], list) and all(isinstance(p, (str, int)) and not isinstance(p, bool) for p in o["field_path"])):
            wrong.append("field_path")
        if wrong:
            raise ConfigError(f"{rule} has wrong {wrong}")
        if rule == "regex_fullmatch":
            re.compile(o["pattern"])
        freeze(o)
        return cls(rule, o)

    def digest(self) -> str:
        """Digest of rule and options."""
        return digest({"rule": self.rule, "options": dict(self.options)})

    def column(self, x: Column) -> Column:
        """Whether a response passes."""
        o, fold = self.options, not self.options.get("case_sensitive", True)
        if self.rule == "exact_match" and isinstance(o["expected"], str):
            return verify.exact(x, o["expected"], o["strip"], fold)
        if self.rule == "exact_match":
            return verify.exact_json_field([], o["expected"])(x)
        if self.rule == "json_boolean":
            path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in o["field_path"])
            return verify.json_boolean(x, path, o["expected"])
        if self.rule == "json_field":
            return verify.exact_json_field(o["field_path"], o["expected"])(x)
        if self.rule == "nonempty":
            return verify.nonempty(x, o["strip"])
        if self.rule == "contains":
            return verify.contains(x, o["expected"], fold)
        if self.rule == "regex_fullmatch":
            return verify.full_match(x, o["pattern"], fold)
        return verify.numeric(x, float(o["expected"]), float(o["absolute_tolerance"]))


def scored(responses: DataFrame, specs: Mapping[str, Verifier], response: str = "raw_response") -> DataFrame:
    """Responses with ``correct`` as their task's verifier says, and what was reported as ``reported_correct``.

    ``specs``: by verifier_id, a column of ``responses``.  Each verifier looks at its own rows alone; a response without
    a known verifier is wrong.
    """
    verdict = F.lit(False)
    for name, v in specs.items():
        verdict = F.when(F.col("verifier_id") == name, v.column(F.col(response))).otherwise(verdict)
    return responses.withColumn("reported_correct", F.col("correct")).withColumn("correct", F.coalesce(verdict, F.lit(False)))


class Harness(Protocol):
    """Runs requests and returns their outcomes."""

    def evaluate(self, requests: DataFrame) -> DataFrame: ...


class EvaluationCache(Protocol):
    """Holds outcomes by request key."""

    def get(self, keys: DataFrame) -> DataFrame: ...

    def put(self, rows: DataFrame) -> int: ...


class DomainAdapter(Protocol):
    """Gives a domain's tasks."""

    def tasks(self, split: str) -> DataFrame: ...


@dataclass
class Runtime:
    """Domain and harness factories that were registered by hand; each is pinned by the digest of its code."""

    allowed: tuple[str, ...]
    factories: dict[str, tuple[Callable[..., Any], str]] = field(default_factory=dict)

    def register(self, name: str, factory: Callable[..., Any], sha256: str | None = None) -> None:
        """Adds a factory whose module is allowed and whose code has the given digest."""
        if name in self.factories:
            raise ConfigError(f"{name} is registered already")
        module = getattr(factory, "__module__", "")
        if not any(module == a or module.startswith(a + ".") for a in self.allowed):
            raise ConfigError(f"{module} isn't allowed")
        got = hashlib.sha256(factory.__code__.co_code).hexdigest()
        if sha256 is not None and sha256 != got:
            raise ConfigError(f"the code of {name} isn't what was pinned")
        self.factories[name] = (factory, got)

    def build(self, name: str, **options: Any) -> Any:
        """What the factory of this name makes."""
        if name not in self.factories:
            raise ConfigError(f"no factory {name}")
        return self.factories[name][0](**options)


@dataclass
class Ablations:
    """Named overrides of a configuration."""

    overrides: dict[str, Mapping[str, Any]] = field(default_factory=dict)

    def register(self, name: str, overrides: Mapping[str, Any]) -> None:
        """Adds an ablation."""
        if name in self.overrides or not overrides:
            raise ConfigError(f"{name} is registered already, or empty")
        self.overrides[name] = overrides

    def apply(self, name: str, config: Mapping[str, Any]) -> dict:
        """The configuration under an ablation."""
        if name not in self.overrides:
            raise ConfigError(f"no ablation {name}")
        return ablated(config, self.overrides[name])


def generated(requests: DataFrame, cache, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cache_key, request, response, cache_hit) of each different request: stored responses, and new ones, which are stored first.

    ``requests``: (request); ``cache``: a ``GenerationCache``; ``generate``: (request) -> (request, response), which sees
    only what the cache lacks.
    """
    keyed_ = requests.select("request").distinct().withColumn("cache_key", F.sha2("request", 256))
    known = cut(cache.get(keyed_).select("cache_key"))
    cache.store(generate(keyed_.join(known, "cache_key", "left_anti").select("request")))
    hit = known.withColumn("hit_", F.lit(True))
    return cache.get(keyed_).join(hit, "cache_key", "left").select("cache_key", "request", "response", F.coalesce("hit_", F.lit(False)).alias("cache_hit"))


def payloads(requests: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``payload``: the JSON object that would be sent for a request."""
    return requests.withColumn("payload", json_object(columns))


def mock_proposals(requests: DataFrame, operations: tuple[str, ...] = ("add", "rewrite")) -> DataFrame:
    """(request_id, operation, content): made-up patches that the request's digest decides."""
    h = F.sha2(F.concat_ws("|", "parent_id", "direction", F.col("turn").cast("string")), 256)
    pick = F.conv(F.substring(h, 1, 4), 16, 10).cast("long") % len(operations)
    return requests.select(F.substring(h, 1, 16).alias("request_id"), F.element_at(F.array(*map(F.lit, operations)), (pick + 1).cast("int")).alias("operation"), F.concat(F.lit("For "), "direction", F.lit(": note "), F.substring(h, 5, 8)).alias("content"))
