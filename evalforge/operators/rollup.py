"""Transactional roll-up of a whole experiment: every ledger of every run, checked, merged and published at once.

Runs are partitions, ``root``/method_id=../search_seed=../<ledger> (JSON lines).  Each run
has a ``state`` that says whether it is complete and how many rows each of its ledgers
has.  Runs that aren't complete, or of another experiment, are left out and named; a run
that says it is complete and isn't what it says stops the roll-up.  Tables are written
under a new version, and one marker, written last, makes them the current ones; whatever
stops a roll-up before that leaves the old one as it was.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ledger

RUN = ["method_id", "search_seed"]
STATE = "experiment_id string, complete boolean, rows map<string, bigint>, proposed long, screened long, promoted long, rejected long, budget_limit long, budget_complete boolean, selected array<string>, cache_keys array<string>"
#: Problems that stop a roll-up; the others only leave a run out.
FATAL = ("repeated_state", "malformed_state", "missing_ledger", "row_count", "damaged_line", "no_key", "conflict", "unknown_candidate", "unknown_parent")


@dataclass(frozen=True)
class Ledger:
    """A ledger's columns, the key that is unique over all runs, and what rows with one key must agree on."""

    name: str
    schema: str
    key: tuple[str, ...]
    payload: tuple[str, ...]
    required: bool = True
    #: Column that names a candidate, if rows are about one.
    candidate: str | None = None
    #: Column that lists parents, if rows have any.
    parents: str | None = None


OUTCOMES = Ledger("outcomes", "candidate_id string, target_id string, task_id string, seed long, is_base boolean, correct boolean, input_tokens long, output_tokens long", ("candidate_id", "target_id", "task_id", "seed"), ("is_base", "correct", "input_tokens", "output_tokens"), candidate="candidate_id")
CANDIDATES = Ledger("candidates", "candidate_id string, content_hash string, parents array<string>", ("candidate_id",), ("content_hash", "parents"), parents="parents")
PROPOSALS = Ledger("proposals", "event_id string, accepted boolean, cache_hit boolean, input_tokens long, output_tokens long", ("event_id",), ("accepted", "cache_hit", "input_tokens", "output_tokens"), required=False)
FAILURES = Ledger("failures", "event_id string, request_fingerprint string, attempt_number long, will_retry boolean", ("event_id",), ("request_fingerprint", "attempt_number", "will_retry"))
ARCHIVES = Ledger("archive", "run_key string, candidate_id string, vector array<double>", ("run_key", "candidate_id"), ("vector",), required=False, candidate="candidate_id")
LEDGERS = (OUTCOMES, CANDIDATES, PROPOSALS, FAILURES, ARCHIVES)


@dataclass
class Experiment:
    """What is found of an experiment: states, the runs that it should have, and each ledger's rows with their run."""

    experiment_id: str
    states: DataFrame
    expected: DataFrame
    tables: Mapping[str, DataFrame]
    ledgers: tuple[Ledger, ...] = LEDGERS
    damaged: DataFrame | None = field(default=None)

    def taken(self) -> DataFrame:
        """The states that count: complete, and of this experiment."""
        return self.states.where((F.col("experiment_id") == self.experiment_id) & F.col("complete"))

    def rows(self, name: str) -> DataFrame:
        """A ledger's rows of the runs that count."""
        return self.tables[name].join(self.taken().select(*RUN).distinct(), RUN, "left_semi")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A ledger's rows of all runs; a line that isn't an object of the schema has its text in ``damaged_``."""
    text = F.col("value")
    try:
        lines = spark.read.option("basePath", root).text(f"{root}/method_id=*/search_seed=*/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"method_id string, search_seed long, {schema}, damaged_ string")
        raise
    row = F.from_json(text, f"{schema}, damaged_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged_"})
    rows = lines.where(F.btrim(text) != "").select(F.col("method_id").cast("string"), F.col("search_seed").cast("long"), row.alias("row"))
    return rows.select(*RUN, "row.*")


def discover(spark: SparkSession, root: str, expected: DataFrame, experiment_id: str, ledgers: tuple[Ledger, ...] = LEDGERS) -> Experiment:
    """Reads all runs' states and ledgers under ``root``; lines that can't be read are kept as damaged."""
    found = {x.name: _read(spark, root, x.name, x.schema) for x in ledgers}
    states = _read(spark, root, "state", STATE)
    bad = [d.where("damaged_ is not null").select(*RUN, F.lit(n).alias("detail")) for n, d in [*found.items(), ("state", states)]]
    whole = {n: d.where("damaged_ is null").drop("damaged_") for n, d in found.items()}
    return Experiment(experiment_id, states.where("damaged_ is null").drop("damaged_"), expected, whole, ledgers, reduce(DataFrame.unionByName, bad))


def _rows(x: Experiment, part: Ledger) -> list[DataFrame]:
    """Problems of one ledger of the runs that count."""
    have, name = x.rows(part.name), F.lit(part.name)
    counts = have.groupBy(*RUN).agg(F.count("*").alias("actual"))
    said = x.taken().select(*RUN, F.element_at("rows", part.name).alias("said")).join(counts, RUN, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    missing = said.where("said is null" if part.required else "said is null and actual > 0").select(*RUN, F.lit("missing_ledger").alias("problem"), name.alias("detail"))
    differ = said.where("said <> actual").select(*RUN, F.lit("row_count").alias("problem"), F.concat(name, F.lit(":"), F.col("said").cast("string"), F.lit("/"), F.col("actual").cast("string")).alias("detail"))
    nameless = have.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in part.key])).select(*RUN, F.lit("no_key").alias("problem"), name.alias("detail")).distinct()
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in part.key])
    split = have.dropna(subset=list(part.key)).groupBy(*part.key).agg(F.count_distinct(F.struct(*[F.to_json(F.struct(p)) for p in part.payload])).alias("n"), F.min(F.struct(*RUN)).alias("first")).where("n > 1")
    conflict = split.select("first.*", F.lit("conflict").alias("problem"), F.concat(name, F.lit(":"), key).alias("detail"))
    out = [missing, differ, nameless, conflict]
    if "candidates" in x.tables:
        known = x.rows("candidates").select("candidate_id").distinct()
        if part.candidate:
            own = have.where("not is_base") if "is_base" in have.columns else have
            stray = own.select(*RUN, F.col(part.candidate).alias("candidate_id")).distinct().join(known, "candidate_id", "left_anti")
            out.append(stray.where("candidate_id is not null").select(*RUN, F.lit("unknown_candidate").alias("problem"), F.concat(name, F.lit(":"), F.col("candidate_id")).alias("detail")))
        if part.parents:
            stray = have.select(*RUN, F.explode(part.parents).alias("candidate_id")).distinct().join(known, "candidate_id", "left_anti")
            out.append(stray.select(*RUN, F.lit("unknown_parent").alias("problem"), F.concat(name, F.lit(":"), F.col("candidate_id")).alias("detail")))
    return out


def problems(x: Experiment) -> DataFrame:
    """(method_id, search_seed, problem, detail, fatal): whatever keeps a run out, or stops the roll-up."""
    s, e = x.states, x.expected.select(*RUN).distinct()
    say = lambda df, problem, detail=F.lit(None).cast("string"): df.select(*RUN, F.lit(problem).alias("problem"), detail.alias("detail"))
    malformed = F.col("experiment_id").isNull() | F.col("complete").isNull() | F.col("rows").isNull()
    found = [
        say(e.join(s, RUN, "left_anti"), "missing_run"),
        say(s.select(*RUN).distinct().join(e, RUN, "left_anti"), "unexpected_run"),
        say(s.groupBy(*RUN).agg(F.count("*").alias("n")).where("n > 1"), "repeated_state", F.col("n").cast("string")),
        say(s.where(malformed), "malformed_state"),
        say(s.where("not complete"), "incomplete_run"),
        say(s.where(F.col("experiment_id") != x.experiment_id), "other_experiment", F.col("experiment_id")),
        say(s.where((F.col("screened") > F.col("proposed")) | (F.col("promoted") > F.col("screened"))), "malformed_state", F.lit("counts")),
    ]
    for part in x.ledgers:
        found += _rows(x, part)
    if x.damaged is not None:
        found.append(say(x.damaged.groupBy(*RUN, "detail").count(), "damaged_line", F.concat(F.col("detail"), F.lit(":"), F.col("count").cast("string"))))
    return reduce(DataFrame.unionByName, found).withColumn("fatal", F.col("problem").isin(*FATAL))


def merged(x: Experiment, part: Ledger) -> DataFrame:
    """A ledger's rows of all runs that count, each key once, with the runs that have it."""
    by = F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "method_id", F.col("search_seed").cast("string")))), ",")
    return x.rows(part.name).groupBy(*part.key).agg(F.min(F.struct(*part.payload)).alias("p"), by.alias("runs")).select(*part.key, "p.*", "runs")


def matrix(x: Experiment) -> DataFrame:
    """(method_id, search_seed, expected, complete, budget_complete) of all runs that are expected or found."""
    e = x.expected.select(*RUN).distinct().withColumn("expected", F.lit(True))
    t = x.taken().groupBy(*RUN).agg(F.bool_and("budget_complete").alias("budget_complete")).withColumn("complete", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return e.join(t, RUN, "full").select(*RUN, no("expected"), no("complete"), no("budget_complete"))


def totals(x: Experiment) -> DataFrame:
    """One row: runs, logical rows and tokens of candidates, proposals with the calls and tokens that were paid for, failures, distinct cache keys, and whether matrix and budgets are complete."""
    o = merged(x, OUTCOMES).where("not is_base").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))
    p = merged(x, PROPOSALS).agg(F.count("*").alias("proposals"), F.count_if(~F.col("cache_hit")).alias("calls"), F.coalesce(F.sum(F.when(~F.col("cache_hit"), F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias("proposal_tokens"))
    f = merged(x, FAILURES).agg(F.count("*").alias("failures"))
    k = x.taken().select(F.explode("cache_keys").alias("k")).agg(F.count_distinct("k").alias("cache_keys"))
    m = matrix(x).agg(F.count_if("complete").alias("runs"), F.coalesce(F.bool_and(F.col("expected") & F.col("complete")), F.lit(False)).alias("matrix_complete"), F.coalesce(F.bool_and("budget_complete"), F.lit(False)).alias("budget_complete"))
    return reduce(DataFrame.join, [m, o, p, f, k])  # one row each


class RollUpError(ledger.LedgerError):
    """A run isn't what it says."""


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keep: bool = False) -> int:
    """Writes ``tables`` as the next version under ``root``/rolled_up and commits them by one marker; ``keep`` takes the current version's other tables over by reference.

    Until the marker is there, ``current`` sees the version before.
    """
    base = f"{root}/rolled_up"
    before = _markers(spark, base)
    number = max([*before, *_numbers(spark, base)], default=0) + 1
    paths = dict(before[max(before)]["tables"]) if keep and before else {}
    rows = dict(before[max(before)]["rows"]) if keep and before else {}
    for name, t in tables.items():
        paths[name] = f"version={number}/{name}"
        t.write.mode("errorifexists").parquet(f"{base}/{paths[name]}")
        rows[name] = spark.read.parquet(f"{base}/{paths[name]}").count()
    ledger.write_json(spark, {"version": number, "tables": paths, "rows": rows}, f"{base}/committed/{number}.json")
    return number


def _listed(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _numbers(spark: SparkSession, base: str) -> list[int]:
    return [int(n.partition("=")[2]) for n in _listed(spark, base) if n.startswith("version=")]


def _markers(spark: SparkSession, base: str) -> dict[int, dict]:
    """Committed versions; one small file each."""
    names = [n for n in _listed(spark, f"{base}/committed") if n.removesuffix(".json").isdigit()]
    return {int(n.removesuffix(".json")): json.loads(spark.read.text(f"{base}/committed/{n}", wholetext=True).first()[0]) for n in names}


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last version that was committed; none without one.  A table that lacks rows is an error."""
    found = _markers(spark, f"{root}/rolled_up")
    if not found:
        return {}
    last = found[max(found)]
    out = {name: spark.read.parquet(f"{root}/rolled_up/{path}") for name, path in last["tables"].items()}
    short = {n: last["rows"][n] for n, t in out.items() if t.count() != last["rows"][n]}
    if short:
        raise RollUpError(f"tables differ from their marker: {short}")
    return out


def roll_up(spark: SparkSession, root: str, expected: DataFrame, experiment_id: str, ledgers: tuple[Ledger, ...] = LEDGERS) -> int:
    """Discovers, checks, merges and publishes; returns the version.  Fatal problems are an error that names them, and publish nothing."""
    x = discover(spark, root, expected, experiment_id, ledgers)
    found = problems(x).persist()
    try:
        bad = found.where("fatal").orderBy(*RUN, "problem", "detail").limit(20).collect()
        if bad:
            raise RollUpError(f"runs aren't what they say: {[tuple(r)[:4] for r in bad]}")
        tables = {part.name: merged(x, part) for part in ledgers}
        files = [ledger.file_digests(spark, f"{root}/method_id=*/search_seed=*/{n}") for n in [*(p.name for p in ledgers if x.tables[p.name].inputFiles()), "state"]]
        return publish(spark, root, tables | {"matrix": matrix(x), "totals": totals(x), "left_out": found.where("not fatal"), "states": x.taken(), "index": reduce(DataFrame.unionByName, files)})
    finally:
        found.unpersist()


def add_final(spark: SparkSession, root: str, outcomes: DataFrame, tables: Mapping[str, DataFrame]) -> int:
    """The last stage in the same roll-up: its outcomes join the merged ledger, its tables and a total of both come beside; returns the version.

    Outcomes whose key is there already must agree.  Without a roll-up to add to it is an error.
    """
    have = current(spark, root)
    if "outcomes" not in have or "totals" not in have:
        raise RollUpError("there is no roll-up to add to")
    key, payload = list(OUTCOMES.key), list(OUTCOMES.payload)
    new = outcomes.select(*key, *payload, F.lit("final").alias("runs"))
    both = have["outcomes"].select(*key, *payload, F.explode(F.split("runs", ",")).alias("runs")).unionByName(new)
    per = both.groupBy(*key).agg(F.min(F.struct(*payload)).alias("p"), F.max(F.struct(*payload)).alias("q"), F.array_join(F.array_sort(F.collect_set("runs")), ",").alias("runs"))
    ledger.require_none(per.where("p <> q").select(*key), "the final outcomes disagree on")
    logical = outcomes.where("not is_base").agg(F.count("*").alias("final_rows"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("final_tokens"))
    total = have["totals"].drop("final_rows", "final_tokens", "total_rows", "total_tokens").join(logical).withColumns({"total_rows": F.col("rows") + F.col("final_rows"), "total_tokens": F.col("tokens") + F.col("final_tokens")})  # one row each
    return publish(spark, root, {**tables, "outcomes": per.select(*key, "p.*", "runs"), "totals": total}, keep=True)
