"""Roll-ups of finished runs and the final analysis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ledger
from . import accounting, bootstrap, checks, dedup, inference, objectives, pareto, reports

#: Replicates at most in a quick run (fixed value).
QUICK_REPLICATES = 200
INTERVALS = ("accuracy", "delta", "regression", "token_cost")


def observation_problems(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(candidate_id, problem, detail): repeated keys, a split without rows, and transfer groups that are missing or extra."""
    key = ["candidate_id", "target_id", "task_id", "seed"]
    again = checks.duplicates(pairs, key).select("candidate_id", F.lit("repeated_key").alias("problem"), F.concat_ws("/", *key[1:]).alias("detail"))
    per = pairs.groupBy("candidate_id").agg(F.collect_set("split").alias("splits"), F.collect_set(F.when(F.col("split") == "transfer", F.col("grp"))).alias("groups"))
    wanted = F.array(*map(F.lit, groups))
    each = lambda problem, a, b: F.transform(F.array_except(a, b), lambda x: F.struct(F.lit(problem).alias("problem"), x.alias("detail")))
    found = F.concat(each("missing_split", F.array(F.lit("id"), F.lit("transfer")), F.col("splits")), each("missing_group", wanted, F.col("groups")), each("extra_group", F.col("groups"), wanted))
    return again.unionByName(per.select("candidate_id", F.inline(found)))


def cluster_intervals(pairs: DataFrame, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """candidate_id, target_id, task_clusters, task_seed_rows, and of each of INTERVALS the point and its two-sided bounds.

    Tasks are the clusters.  The seed of a candidate's target is ``seed`` xor the first 16 hex digits of the SHA-256 of
    both names, so that no other row changes its draws.
    """
    points = objectives.target_statistics(pairs)
    sizes = pairs.groupBy("candidate_id", "target_id").agg(F.count_distinct("task_id").alias("task_clusters"), F.count("*").alias("task_seed_rows"))
    s = bootstrap.cluster_samples(pairs, replicates, seed, own_seeds=True)
    a = (1 - level) / 2
    bounds = s.groupBy("candidate_id", "target_id").agg(*[F.percentile(m, p).alias(f"{m}_{n}") for m in INTERVALS for n, p in (("low", a), ("high", 1 - a))])
    return points.join(sizes, ["candidate_id", "target_id"]).join(bounds, ["candidate_id", "target_id"])


def summaries(pairs: DataFrame, replicates: int, seed: int, level: float = 0.95, quick: bool = False, token_bound: float | None = None) -> DataFrame:
    """Estimates of all candidates in one job; a quick run draws QUICK_REPLICATES at most."""
    n = min(replicates, QUICK_REPLICATES) if quick else replicates
    return bootstrap.estimates(objectives.objectives(pairs), bootstrap.samples(pairs, n, seed), objectives.block_counts(pairs), level, token_bound=token_bound)


def matrix_size(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row, ``cells``: compatible pairs of targets and blocks, counted by what decides without making the pairs."""
    t = targets.groupBy("domain_id", "task_group", "split_id", "objective_role").agg(F.count("*").alias("nt")).alias("target")
    b = blocks.groupBy("domain_id", "group_id", "split_id", "objective_role").agg(F.count("*").alias("nb")).alias("block")
    return t.join(b, objectives.compatible()).agg(F.coalesce(F.sum(F.col("nt") * F.col("nb")), F.lit(0)).alias("cells"))


def proposal_accounting(proposals: DataFrame, run: list[str]) -> DataFrame:
    """By run: proposals, accepted, cache_hits, provider_calls, and tokens of calls that weren't hits.

    ``proposals``: (run.., accepted, cache_hit, input_tokens, output_tokens).
    """
    paid = lambda c: F.sum(F.when(F.col("cache_hit"), 0).otherwise(F.col(c))).alias(c)
    return proposals.groupBy(*run).agg(F.count("*").alias("proposals"), F.count_if("accepted").alias("accepted"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("provider_calls"), paid("input_tokens"), paid("output_tokens"))


def over_budget(spent: DataFrame, limit: int, run: list[str]) -> DataFrame:
    """Runs whose logical rows are more than the limit: run.., rows, limit."""
    return spent.groupBy(*run).agg(F.count("*").alias("rows")).where(F.col("rows") > limit).withColumn("limit", F.lit(limit))


def split_drift(tasks: DataFrame) -> DataFrame:
    """(task_id, splits) of tasks that lie in several splits."""
    return tasks.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("split_id")), ",").alias("splits"), F.count_distinct("split_id").alias("n")).where("n > 1").drop("n")


def rolled_up(runs: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """One ledger of all runs' rows: each key once with the runs that have it; ``conflicts`` counts payloads beyond the first."""
    p = F.struct(*payload)
    by = F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "method_id", F.col("search_seed").cast("string")))), ",")
    return runs.groupBy(*key).agg(F.min(p).alias("p"), by.alias("runs"), (F.count_distinct(p) - 1).alias("conflicts")).select(*key, "p.*", "runs", "conflicts")


def roll_up(spark: SparkSession, root: str, schema: str, key: list[str], payload: list[str], ledger_name: str = "outcomes") -> dict[str, DataFrame]:
    """The whole of ``root``/method_id=*/search_seed=*/<ledger>: the merged ledger (conflicts are an error) and an index of all files.

    The merged ledger is written to ``root``/rolled_up; the index has each file's path, digest and size.
    """
    found = spark.read.schema(f"method_id string, search_seed long, {schema}").option("mode", "FAILFAST").option("basePath", root).json(f"{root}/method_id=*/search_seed=*/{ledger_name}")
    merged = rolled_up(found, key, payload)
    ledger.require_none(merged.where("conflicts > 0").select(*key), "runs disagree on")
    merged.write.mode("overwrite").parquet(f"{root}/rolled_up/{ledger_name}")
    index = ledger.file_digests(spark, f"{root}/method_id=*/search_seed=*/{ledger_name}")
    return {ledger_name: spark.read.parquet(f"{root}/rolled_up/{ledger_name}"), "index": index}


def add_final(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Writes the last stage's tables beside the rolled-up ones; returns (name, rows) of all that is there now."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{root}/rolled_up/{name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rolled_up")
    names = sorted(s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where))
    return spark.createDataFrame([(n, spark.read.parquet(f"{root}/rolled_up/{n}").count()) for n in names], "name string, rows long")


def primary_analysis(rows: DataFrame, runs: DataFrame, constraints: objectives.Constraints, ranges: Mapping[str, tuple[float, float]], reference: list[float], treatment: str, comparisons: list[str], seeds: list[int], replicates: int = 2000, seed: int = 0, token_bound: float | None = None) -> dict[str, DataFrame]:
    """The final analysis: overlapping executions once, bounds of all objectives, fronts of all runs against the pooled one, and contrasts of their volumes.

    ``rows``: final outcomes with role and execution_group; ``runs``: (method_id, search_seed, candidate_id).  Too few
    blocks for bounds of the tokens need the configuration's ``token_bound``; without one they are an error.
    """
    problems = dedup.overlap_violations(rows)
    ledger.require_none(problems, "overlapping executions disagree")
    once = dedup.overlap_dedup(rows).withColumn("split", F.col("role"))
    pairs = objectives.pair_with_base(once.where("role <> 'diagnostic'"))
    points = objectives.maximised(objectives.objectives(pairs))
    estimates = summaries(pairs, replicates, seed, token_bound=token_bound)
    unit: dict[str, Column] = {}
    for i, (o, (low, high)) in enumerate(ranges.items(), 1):
        unit[f"v{i}"] = F.lit(0.0) if high <= low else (F.col(f"v{i}") - low) / (high - low)
    pool = objectives.feasibility(points, constraints).withColumns(unit).select("candidate_id", "feasible", *pareto.dims(points))
    fronts = reports.front_report(pool, runs, reference)
    contrasts = inference.seed_contrasts(fronts.select("method_id", "search_seed", F.col("hypervolume").alias("value")), treatment, comparisons, seeds)
    return {"observations": pairs, "estimates": estimates, "fronts": fronts, "contrasts": contrasts}


def usage_total(rows: DataFrame) -> DataFrame:
    """Calls and tokens of all rows as one provider's."""
    return accounting.usage(rows, F.lit("all"))
