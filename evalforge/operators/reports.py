"""Roll-ups over runs: run matrices, candidate sets, and frontier reports against the pooled front."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boxes, checks, pareto


def runtime_blocks(tasks: DataFrame, seeds: list[int]) -> DataFrame:
    """(block_id, task columns, seed): each task with each seed; the id is a digest of the block's key."""
    spark = tasks.sparkSession
    grid = tasks.join(F.broadcast(spark.createDataFrame([(s,) for s in seeds], "seed long")))  # the seeds of a run
    return grid.withColumn("block_id", F.sha2(F.concat_ws("\0", "task_id", "split_id", "objective_role", F.col("seed").cast("string")), 256))


def run_matrix(methods: DataFrame, seeds: list[int]) -> DataFrame:
    """(method_id, search_seed): each method with each seed, controls with the first alone.  ``methods``: (method_id, control)."""
    spark = methods.sparkSession
    s = spark.createDataFrame([(int(x), i) for i, x in enumerate(seeds)], "search_seed long, place int")
    return methods.join(F.broadcast(s), (~F.col("control")) | (F.col("place") == 0)).select("method_id", "search_seed")


def selected(rows: DataFrame) -> DataFrame:
    """Selected candidates with ``canonical_id``: the first id (by path, line) of each content and mode.

    ``rows``: (path, line, method_id, search_seed, candidate_id, injection_mode, content_hash); with mode "none" the
    content doesn't count.
    """
    content = F.when(F.col("injection_mode") == "none", "no-skill").otherwise(F.col("content_hash"))
    w = Window.partitionBy(content, "injection_mode").orderBy("path", "line")
    return rows.withColumn("canonical_id", F.first("candidate_id").over(w))


def candidate_sets(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(method_id, search_seed, candidate_id) of the expected runs, each once."""
    return sources.select("method_id", "search_seed", F.col("canonical_id").alias("candidate_id")).join(runs, ["method_id", "search_seed"], "left_semi").distinct()


def run_problems(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that are missing or extra."""
    return checks.difference(runs, sources, ["method_id", "search_seed"])


def deployed(payloads: DataFrame) -> DataFrame:
    """(candidate_id, policies): candidates that some defined policy of some run picked."""
    return payloads.where("defined").groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("policy_id")), ",").alias("policies"))


def front_report(candidates: DataFrame, runs: DataFrame, reference: list[float]) -> DataFrame:
    """Per run: candidates, feasible, front, hypervolume, coverage, epsilon, igd of the run's front against the pooled front.

    ``candidates``: (candidate_id, feasible, v1..) normalised; ``runs``: (method_id, search_seed, candidate_id).  A run
    without feasible candidates has volume and coverage 0 and no epsilon or igd; without a pooled front coverage is
    null as well.  Candidates of a run are joined once; a run's front meets each cell of the pooled front in a task,
    where boxes tell what has to be compared.
    """
    cols, run = pareto.dims(candidates), ["method_id", "search_seed"]
    members = runs.distinct().join(candidates, "candidate_id")
    ok = members.where("feasible").select(*run, "candidate_id", *cols)
    own = pareto.front(ok, run)
    q = boxes.cells(pareto.vectors(ok.select(*cols)), cols)
    size = q.rows.agg(F.count("*").alias("pooled"))
    volume = pareto.hypervolume(own.select(*run, *cols), reference, run)

    def against(every: pa.Table, mine: pa.Table) -> pa.Table:
        """The run's front against one cell of the pooled front."""
        r, v = boxes.matrix(every, cols), boxes.matrix(mine, cols)
        far, near = boxes.least(r, v, boxes.shift_bound, boxes.shift), boxes.least(r, v, boxes.distance_bound, boxes.distance)
        of = {c: every.column(c).slice(0, 1).combine_chunks() for c in run}
        return pa.table(of | {"e": [far.max()], "d": [near.sum()], "hit": [int((far <= 0).sum())], "n": [len(r)]})

    cell = F.explode(F.sequence(F.lit(0), F.lit(max(len(q) - 1, 0)))).alias("cell")
    left = own.select(*run).distinct().select(*run, cell).join(q.rows.select("cell", *cols), "cell")
    right = own.select(*run, *cols).distinct().select(*[F.col(c).alias(c) for c in [*run, *cols]], cell).join(q.rows.select("cell").distinct(), "cell", "left_semi")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name in run)
    met = left.groupBy(*run, "cell").cogroup(right.groupBy(*run, "cell")).applyInArrow(against, f"{fields}, e double, d double, hit long, n long")
    marks = met.groupBy(*run).agg(F.max("e").alias("epsilon"), (F.sum("d") / F.sum("n")).alias("igd"), (F.sum("hit") / F.sum("n")).alias("covered"))
    counts = members.groupBy(*run).agg(F.count("*").alias("candidates"), F.count_if("feasible").alias("feasible"))
    fronts = own.groupBy(*run).agg(F.array_join(F.array_sort(F.collect_set("candidate_id")), ",").alias("front"))
    out = counts.join(fronts, run, "left").join(volume, run, "left").join(marks, run, "left").join(size)
    return out.select(*run, "candidates", "feasible", F.coalesce("front", F.lit("")).alias("front"), F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"), F.when(F.col("pooled") > 0, F.coalesce("covered", F.lit(0.0))).alias("coverage"), "epsilon", "igd")


def frontier_summary(candidates: DataFrame) -> DataFrame:
    """One row: candidates, feasible_rate, front_size of a scored pool."""
    n = candidates.agg(F.count("*").alias("candidates"), F.avg(F.col("feasible").cast("int")).alias("feasible_rate"))
    return n.join(pareto.front(candidates.where("feasible")).agg(F.count("*").alias("front_size")))


def pin_problems(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, problem) of pinned files that are missing or whose digest differs."""
    j = expected.select("path", F.col("sha256").alias("want")).join(observed.select("path", F.col("sha256").alias("got")), "path", "left")
    return j.where("got is null or got <> want").select("path", F.when(F.col("got").isNull(), "missing").otherwise("changed").alias("problem"))
