"""Queries over the outcome table: matrices, pairing, objectives, bootstrap, feasibility, fronts, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, checks, objectives, pareto, resampling, selection
from ..sources.outcomes import KEY, outcomes, outcomes_sql

REPLICATES, FULL, SEED = 200, 2000, 20240501
PAIRS_SQL = outcomes_sql() + """, p AS (
  SELECT o.candidate_id, o.target_id, o.task_id, o.seed, o.split, CASE WHEN o.split = 'transfer' THEN coalesce(o.transfer_group, o.target_id) END AS grp,
         o.correct AS cc, b.correct AS bc, o.input_tokens + o.output_tokens AS tok, o.input_tokens, o.output_tokens
  FROM o JOIN o b ON b.is_base AND b.target_id = o.target_id AND b.task_id = o.task_id AND b.seed = o.seed
)"""
OBJ_SQL = PAIRS_SQL + """, obj AS (
  SELECT candidate_id, avg(cc::INT) FILTER (split = 'id') AS accuracy,
         (SELECT min(r) FROM (SELECT avg(q.cc::INT) AS r FROM p q WHERE q.candidate_id = p.candidate_id AND q.split = 'transfer' GROUP BY q.grp)) AS transfer,
         avg(tok) AS token_cost, coalesce(count(*) FILTER (bc AND NOT cc) / nullif(count(*) FILTER (bc), 0), 1.0) AS regression,
         count(*) FILTER (bc) > 0 AS regression_defined, avg(cc::INT - bc::INT) FILTER (split = 'id') AS delta
  FROM p GROUP BY candidate_id
)"""
#: Vectors in the maximised orientation.
VEC_SQL = OBJ_SQL + ", v AS (SELECT *, accuracy AS v1, transfer AS v2, -token_cost AS v3, -regression AS v4 FROM obj)"
_DOM = "(a.v1 >= b.v1 AND a.v2 >= b.v2 AND a.v3 >= b.v3 AND a.v4 >= b.v4 AND (a.v1 > b.v1 OR a.v2 > b.v2 OR a.v3 > b.v3 OR a.v4 > b.v4))"
CONSTRAINTS = objectives.Constraints(0.5, 140.0, -0.05)
RANGES = {"accuracy": (0.0, 1.0), "transfer": (0.0, 1.0), "token_cost": (-200.0, 0.0), "regression": (-1.0, 0.0)}
REFERENCE = [0.0, 0.0, -200.0, -1.0]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.pair_with_base(outcomes(spark, sf))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Objectives of all candidates: one row each, so what follows is small."""
    return objectives.objectives(pairs(spark, sf))


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.maximised(points(spark, sf))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(f"WITH {outcomes_sql()} SELECT * FROM o")
def outcome_matrix(spark, sf):
    """The outcome table itself."""
    return outcomes(spark, sf)


@query(f"WITH {outcomes_sql()} SELECT c.candidate_id, t.target_id, k.task_id, s.seed FROM (SELECT DISTINCT candidate_id FROM o) c, (SELECT DISTINCT target_id FROM o) t, (SELECT DISTINCT task_id FROM o) k, (SELECT DISTINCT seed FROM o) s WHERE t.target_id <> 't3' OR k.task_id <> 'k7'")
def expected_matrix(spark, sf):
    """Candidates x compatible (target, block): target t3 takes no block of task k7."""
    o = outcomes(spark, sf)
    t = o.select("target_id").distinct().select("target_id", F.lit("d").alias("domain_id"), F.when(F.col("target_id") == "t3", "most").otherwise("*").alias("task_group"), F.lit(None).cast("string").alias("split_id"), F.lit("id").alias("objective_role"))
    b = o.select("task_id", "seed").distinct().select("task_id", "seed", F.lit("d").alias("domain_id"), F.when(F.col("task_id") == "k7", "odd").otherwise("most").alias("group_id"), F.lit("s").alias("split_id"), F.lit(None).cast("string").alias("objective_role"))
    return objectives.evaluation_matrix(o.select("candidate_id").distinct(), t, b)


@query(f"WITH {outcomes_sql()} SELECT candidate_id, target_id, task_id, seed, 'missing' AS problem FROM o WHERE task_id = 'k5' AND seed = 1 UNION ALL SELECT candidate_id, target_id, 'x' || task_id, seed, 'extra' FROM o WHERE task_id = 'k6' AND seed = 2")
def matrix_violations(spark, sf):
    """Missing and extra keys of an altered matrix."""
    o = outcomes(spark, sf)
    seen = o.where("not (task_id = 'k5' and seed = 1)").select(*KEY).unionByName(o.where("task_id = 'k6' and seed = 2").withColumn("task_id", F.concat(F.lit("x"), "task_id")).select(*KEY))
    return checks.difference(o, seen, KEY)


@query(f"WITH {outcomes_sql()} SELECT candidate_id, target_id, task_id, seed, 2 * count(*) AS n FROM o WHERE seed = 0 GROUP BY ALL")
def duplicate_keys_all(spark, sf):
    """Repeated keys of the whole ledger, all candidates and targets."""
    o = outcomes(spark, sf).select(*KEY)
    return checks.duplicates(o.unionByName(o.where("seed = 0")), KEY)


@query(f"WITH {outcomes_sql()}, d AS (SELECT * FROM o WHERE NOT (target_id = 't1' AND task_id = 'k3')) SELECT candidate_id, target_id, count(DISTINCT (task_id, seed)) AS cells, count(*) AS rows, 120 AS wanted FROM d GROUP BY ALL HAVING count(*) <> 120")
def unclosed_targets(spark, sf):
    """Candidates' targets that lack blocks."""
    return checks.unclosed(outcomes(spark, sf).where("not (target_id = 't1' and task_id = 'k3')"), ["candidate_id", "target_id"], ["task_id", "seed"])


@query("WITH t AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'a' WHEN l_orderkey % 3 = 1 THEN 'b' ELSE 'c' END AS split_id, CAST(l_partkey AS VARCHAR) AS task_id FROM lineitem) SELECT x.split_id, y.split_id AS other_id, x.task_id FROM t x JOIN t y USING (task_id) WHERE (x.split_id = 'a' AND y.split_id IN ('b', 'c')) OR (x.split_id = 'b' AND y.split_id = 'c')")
def split_overlap_all(spark, sf):
    """Tasks in two splits that are declared disjoint, of all parts."""
    return _overlaps(spark, spark.read.parquet(f"{sf}/lineitem.parquet"))


def _overlaps(spark, li):
    tasks = li.select(F.expr("case when l_orderkey % 3 = 0 then 'a' when l_orderkey % 3 = 1 then 'b' else 'c' end").alias("split_id"), F.col("l_partkey").cast("string").alias("task_id"))
    return checks.declared_overlaps(tasks, spark.createDataFrame([("a", ["b", "c"]), ("b", ["c"])], "split_id string, disjoint_from array<string>"))


@query(f"WITH {PAIRS_SQL} SELECT candidate_id, target_id, task_id, seed, split, grp, cc AS candidate_correct, bc AS base_correct, input_tokens, output_tokens FROM p")
def paired_observations(spark, sf):
    """Each outcome with the base's."""
    return pairs(spark, sf)


@query(f"WITH {outcomes_sql()} SELECT target_id, task_id, seed, correct AS candidate_correct, correct AS base_correct FROM o WHERE is_base")
def base_self_pair(spark, sf):
    """The base paired with itself."""
    return pairs(spark, sf).where("candidate_id = 'c0'").select("target_id", "task_id", "seed", "candidate_correct", "base_correct")


@query(f"WITH {outcomes_sql()} SELECT candidate_id, target_id, task_id, seed FROM o WHERE task_id = 'k9' AND candidate_id <> 'c0'")
def unpaired_rows(spark, sf):
    """Outcomes whose base result is gone."""
    return objectives.unpaired(outcomes(spark, sf).where("not (task_id = 'k9' and is_base)")).select(*KEY)


@query(f"WITH {OBJ_SQL} SELECT candidate_id, round(accuracy, 6) AS accuracy, round(transfer, 6) AS transfer, round(token_cost, 6) AS token_cost, round(regression, 6) AS regression, regression_defined, round(delta, 6) AS delta FROM obj")
def candidate_objectives(spark, sf):
    """The four objectives and the paired difference."""
    return rounded(points(spark, sf), "accuracy", "transfer", "token_cost", "regression", "delta")


@query(f"WITH {PAIRS_SQL} SELECT candidate_id, grp, round(avg(cc::INT), 6) AS rate, count(*) AS n FROM p WHERE split = 'transfer' GROUP BY ALL")
def group_rates(spark, sf):
    """Success by transfer group."""
    return rounded(objectives.group_rates(pairs(spark, sf)), "rate")


@query(f"WITH {PAIRS_SQL} SELECT candidate_id, target_id, round(avg(cc::INT), 6) AS accuracy, round(avg(cc::INT - bc::INT), 6) AS delta, round(count(*) FILTER (bc AND NOT cc) / nullif(count(*) FILTER (bc), 0), 6) AS regression, round(avg(tok), 6) AS token_cost FROM p GROUP BY ALL")
def target_statistics(spark, sf):
    """Pair statistics by target."""
    return rounded(objectives.target_statistics(pairs(spark, sf)), "accuracy", "delta", "regression", "token_cost")


@query(f"WITH {PAIRS_SQL} SELECT candidate_id, count(DISTINCT (task_id, seed)) AS blocks, count(DISTINCT (task_id, seed)) FILTER (split = 'id') AS id_blocks, count(DISTINCT (task_id, seed)) FILTER (bc) AS base_correct_blocks, (SELECT min(n) FROM (SELECT count(DISTINCT (task_id, seed)) AS n FROM p q WHERE q.candidate_id = p.candidate_id AND q.split = 'transfer' GROUP BY grp)) AS transfer_blocks FROM p GROUP BY candidate_id")
def block_counts(spark, sf):
    """Distinct blocks behind each metric."""
    return objectives.block_counts(pairs(spark, sf))


@query(f"WITH {outcomes_sql()}, m AS (SELECT task_id, avg(correct::INT) AS mean FROM o WHERE is_base AND split = 'id' GROUP BY task_id), r AS (SELECT task_id, row_number() OVER (ORDER BY mean, task_id) AS a, row_number() OVER (ORDER BY mean DESC, task_id DESC) AS z FROM m) SELECT candidate_id, round(avg(correct::INT) FILTER (a <= 7), 6) AS hard, round(avg(correct::INT) FILTER (z <= 7), 6) AS easy FROM o JOIN r USING (task_id) WHERE split = 'id' GROUP BY candidate_id")
def hard_easy_rates(spark, sf):
    """Success on the base's hardest and easiest tasks."""
    return rounded(objectives.hard_easy(outcomes(spark, sf), 7), "hard", "easy")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, concat_ws(',', CASE WHEN accuracy + 1e-12 < 0.5 THEN 'accuracy_floor' END, CASE WHEN delta IS NULL THEN 'accuracy_delta_unavailable' WHEN delta + 1e-12 < -0.05 THEN 'accuracy_delta_floor' END, CASE WHEN token_cost - 1e-12 > 140 THEN 'token_budget' END) AS reasons FROM obj")
def feasibility_reasons(spark, sf):
    """Why a candidate is infeasible."""
    return objectives.feasibility(points(spark, sf), CONSTRAINTS).select("candidate_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {OBJ_SQL}, c AS (SELECT candidate_id, count(*) AS evaluation_cost FROM o GROUP BY 1) SELECT candidate_id, round(accuracy, 6) AS accuracy, evaluation_cost, NOT (accuracy + 1e-12 < 0.5 OR delta + 1e-12 < -0.05 OR token_cost - 1e-12 > 140) AS feasible FROM obj JOIN c USING (candidate_id)")
def scored_candidates(spark, sf):
    """Scoring table: feasibility and what the evaluation cost."""
    cost = outcomes(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("evaluation_cost"))
    return rounded(objectives.feasibility(points(spark, sf), CONSTRAINTS).join(cost, "candidate_id").select("candidate_id", "accuracy", "evaluation_cost", "feasible"), "accuracy")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, round(accuracy, 6) AS accuracy, round((token_cost + 200) / 0.5, 6) AS n_token_cost, round((regression - 0.25) / 0.25, 6) AS n_regression, 0.0::DOUBLE AS n_delta, round(least(1, greatest(0, (transfer - 0.5) / 0.1)), 6) AS n_transfer FROM obj")
def normalized_vectors(spark, sf):
    """Min-max normalisation, with and without clipping, and of a range without width."""
    d = objectives.normalised(points(spark, sf), {"token_cost": (-200.0, -199.5), "regression": (0.25, 0.5)})
    d = objectives.normalised(objectives.normalised(d, {"delta": (0.1, 0.1)}, on_degenerate=0.0), {"transfer": (0.5, 0.6)}, clip=True)
    return rounded(d.select("candidate_id", "accuracy", "n_token_cost", "n_regression", "n_delta", "n_transfer"), "accuracy", "n_token_cost", "n_regression", "n_transfer")


_STRATA = ", b AS (SELECT candidate_id, task_id, seed, md5(array_to_string(list_sort(list(split || '|' || target_id || '|' || coalesce(grp, ''))), ';')) AS stratum FROM p GROUP BY ALL), st AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, stratum ORDER BY task_id, seed) - 1 AS place, count(*) OVER (PARTITION BY candidate_id, stratum) AS size FROM b)"
_DRAWS = _STRATA + f""", l AS (SELECT DISTINCT stratum, size FROM st), dr AS (
  SELECT stratum, size, r AS replicate, CAST(('0x' || substr(md5('{SEED}|' || r || '|' || stratum || '|' || d), 1, 8))::BIGINT % size AS BIGINT) AS place, count(*) AS weight
  FROM l, generate_series(0, {REPLICATES - 1}) a(r), generate_series(0, size - 1) c(d) GROUP BY ALL)"""
_SAMPLES = PAIRS_SQL + _DRAWS + """, j AS (
  SELECT p.candidate_id, dr.replicate, p.split, p.grp, sum(weight) AS n, sum(weight * cc::INT) AS c, sum(weight * bc::INT) AS b, sum(weight * (bc AND NOT cc)::INT) AS f, sum(weight * tok) AS tok
  FROM p JOIN st USING (candidate_id, task_id, seed) JOIN dr USING (stratum, size, place) GROUP BY ALL
), s AS (
  SELECT candidate_id, replicate, sum(c) FILTER (split = 'id') / sum(n) FILTER (split = 'id') AS accuracy, (sum(c) FILTER (split = 'id') - sum(b) FILTER (split = 'id')) / sum(n) FILTER (split = 'id') AS delta,
         CASE WHEN count(*) FILTER (split = 'transfer') = 4 THEN min(c / n) FILTER (split = 'transfer') END AS transfer, sum(tok) / sum(n) AS token_cost, sum(f) / nullif(sum(b), 0) AS regression
  FROM j GROUP BY ALL)"""


@query(f"WITH {PAIRS_SQL}{_STRATA} SELECT candidate_id, task_id, seed, stratum, place, size FROM st")
def bootstrap_strata(spark, sf):
    """Blocks with their stratum."""
    return bootstrap.strata(pairs(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {PAIRS_SQL}{_DRAWS} SELECT replicate::INT AS replicate, place, weight FROM dr")
def bootstrap_draws(spark, sf):
    """Multiplicities of blocks in each replicate."""
    return bootstrap.hash_draws(bootstrap.strata(pairs(spark, sf)), REPLICATES, SEED).select("replicate", "place", "weight")


@query(f"WITH {_SAMPLES} SELECT candidate_id, replicate::INT AS replicate, round(accuracy, 6) AS accuracy, round(delta, 6) AS delta, round(transfer, 6) AS transfer, round(token_cost, 6) AS token_cost, round(regression, 6) AS regression FROM s")
def bootstrap_samples(spark, sf):
    """Metrics of each replicate."""
    return rounded(bootstrap.samples(pairs(spark, sf), REPLICATES, SEED), *bootstrap.METRICS)


@query(f"WITH {_SAMPLES} SELECT candidate_id, " + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{n}" for m in bootstrap.METRICS for n, q in (("low", 0.025), ("high", 0.975), ("lcb", 0.05), ("ucb", 0.95))) + " FROM s GROUP BY candidate_id")
def bootstrap_bounds(spark, sf):
    """Two-sided and one-sided bounds."""
    p = pairs(spark, sf)
    e = bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, REPLICATES, SEED), objectives.block_counts(p))
    names = [f"{m}_{n}" for m in bootstrap.METRICS for n in ("low", "high", "lcb", "ucb")]
    return rounded(e.select("candidate_id", *names), *names)


_NAMES = [f"{m}_{n}" for m in bootstrap.METRICS for n in ("low", "high", "lcb", "ucb")]


@query(SQL["bootstrap_bounds"].replace(f"generate_series(0, {REPLICATES - 1})", f"generate_series(0, {FULL - 1})"))
def bootstrap_bounds_full(spark, sf):
    """The bounds from as many replicates as the protocol's default."""
    p = pairs(spark, sf)
    e = bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, FULL, SEED), objectives.block_counts(p))
    return rounded(e.select("candidate_id", *_NAMES), *_NAMES)


@query()
def bootstrap_tree_bounds(spark, sf):
    """The bounds from draws by the multinomial tree; tests hold their law and their sums against brute force."""
    p = pairs(spark, sf)
    e = bootstrap.estimates(objectives.objectives(p), resampling.samples(p, FULL, SEED), objectives.block_counts(p))
    return rounded(e.select("candidate_id", *_NAMES), *_NAMES)


@query(f"WITH {PAIRS_SQL}, b AS (SELECT candidate_id, target_id, task_id, row_number() OVER (PARTITION BY candidate_id, target_id ORDER BY task_id) - 1 AS place, count(*) OVER (PARTITION BY candidate_id, target_id) AS size, candidate_id || '/' || target_id AS stratum FROM p GROUP BY candidate_id, target_id, task_id), l AS (SELECT DISTINCT stratum, size FROM b), dr AS (SELECT stratum, r AS replicate, ('0x' || substr(md5('7|' || r || '|' || stratum || '|' || d), 1, 8))::BIGINT % size AS place FROM l, generate_series(0, 49) a(r), generate_series(0, size - 1) c(d)) SELECT candidate_id, target_id, replicate::INT AS replicate, round(avg(cc::INT), 6) AS accuracy, round(avg(cc::INT - bc::INT), 6) AS delta, round(count(*) FILTER (bc AND NOT cc) / nullif(count(*) FILTER (bc), 0), 6) AS regression, round(avg(tok), 6) AS token_cost FROM dr JOIN b USING (stratum, place) JOIN p USING (candidate_id, target_id, task_id) GROUP BY ALL")
def task_cluster_samples(spark, sf):
    """Replicates with tasks as clusters, by target."""
    return rounded(bootstrap.cluster_samples(pairs(spark, sf), 50, 7), "accuracy", "delta", "regression", "token_cost")


@query(f"WITH {_SAMPLES} SELECT candidate_id, round(quantile_cont(accuracy, 0.05), 6) AS v1, round(quantile_cont(transfer, 0.05), 6) AS v2, round(-quantile_cont(token_cost, 0.95), 6) + 0.0 AS v3, round(-quantile_cont(regression, 0.95), 6) + 0.0 AS v4 FROM s GROUP BY candidate_id")
def pessimistic_vectors(spark, sf):
    """Lower bounds of benefits, negated upper bounds of costs."""
    p = pairs(spark, sf)
    e = bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, REPLICATES, SEED), objectives.block_counts(p))
    d = rounded(objectives.maximised(e, pessimistic=True).select("candidate_id", "v1", "v2", "v3", "v4"), "v1", "v2", "v3", "v4")
    return d.withColumns({c: F.col(c) + 0.0 for c in ("v1", "v2", "v3", "v4")})


@query(f"WITH {VEC_SQL} SELECT candidate_id FROM v b WHERE NOT EXISTS (SELECT 1 FROM v a WHERE {_DOM})")
def pareto_front(spark, sf):
    """Candidates that none dominates."""
    return pareto.front(vec(spark, sf)).select("candidate_id")


@query(f"WITH {VEC_SQL}, ok AS (SELECT * FROM v WHERE NOT (accuracy + 1e-12 < 0.5 OR delta + 1e-12 < -0.05 OR token_cost - 1e-12 > 140)) SELECT candidate_id, round(accuracy, 6) AS accuracy, round(transfer, 6) AS transfer, round(token_cost, 6) AS token_cost, round(regression, 6) AS regression FROM ok b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE {_DOM})")
def feasible_front(spark, sf):
    """Flagship: the feasible front with its objectives."""
    f = objectives.feasibility(vec(spark, sf), CONSTRAINTS).where("feasible")
    return rounded(pareto.front(f, tolerance=1e-12).select("candidate_id", "accuracy", "transfer", "token_cost", "regression"), "accuracy", "transfer", "token_cost", "regression")


@query(f"WITH {VEC_SQL} SELECT b.candidate_id, count(*) FILTER ({_DOM}) AS dominators, count(*) FILTER ({_DOM.replace('a.', 'x.').replace('b.', 'a.').replace('x.', 'b.')}) AS dominated FROM v a, v b GROUP BY 1")
def dominance_counts(spark, sf):
    """How many candidates each dominates and is dominated by."""
    return pareto.dominance_counts(vec(spark, sf), "candidate_id")


_E = "e AS (SELECT s_suppkey AS id, s_suppkey % 4 AS run, round(s_acctbal / 1000) + 0.0 AS v1, CAST((s_suppkey * 37) % 23 AS DOUBLE) AS v2, CAST((s_nationkey * 7 + s_suppkey) % 11 AS DOUBLE) AS v3 FROM supplier)"


def _pool(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("run"), (F.round(F.col("s_acctbal") / 1000) + 0.0).alias("v1"), ((F.col("s_suppkey") * 37) % 23).cast("double").alias("v2"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 11).cast("double").alias("v3"))


_D3 = "(a.v1 >= b.v1 AND a.v2 >= b.v2 AND a.v3 >= b.v3 AND (a.v1 > b.v1 OR a.v2 > b.v2 OR a.v3 > b.v3))"


@query(f"WITH {_E} SELECT run, id FROM e b WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.run = b.run AND {_D3})")
def run_fronts(spark, sf):
    """Fronts of several runs at once."""
    return pareto.front(_pool(spark, sf), ["run"]).select("run", "id")


@query(f"WITH RECURSIVE {_E}, c AS (SELECT run, id, 0 AS depth FROM e UNION SELECT b.run, b.id, c.depth + 1 FROM c JOIN e a ON a.id = c.id JOIN e b ON b.run = a.run AND {_D3}) SELECT run, id, max(depth) AS rank FROM c GROUP BY ALL")
def front_ranks(spark, sf):
    """Non-dominated sorting: the rank is the longest chain of dominators."""
    return pareto.ranks(_pool(spark, sf), "id", ["run"]).select("run", "id", "rank")


_CROWD = ", ".join(f"max({c}) OVER w - min({c}) OVER w AS s_{c}, lag({c}) OVER (PARTITION BY run ORDER BY {c}, id) AS b_{c}, lead({c}) OVER (PARTITION BY run ORDER BY {c}, id) AS a_{c}" for c in ("v1", "v2", "v3"))
_EDGE = " OR ".join(f"(s_{c} > 0 AND (b_{c} IS NULL OR a_{c} IS NULL))" for c in ("v1", "v2", "v3"))
_GAPS = " + ".join(f"coalesce(CASE WHEN s_{c} > 0 THEN (a_{c} - b_{c}) / s_{c} END, 0)" for c in ("v1", "v2", "v3"))


@query(f"WITH {_E}, x AS (SELECT run, id, {_CROWD} FROM e WINDOW w AS (PARTITION BY run)) SELECT run, id, ({_EDGE}) AS boundary, round(CASE WHEN {_EDGE} THEN 0 ELSE {_GAPS} END, 6) AS crowding FROM x")
def crowding(spark, sf):
    """Crowding distance within each run."""
    return rounded(pareto.crowding(_pool(spark, sf), "id", ["run"]).select("run", "id", "boundary", "crowding"), "crowding")


_EXT = " + ".join(f"(s_{c} > 0 AND ({c} = l_{c} OR {c} = h_{c}))::INT" for c in ("v1", "v2", "v3"))
_LH = ", ".join(f"{c}, min({c}) OVER w AS l_{c}, max({c}) OVER w AS h_{c}" for c in ("v1", "v2", "v3"))


@query(f"WITH {_E}, x AS (SELECT run, id, {_CROWD}, {_LH} FROM e WINDOW w AS (PARTITION BY run)), y AS (SELECT run, id, {_EXT} AS ext, {_GAPS} AS gaps FROM x) SELECT run, id FROM y QUALIFY row_number() OVER (PARTITION BY run ORDER BY ext DESC, CASE WHEN ext > 0 THEN 'inf'::DOUBLE ELSE gaps END DESC, id) <= 6")
def capacity_prune(spark, sf):
    """What a bounded archive keeps of each run."""
    return pareto.capacity_kept(_pool(spark, sf), "id", 6, ["run"]).select("run", "id")


def _grid_sql(points: str, reference: list[float]) -> str:
    edges = ", ".join(f"g{i} AS (SELECT x AS l, lead(x) OVER (ORDER BY x) AS u FROM (SELECT v{i} AS x FROM pts UNION SELECT {r}::DOUBLE))" for i, r in enumerate(reference, 1))
    n = range(1, len(reference) + 1)
    cells = " * ".join(f"(g{i}.u - g{i}.l)" for i in n)
    inside = " AND ".join(f"q.v{i} >= g{i}.u" for i in n)
    above = " AND ".join(f"v{i} >= {r}" for i, r in zip(n, reference))
    return f"pts AS (SELECT * FROM ({points}) WHERE {above}), {edges}, hv AS (SELECT coalesce(sum({cells}), 0) AS hypervolume FROM {', '.join(f'g{i}' for i in n)} WHERE EXISTS (SELECT 1 FROM pts q WHERE {inside}))"


@query(f"WITH {VEC_SQL}, {_grid_sql('SELECT v1, v2, v3, v4 FROM v', REFERENCE)} SELECT round(hypervolume, 6) AS hypervolume FROM hv")
def hypervolume_4d(spark, sf):
    """Exact volume that the candidates dominate, by slabs."""
    return rounded(pareto.hypervolume(vec(spark, sf).withColumn("pool", F.lit(0)), REFERENCE, ["pool"]).select("hypervolume"), "hypervolume")


@query(f"WITH {VEC_SQL}, {_grid_sql('SELECT v1, v2 FROM v', REFERENCE[:2])} SELECT round(hypervolume, 6) AS hypervolume FROM hv")
def hypervolume_2d(spark, sf):
    """Volume in two dimensions, by the coordinate grid."""
    return rounded(pareto.hypervolume_grid(vec(spark, sf).select("v1", "v2"), REFERENCE[:2]), "hypervolume")


@query(f"WITH {_E}, r AS (SELECT DISTINCT run FROM e), z AS (SELECT r.run, g1.x AS l1, g1.y AS u1, g2.x AS l2, g2.y AS u2, g3.x AS l3, g3.y AS u3 FROM r JOIN (SELECT run, v AS x, lead(v) OVER (PARTITION BY run ORDER BY v) AS y FROM (SELECT run, v1 AS v FROM e UNION SELECT run, -2 FROM r)) g1 USING (run) JOIN (SELECT run, v AS x, lead(v) OVER (PARTITION BY run ORDER BY v) AS y FROM (SELECT run, v2 AS v FROM e UNION SELECT run, -1 FROM r)) g2 USING (run) JOIN (SELECT run, v AS x, lead(v) OVER (PARTITION BY run ORDER BY v) AS y FROM (SELECT run, v3 AS v FROM e UNION SELECT run, -1 FROM r)) g3 USING (run)), c AS (SELECT z.*, (SELECT count(*) FROM e WHERE e.run = z.run AND v1 >= u1 AND v2 >= u2 AND v3 >= u3) AS n, (SELECT min(id) FROM e WHERE e.run = z.run AND v1 >= u1 AND v2 >= u2 AND v3 >= u3) AS one FROM z WHERE u1 IS NOT NULL AND u2 IS NOT NULL AND u3 IS NOT NULL) SELECT e.run, e.id, round(coalesce((SELECT sum((u1 - l1) * (u2 - l2) * (u3 - l3)) FROM c WHERE c.n = 1 AND c.one = e.id AND c.run = e.run), 0), 6) AS contribution FROM e")
def hv_contribution(spark, sf):
    """Exclusive volume of each member of a run."""
    return rounded(pareto.contributions(_pool(spark, sf), "id", [-2.0, -1.0, -1.0], ["run"]).select("run", "id", "contribution"), "contribution")


_TWO = f"{_E}, l AS (SELECT * FROM e WHERE run % 2 = 0), r AS (SELECT * FROM e WHERE run % 2 = 1)"


def _two(spark, sf):
    p = _pool(spark, sf)
    return p.where("run % 2 = 0"), p.where("run % 2 = 1")


@query(f"WITH {_TWO} SELECT round(avg((EXISTS (SELECT 1 FROM l WHERE l.v1 >= r.v1 AND l.v2 >= r.v2 AND l.v3 >= r.v3))::INT), 6) AS coverage FROM r")
def coverage(spark, sf):
    """Share of the odd runs that the even ones weakly dominate."""
    return rounded(pareto.coverage(*_two(spark, sf)), "coverage")


@query(f"WITH {_TWO} SELECT max(m) AS epsilon FROM (SELECT r.id, min(greatest(r.v1 - l.v1, r.v2 - l.v2, r.v3 - l.v3)) AS m FROM r, l GROUP BY r.id)")
def additive_epsilon(spark, sf):
    """Additive epsilon indicator."""
    return pareto.epsilon(*_two(spark, sf))


@query(f"WITH {_TWO} SELECT round(avg(m), 6) AS igd FROM (SELECT r.id, min(sqrt((r.v1 - l.v1) ** 2 + (r.v2 - l.v2) ** 2 + (r.v3 - l.v3) ** 2)) AS m FROM r, l GROUP BY r.id)")
def inverted_distance(spark, sf):
    """Inverted generational distance."""
    return rounded(pareto.inverted_distance(*_two(spark, sf)), "igd")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, row_number() OVER (ORDER BY accuracy DESC, candidate_id)::INT AS place FROM obj QUALIFY place <= 3")
def topk_accuracy(spark, sf):
    """The three most accurate."""
    return selection.by_accuracy(points(spark, sf), 3).select("candidate_id", "place")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, row_number() OVER (ORDER BY accuracy DESC, token_cost, candidate_id)::INT AS place FROM obj WHERE NOT (accuracy + 1e-12 < 0.5 OR delta + 1e-12 < -0.05 OR token_cost - 1e-12 > 140) QUALIFY place <= 3")
def topk_feasible(spark, sf):
    """The three most accurate feasible ones."""
    return selection.feasible_by_accuracy(objectives.feasibility(points(spark, sf), CONSTRAINTS), 3).select("candidate_id", "place")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, round(0.4 * accuracy + 0.3 * transfer - 0.2 * token_cost / 200 - 0.1 * regression, 6) AS scalar FROM obj ORDER BY 2 DESC, 1 LIMIT 4")
def scalarized(spark, sf):
    """The best weighted sums."""
    d = objectives.normalised(points(spark, sf), {"accuracy": (0.0, 1.0), "transfer": (0.0, 1.0), "token_cost": (0.0, 200.0), "regression": (0.0, 1.0)})
    return rounded(selection.scalarised(d, {"accuracy": 0.4, "transfer": 0.3, "token_cost": -0.2, "regression": -0.1}, 4).select("candidate_id", "scalar"), "scalar")


@query(SQL["hard_easy_rates"].replace("SELECT candidate_id, round(avg(correct::INT) FILTER (a <= 7), 6) AS hard, round(avg(correct::INT) FILTER (z <= 7), 6) AS easy", "SELECT candidate_id, round(avg(correct::INT) FILTER (a <= 7) * avg(correct::INT) FILTER (z <= 7), 6) AS product") + " ORDER BY product DESC, candidate_id LIMIT 4")
def hard_easy_product(spark, sf):
    """The best products of probe rates."""
    return rounded(selection.hard_easy_product(objectives.hard_easy(outcomes(spark, sf), 7), 4).select("candidate_id", "product"), "product")


_CROWD_ALL = _CROWD.replace("PARTITION BY run", "PARTITION BY rank").replace(", id)", ", candidate_id)")


@query(f"WITH RECURSIVE {_E}, c AS (SELECT id, 0 AS depth FROM e UNION SELECT b.id, c.depth + 1 FROM c JOIN e a ON a.id = c.id JOIN e b ON {_D3}), r AS (SELECT 'c' || e.id AS candidate_id, e.v1, e.v2, e.v3, max(depth)::INT AS rank FROM c JOIN e ON e.id = c.id GROUP BY ALL), x AS (SELECT candidate_id, rank, {_CROWD_ALL} FROM r WINDOW w AS (PARTITION BY rank)) SELECT candidate_id, rank FROM x ORDER BY rank, ({_EDGE}) DESC, CASE WHEN {_EDGE} THEN 0 ELSE {_GAPS} END DESC, candidate_id LIMIT 9")
def nsga_survivors_all(spark, sf):
    """Survivors of the whole pool by rank and crowding."""
    return _survivors(_pool(spark, sf))


def _survivors(pool):
    p = pool.withColumn("candidate_id", F.concat(F.lit("c"), F.col("id").cast("string")))
    return selection.survivors(p.select("candidate_id", "v1", "v2", "v3"), 9).select("candidate_id", "rank")


@query(f"WITH {OBJ_SQL} (SELECT 'min_tokens' AS policy_id, true AS defined, candidate_id, NULL::VARCHAR AS reason FROM obj WHERE accuracy >= 0.55 ORDER BY token_cost, regression, candidate_id LIMIT 1) UNION ALL SELECT 'max_transfer', false, NULL, 'no_candidate_within_token_budget' UNION ALL (SELECT 'knee', true, candidate_id, NULL FROM obj ORDER BY sqrt((1 - accuracy) ** 2 + (1 - transfer) ** 2 + (1 - (-token_cost + 200) / 200) ** 2 + (1 - (-regression + 1)) ** 2), regression, token_cost, candidate_id LIMIT 1)")
def deploy_payload(spark, sf):
    """Deployment policies, with the reason of an undefined one."""
    return selection.deployments(points(spark, sf).withColumn("content_hash", F.col("candidate_id")), 0.55, 10.0, RANGES)


@query(f"WITH {OBJ_SQL} SELECT candidate_id, round(transfer, 6) AS transfer FROM obj WHERE token_cost <= 120 ORDER BY transfer DESC, regression, token_cost, candidate_id LIMIT 1")
def deploy_max_transfer(spark, sf):
    """The best transfer within a token budget."""
    return rounded(selection.max_transfer(points(spark, sf).withColumn("content_hash", F.col("candidate_id")), 120.0).select("candidate_id", "transfer"), "transfer")


@query(f"WITH {outcomes_sql()}, b AS (SELECT DISTINCT target_id, task_id AS block_id, seed FROM o) SELECT target_id, block_id, seed, row_number() OVER (PARTITION BY target_id ORDER BY sha256('pilot' || chr(0) || target_id || chr(0) || block_id || chr(0) || seed), block_id, seed)::INT AS place FROM b QUALIFY place <= 8")
def screen_sample(spark, sf):
    """A fixed pseudo-random sample of blocks for each target."""
    b = outcomes(spark, sf).select("target_id", F.col("task_id").alias("block_id"), "seed").distinct()
    return selection.hash_sample(b, 8, "pilot").select("target_id", "block_id", "seed", "place")
