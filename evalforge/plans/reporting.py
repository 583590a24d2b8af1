"""Queries over runs and their fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, pareto, reports
from ..sources.outcomes import outcomes, outcomes_sql
from .evaluation import _D3, _E, _pool, rounded

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


def _scored(spark, sf):
    p = _pool(spark, sf)
    n = lambda c, low, high: ((F.col(c) - low) / (high - low)).alias(c)
    return p.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"), (F.col("id") % 6 != 0).alias("feasible"), n("v1", -1.0, 10.0), n("v2", 0.0, 25.0), n("v3", 0.0, 11.0))


def _runs(spark, sf):
    p = _pool(spark, sf)
    normal = p.select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("method_id"), (F.col("id") % 2).alias("search_seed"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"))
    empty = p.where("id % 6 = 0").select(F.lit("none").alias("method_id"), F.lit(0).cast("long").alias("search_seed"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"))
    return normal.unionByName(empty)


_S = f"{_E}, s AS (SELECT 'c' || id AS candidate_id, id, id % 6 <> 0 AS feasible, (v1 + 1) / 11 AS v1, v2 / 25 AS v2, v3 / 11 AS v3 FROM e), runs AS (SELECT 'm' || (id % 3) AS method_id, id % 2 AS search_seed, candidate_id FROM s UNION ALL SELECT 'none', 0, candidate_id FROM s WHERE id % 6 = 0), mem AS (SELECT * FROM runs JOIN s USING (candidate_id)), ok AS (SELECT * FROM mem WHERE feasible), own AS (SELECT * FROM ok b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE a.method_id = b.method_id AND a.search_seed = b.search_seed AND {_D3})), pool AS (SELECT DISTINCT v1, v2, v3 FROM (SELECT DISTINCT candidate_id, v1, v2, v3 FROM ok) b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE {_D3})), near AS (SELECT method_id, search_seed, pool.v1 AS x, pool.v2 AS y, pool.v3 AS z, min(greatest(pool.v1 - own.v1, pool.v2 - own.v2, pool.v3 - own.v3)) AS e, min(sqrt((pool.v1 - own.v1) ** 2 + (pool.v2 - own.v2) ** 2 + (pool.v3 - own.v3) ** 2)) AS d, max((own.v1 >= pool.v1 AND own.v2 >= pool.v2 AND own.v3 >= pool.v3)::INT) AS hit FROM own, pool GROUP BY ALL), marks AS (SELECT method_id, search_seed, max(e) AS epsilon, avg(d) AS igd, avg(hit) AS covered FROM near GROUP BY ALL)"


@query(f"WITH {_S}, c AS (SELECT method_id, search_seed, count(*) AS candidates, count(*) FILTER (feasible) AS feasible FROM mem GROUP BY ALL), f AS (SELECT method_id, search_seed, string_agg(candidate_id, ',' ORDER BY candidate_id) AS front FROM own GROUP BY ALL) SELECT c.*, coalesce(front, '') AS front, round(coalesce(covered, 0), 6) AS coverage, round(epsilon, 6) AS epsilon, round(igd, 6) AS igd FROM c LEFT JOIN f USING (method_id, search_seed) LEFT JOIN marks USING (method_id, search_seed)")
def run_front_metrics(spark, sf):
    """Each run's front against the pooled front."""
    r = reports.front_report(_scored(spark, sf), _runs(spark, sf), [0.0, 0.0, 0.0])
    return rounded(r.drop("hypervolume"), "coverage", "epsilon", "igd")


@query(f"WITH {_S}, g AS (SELECT DISTINCT method_id, search_seed FROM runs), e1 AS (SELECT method_id, search_seed, v1 AS l, lead(v1) OVER (PARTITION BY method_id, search_seed ORDER BY v1) AS u FROM (SELECT method_id, search_seed, v1 FROM own UNION SELECT method_id, search_seed, 0 FROM g)), e2 AS (SELECT method_id, search_seed, v2 AS l, lead(v2) OVER (PARTITION BY method_id, search_seed ORDER BY v2) AS u FROM (SELECT method_id, search_seed, v2 FROM own UNION SELECT method_id, search_seed, 0 FROM g)), e3 AS (SELECT method_id, search_seed, v3 AS l, lead(v3) OVER (PARTITION BY method_id, search_seed ORDER BY v3) AS u FROM (SELECT method_id, search_seed, v3 FROM own UNION SELECT method_id, search_seed, 0 FROM g)) SELECT g.method_id, g.search_seed, round(coalesce((SELECT sum((e1.u - e1.l) * (e2.u - e2.l) * (e3.u - e3.l)) FROM e1, e2, e3 WHERE e1.method_id = g.method_id AND e1.search_seed = g.search_seed AND e2.method_id = g.method_id AND e2.search_seed = g.search_seed AND e3.method_id = g.method_id AND e3.search_seed = g.search_seed AND EXISTS (SELECT 1 FROM own WHERE own.method_id = g.method_id AND own.search_seed = g.search_seed AND own.v1 >= e1.u AND own.v2 >= e2.u AND own.v3 >= e3.u)), 0), 6) AS hypervolume FROM g")
def run_hypervolumes(spark, sf):
    """Volume of each run's front."""
    r = reports.front_report(_scored(spark, sf), _runs(spark, sf), [0.0, 0.0, 0.0])
    return rounded(r.select("method_id", "search_seed", "hypervolume"), "hypervolume")


@query(f"WITH {_S}, x AS (SELECT * FROM s WHERE feasible) SELECT count(*) AS candidates, round(avg(feasible::INT), 6) AS feasible_rate, (SELECT count(*) FROM x b WHERE NOT EXISTS (SELECT 1 FROM x a WHERE {_D3})) AS front_size FROM s")
def frontier_summary(spark, sf):
    """Feasible share and front size of a pool."""
    return rounded(reports.frontier_summary(_scored(spark, sf)), "feasible_rate")


@query("SELECT n_name AS method_id, s AS search_seed FROM nation, (VALUES (3::BIGINT), (1), (2)) x(s) WHERE n_regionkey <> 2 OR s = 3")
def run_matrix(spark, sf):
    """Methods by seeds; a control runs once."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("method_id"), (F.col("n_regionkey") == 2).alias("control"))
    return reports.run_matrix(n, [3, 1, 2])


@query(f"WITH {outcomes_sql()}, t AS (SELECT DISTINCT task_id FROM o), s AS (SELECT * FROM (VALUES (17), (29), (43)) x(seed)) SELECT task_id, CAST(seed AS BIGINT) AS seed, sha256(task_id || chr(0) || 's' || chr(0) || 'id' || chr(0) || seed) AS block_id FROM t, s")
def runtime_blocks(spark, sf):
    """Blocks of tasks and seeds with their digests."""
    t = outcomes(spark, sf).select("task_id").distinct().withColumn("split_id", F.lit("s")).withColumn("objective_role", F.lit("id"))
    return reports.runtime_blocks(t, [17, 29, 43]).select("task_id", "seed", "block_id")


_SEL = "r AS (SELECT 'f' || (p_partkey % 3) AS path, p_partkey AS line, 'm' || (p_partkey % 4) AS method_id, p_partkey % 2 AS search_seed, 'c' || p_partkey AS candidate_id, CASE WHEN p_partkey % 50 = 0 THEN 'none' ELSE 'skill' END AS mode, p_brand || p_size AS content FROM part), q AS (SELECT *, first_value(candidate_id) OVER (PARTITION BY CASE WHEN mode = 'none' THEN 'no-skill' ELSE content END, mode ORDER BY path, line) AS canonical_id FROM r)"


def _selected(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return reports.selected(p.select(s("f", k % 3).alias("path"), k.alias("line"), s("m", k % 4).alias("method_id"), (k % 2).alias("search_seed"), s("c", k).alias("candidate_id"), F.when(k % 50 == 0, "none").otherwise("skill").alias("injection_mode"), F.concat("p_brand", F.col("p_size").cast("string")).alias("content_hash")))


@query(f"WITH {_SEL} SELECT candidate_id, canonical_id FROM q")
def selected_conditions(spark, sf):
    """One canonical id for each content and mode."""
    return _selected(spark, sf).select("candidate_id", "canonical_id")


@query(f"WITH {_SEL} SELECT DISTINCT method_id, search_seed, canonical_id AS candidate_id FROM q WHERE method_id IN ('m0', 'm1')")
def candidate_sets(spark, sf):
    """Candidates of the expected runs."""
    runs = reports.run_matrix(spark.createDataFrame([("m0", False), ("m1", False)], "method_id string, control boolean"), [0, 1])
    return reports.candidate_sets(_selected(spark, sf), runs)


@query(f"WITH {_SEL} SELECT DISTINCT method_id, search_seed, 'extra' AS problem FROM q WHERE method_id IN ('m2', 'm3') UNION ALL SELECT 'm1', 0::BIGINT, 'missing' UNION ALL SELECT 'm0', 1::BIGINT, 'missing'")
def run_problems(spark, sf):
    """Runs beside the declared matrix."""
    runs = reports.run_matrix(spark.createDataFrame([("m0", False), ("m1", False)], "method_id string, control boolean"), [0, 1])
    return reports.run_problems(_selected(spark, sf), runs)


@query("SELECT 'c' || s_suppkey AS candidate_id, string_agg(DISTINCT policy, ',' ORDER BY policy) AS policies FROM (SELECT s_suppkey % 9 AS s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'knee' WHEN 1 THEN 'min_tokens' ELSE 'max_transfer' END AS policy, s_acctbal > 0 AS defined FROM supplier) WHERE defined GROUP BY s_suppkey")
def deployment_union(spark, sf):
    """Candidates that some policy deploys."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    policy = F.when(F.col("s_nationkey") % 3 == 0, "knee").when(F.col("s_nationkey") % 3 == 1, "min_tokens").otherwise("max_transfer")
    return reports.deployed(s.select(F.concat(F.lit("c"), (F.col("s_suppkey") % 9).cast("string")).alias("candidate_id"), policy.alias("policy_id"), (F.col("s_acctbal") > 0).alias("defined")))


@query("SELECT coalesce(nullif(trim(CASE WHEN user_id % 4 = 0 THEN ' ' WHEN user_id % 4 = 1 THEN 'px' END), ''), 'standard') AS provider_id, count(*) AS provider_calls, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens FROM events GROUP BY 1")
def generation_usage(spark, sf):
    """Usage of generations with a default provider."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.select(F.when(F.col("user_id") % 4 == 0, " ").when(F.col("user_id") % 4 == 1, "px").alias("reported"), F.lit(None).cast("string").alias("configured"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return accounting.usage(e, accounting.provider_of("reported", "configured", "standard"))


@query("SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0")
def pin_problems(spark, sf):
    """Pinned files that are gone or differ."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"), "p_partkey")
    seen = p.where("p_partkey % 11 <> 0").withColumn("sha256", F.when(F.col("p_partkey") % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    return reports.pin_problems(p, seen)


@query(f"WITH {_E} SELECT DISTINCT v1, v2, v3 FROM e b WHERE NOT EXISTS (SELECT 1 FROM e a WHERE {_D3})")
def front_vectors(spark, sf):
    """Distinct vectors of the front."""
    return pareto.vectors(_pool(spark, sf))
