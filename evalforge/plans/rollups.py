"""Queries over a roll-up of runs that are derived from ``lineitem`` and ``orders``, some of them not what they say, and over configurations made of ``customer``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import configrules, rollup
from ..operators.configrules import Rule

QUERIES: dict = {}
SQL: dict[str, str] = {}
ID = "e1"


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def experiment(spark: SparkSession, sf: str) -> rollup.Experiment:
    """Six runs: one miscounts, one isn't complete, one is another experiment's; some candidates are unknown, some rows disagree."""
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 3).alias("m"), (F.col("l_linenumber") % 2).cast("long").alias("s"), (F.col("l_partkey") % 40).alias("a"), (F.col("l_orderkey") % 50).alias("b")).distinct()
    run = [text("m", F.col("m")).alias("method_id"), F.col("s").alias("search_seed")]
    c = text("c", F.col("a")).alias("candidate_id")
    outcomes = li.select(*run, c, text("t", F.col("a") % 5).alias("target_id"), text("k", F.col("b")).alias("task_id"), F.col("s").alias("seed"), (F.col("a") == 0).alias("is_base"), ((F.col("a") + F.col("b")) % 2 == 0).alias("correct"), (40 + F.col("a") + F.when((F.col("m") == 1) & (F.col("a") == 7) & (F.col("b") < 3), 1).otherwise(0)).cast("long").alias("input_tokens"), F.col("b").cast("long").alias("output_tokens"))
    each = li.select("m", "s", "a").distinct()
    candidates = each.where("a < 38").select(*run, c, F.sha2(text("c", F.col("a")), 256).alias("content_hash"), F.when(F.col("a") > 0, F.array(text("c", (F.col("a") * 2) % 45))).otherwise(F.array().cast("array<string>")).alias("parents"))
    archive = each.where("a % 10 = 0").select(*run, F.concat_ws("/", text("m", F.col("m")), F.col("s").cast("string")).alias("run_key"), c, F.array(F.col("a").cast("double"), F.lit(1.0)).alias("vector"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 3).alias("m"), (F.col("o_orderkey") % 2).cast("long").alias("s"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"))
    proposals = o.select(*run, text("p", F.col("k")).alias("event_id"), (F.col("u") % 2 == 0).alias("accepted"), (F.col("k") % 4 == 0).alias("cache_hit"), (F.col("k") % 30).cast("long").alias("input_tokens"), (F.col("u") % 20).cast("long").alias("output_tokens"))
    failures = o.where("k % 97 = 0").select(*run, text("f", F.col("k")).alias("event_id"), text("r", F.col("u")).alias("request_fingerprint"), (F.col("k") % 3).cast("long").alias("attempt_number"), (F.col("k") % 5 > 0).alias("will_retry"))
    tables = {"outcomes": outcomes, "candidates": candidates, "proposals": proposals, "failures": failures, "archive": archive}
    names = {n: F.count(F.when(F.col("n") == n, 1)) for n in tables}
    counts = None
    for n, t in tables.items():
        part = t.select("method_id", "search_seed", F.lit(n).alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    is_ = lambda m, s: (F.col("method_id") == m) & (F.col("search_seed") == s)
    said = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[x + F.when(is_("m1", 0) & F.lit(n == "outcomes"), 1).otherwise(0) if n == "outcomes" else x for n, x in names.items()]))
    some = counts.groupBy("method_id", "search_seed").agg(said.alias("rows"))
    states = some.select("method_id", "search_seed", F.when(is_("m2", 0), "other").otherwise(ID).alias("experiment_id"), (~is_("m2", 1)).alias("complete"), "rows", F.lit(40).cast("long").alias("proposed"), F.lit(38).cast("long").alias("screened"), F.lit(9).cast("long").alias("promoted"), F.lit(0).cast("long").alias("rejected"), F.lit(None).cast("long").alias("budget_limit"), (~is_("m0", 1)).alias("budget_complete"), F.array(F.lit("c1")).alias("selected"), F.array(F.lit("x"), F.concat("method_id", F.lit("y"))).alias("cache_keys"))
    expected = spark.range(8).select(text("m", F.floor(F.col("id") / 2)).alias("method_id"), (F.col("id") % 2).alias("search_seed"))
    return rollup.Experiment(ID, states, expected, tables)


_ALL = """WITH li AS (SELECT DISTINCT l_suppkey % 3 AS m, CAST(l_linenumber % 2 AS BIGINT) AS s, l_partkey % 40 AS a, l_orderkey % 50 AS b FROM lineitem),
o0 AS (SELECT 'm' || m AS method_id, s AS search_seed, 'c' || a AS candidate_id, 't' || (a % 5) AS target_id, 'k' || b AS task_id, s AS seed, a = 0 AS is_base, (a + b) % 2 = 0 AS correct, 40 + a + CASE WHEN m = 1 AND a = 7 AND b < 3 THEN 1 ELSE 0 END AS input_tokens, b AS output_tokens FROM li),
e0 AS (SELECT DISTINCT m, s, a FROM li),
c0 AS (SELECT 'm' || m AS method_id, s AS search_seed, 'c' || a AS candidate_id, CASE WHEN a > 0 THEN ['c' || ((a * 2) % 45)] ELSE [] END AS parents FROM e0 WHERE a < 38),
a0 AS (SELECT 'm' || m AS method_id, s AS search_seed, 'c' || a AS candidate_id FROM e0 WHERE a % 10 = 0),
od AS (SELECT 'm' || (o_custkey % 3) AS method_id, CAST(o_orderkey % 2 AS BIGINT) AS search_seed, o_orderkey AS k, o_custkey AS u FROM orders),
runs AS (SELECT DISTINCT method_id, search_seed FROM (SELECT method_id, search_seed FROM o0 UNION ALL SELECT method_id, search_seed FROM od)),
ex AS (SELECT 'm' || (i // 2) AS method_id, i % 2 AS search_seed FROM range(8) t(i)),
tk AS (SELECT * FROM runs WHERE method_id <> 'm2'),
o AS (SELECT o0.* FROM o0 SEMI JOIN tk USING (method_id, search_seed)), c AS (SELECT c0.* FROM c0 SEMI JOIN tk USING (method_id, search_seed)), ar AS (SELECT a0.* FROM a0 SEMI JOIN tk USING (method_id, search_seed)), pr AS (SELECT od.* FROM od SEMI JOIN tk USING (method_id, search_seed))
"""


@query(_ALL + """SELECT method_id, search_seed, problem, detail, problem NOT IN ('missing_run', 'unexpected_run', 'incomplete_run', 'other_experiment') AS fatal FROM (
SELECT method_id, search_seed, 'missing_run' AS problem, NULL AS detail FROM ex ANTI JOIN runs USING (method_id, search_seed)
UNION ALL SELECT method_id, search_seed, 'unexpected_run', NULL FROM runs ANTI JOIN ex USING (method_id, search_seed)
UNION ALL SELECT method_id, search_seed, 'incomplete_run', NULL FROM runs WHERE method_id = 'm2' AND search_seed = 1
UNION ALL SELECT method_id, search_seed, 'other_experiment', 'other' FROM runs WHERE method_id = 'm2' AND search_seed = 0
UNION ALL SELECT method_id, search_seed, 'row_count', 'outcomes:' || (count(*) + 1) || '/' || count(*) FROM o WHERE method_id = 'm1' AND search_seed = 0 GROUP BY ALL
UNION ALL SELECT min({'m': method_id, 's': search_seed}).m, min({'m': method_id, 's': search_seed}).s, 'conflict', 'outcomes:' || candidate_id || '/' || target_id || '/' || task_id || '/' || seed FROM o GROUP BY candidate_id, target_id, task_id, seed HAVING count(DISTINCT input_tokens) > 1
UNION ALL SELECT DISTINCT method_id, search_seed, 'unknown_candidate', 'outcomes:' || candidate_id FROM o WHERE NOT is_base AND candidate_id NOT IN (SELECT candidate_id FROM c)
UNION ALL SELECT DISTINCT method_id, search_seed, 'unknown_candidate', 'archive:' || candidate_id FROM ar WHERE candidate_id NOT IN (SELECT candidate_id FROM c)
UNION ALL SELECT DISTINCT method_id, search_seed, 'unknown_parent', 'candidates:' || x FROM (SELECT method_id, search_seed, unnest(parents) AS x FROM c) WHERE x NOT IN (SELECT candidate_id FROM c))""")
def rollup_problems(spark, sf) -> DataFrame:
    """What keeps runs out of a roll-up, and what stops it."""
    return rollup.problems(experiment(spark, sf))


@query(_ALL + ", mo AS (SELECT candidate_id, target_id, task_id, seed, min({'b': is_base, 'c': correct, 'i': input_tokens, 'o': output_tokens}) AS p FROM o GROUP BY ALL) SELECT (SELECT count(*) FROM tk) AS runs, (SELECT coalesce(bool_and(method_id || search_seed IN (SELECT method_id || search_seed FROM tk)), false) FROM ex) AS matrix_complete, false AS budget_complete, count(*) FILTER (NOT p.b) AS rows, CAST(sum(p.i + p.o) FILTER (NOT p.b) AS BIGINT) AS tokens, (SELECT count(*) FROM pr) AS proposals, (SELECT count(*) FROM pr WHERE k % 4 <> 0) AS calls, (SELECT CAST(sum(k % 30 + u % 20) AS BIGINT) FROM pr WHERE k % 4 <> 0) AS proposal_tokens, (SELECT count(*) FROM pr WHERE k % 97 = 0) AS failures, (SELECT 1 + count(DISTINCT method_id) FROM tk) AS cache_keys FROM mo")
def rollup_totals(spark, sf) -> DataFrame:
    """What all runs that count took, each row once."""
    return rollup.totals(experiment(spark, sf))


@query(_ALL + "SELECT method_id, search_seed, x.m IS NOT NULL AS expected, t.m IS NOT NULL AS complete, coalesce(t.m IS NOT NULL AND NOT (t.method_id = 'm0' AND t.search_seed = 1), false) AS budget_complete FROM (SELECT *, method_id AS m FROM ex) x FULL JOIN (SELECT *, method_id AS m FROM tk) t USING (method_id, search_seed)")
def rollup_matrix(spark, sf) -> DataFrame:
    """Which runs are expected, complete, and within their budget."""
    return rollup.matrix(experiment(spark, sf))


def _ledger(part: rollup.Ledger, spark, sf) -> DataFrame:
    return rollup.merged(experiment(spark, sf), part)


merged_outcomes = partial(_ledger, rollup.OUTCOMES)
merged_outcomes.__name__, merged_outcomes.__doc__ = "rollup_outcomes", "The merged ledger of outcomes, with the runs that have each row."
query(_ALL + "SELECT candidate_id, target_id, task_id, seed, min({'a': is_base, 'b': correct, 'c': input_tokens, 'd': output_tokens}).a AS is_base, min({'a': is_base, 'b': correct, 'c': input_tokens, 'd': output_tokens}).b AS correct, min({'a': is_base, 'b': correct, 'c': input_tokens, 'd': output_tokens}).c AS input_tokens, min({'a': is_base, 'b': correct, 'c': input_tokens, 'd': output_tokens}).d AS output_tokens, array_to_string(list_sort(list(DISTINCT method_id || '/' || search_seed)), ',') AS runs FROM o GROUP BY candidate_id, target_id, task_id, seed")(merged_outcomes)


_RULES = [
    Rule("total", "sum", "limits.total", terms=("limits.low", "limits.high")),
    Rule("nation", "refers", "nation", other="nations"),
    Rule("seeds", "unique", "seeds", low=3),
    Rule("segment", "value", "segment", ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    Rule("limits.*", "range", "limits.*", ("integer",), low=0, high=9),
    Rule("extra", "absent", "extra", when="segment", is_=("MACHINERY",)),
]


@query("""SELECT 'c' || c_custkey AS config_id, rule, "at", problem FROM customer JOIN (VALUES ('total', '', 'sum'), ('nation', '', 'refers'), ('seeds', '', 'unique'), ('segment', '', 'value'), ('limits.*', 'total', 'range'), ('extra', '', 'absent')) r(rule, "at", problem) ON CASE rule
  WHEN 'total' THEN c_custkey % 11 = 0 WHEN 'nation' THEN c_nationkey >= 20 WHEN 'seeds' THEN c_custkey % 3 = c_custkey % 4 WHEN 'segment' THEN c_mktsegment NOT IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
  WHEN 'limits.*' THEN c_custkey % 7 + c_custkey % 5 + (c_custkey % 11 = 0)::INT > 9 ELSE c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 END""")
def config_problems(spark, sf) -> DataFrame:
    """What breaks the rules in a configuration for each customer."""
    k = F.col("c_custkey")
    total = k % 7 + k % 5 + (k % 11 == 0).cast("int")
    config = F.struct((k % 7).alias("low"), (k % 5).alias("high"), total.alias("total")).alias("limits")
    nations = F.struct(*[F.struct(F.lit(1).alias("known")).alias(f"n{i}") for i in range(20)]).alias("nations")
    whole = F.to_json(F.struct(config, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), nations, F.array(k % 3, k % 4, F.lit(5).cast("long")).alias("seeds"), F.col("c_mktsegment").alias("segment"), F.when(k % 2 == 0, "x").alias("extra")))
    configs = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("c"), k.cast("string")).alias("config_id"), whole.alias("json"))
    return configrules.problems(configs, _RULES)
