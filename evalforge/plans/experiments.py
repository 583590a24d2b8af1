"""Queries over whole experiments: matrices, proposals, identities, verifiers, roll-ups, and parts of the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import accounting, bootstrap, checks, controllers, finals, lineage, objectives, pareto, search, selection, verify
from ..sources import ledger, manifest
from ..sources.outcomes import KEY, outcomes, outcomes_sql
from .evaluation import CONSTRAINTS, OBJ_SQL, PAIRS_SQL, RANGES, VEC_SQL, pairs, points, rounded, vec
from .ledgers import events

QUERIES: dict = {}
SQL: dict[str, str] = {}
O = f"WITH {outcomes_sql()}"  # noqa: E741


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _targets(o):
    return o.select("target_id").distinct().select("target_id", F.lit("d").alias("domain_id"), F.when(F.col("target_id") == "t3", "most").otherwise("*").alias("task_group"), F.lit(None).cast("string").alias("split_id"), F.lit("id").alias("objective_role"))


def _blocks(o):
    return o.select("task_id", "seed").distinct().select("task_id", "seed", F.lit("d").alias("domain_id"), F.when(F.col("task_id") == "k7", "odd").otherwise("most").alias("group_id"), F.lit("s").alias("split_id"), F.lit(None).cast("string").alias("objective_role"))


@query(O + " SELECT count(*) AS cells FROM (SELECT DISTINCT target_id FROM o) t, (SELECT DISTINCT task_id, seed FROM o) b WHERE t.target_id <> 't3' OR b.task_id <> 'k7'")
def matrix_cells(spark, sf):
    """Size of the evaluation matrix of one candidate."""
    o = outcomes(spark, sf)
    return finals.matrix_size(_targets(o), _blocks(o))


@query(O + ", r AS (SELECT * FROM o WHERE NOT (candidate_id = 'c2' AND task_id = 'k1')) SELECT m.*, r.correct, CASE WHEN r.correct IS NULL THEN 'not_run' END AS problem FROM (SELECT DISTINCT candidate_id, target_id, task_id, seed FROM o) m LEFT JOIN r USING (candidate_id, target_id, task_id, seed)")
def executed_matrix(spark, sf):
    """The matrix with its recorded results; what was not run is marked."""
    o = outcomes(spark, sf)
    return controllers.executed(o.select(*KEY), o.where("not (candidate_id = 'c2' and task_id = 'k1')").select(*KEY, "correct"))


@query(f"WITH {PAIRS_SQL}, q AS (SELECT * FROM p WHERE NOT (candidate_id = 'c1' AND split = 'id') AND NOT (candidate_id = 'c4' AND grp = 'g2') UNION ALL SELECT * FROM p WHERE candidate_id = 'c6' AND task_id = 'k3') SELECT candidate_id, 'repeated_key' AS problem, concat_ws('/', target_id, task_id, seed) AS detail FROM q GROUP BY candidate_id, target_id, task_id, seed HAVING count(*) > 1 UNION ALL SELECT 'c1', 'missing_split', 'id' UNION ALL SELECT 'c4', 'missing_group', 'g2' UNION ALL SELECT DISTINCT candidate_id, 'missing_group', 'g9' FROM q UNION ALL SELECT DISTINCT candidate_id, 'extra_group', 'g4' FROM q")
def observation_problems(spark, sf):
    """What keeps a candidate's observations from being estimated."""
    p = pairs(spark, sf)
    q = p.where("not (candidate_id = 'c1' and split = 'id') and not (candidate_id = 'c4' and coalesce(grp, '') = 'g2')").unionByName(p.where("candidate_id = 'c6' and task_id = 'k3'"))
    return finals.observation_problems(q, ["g1", "g2", "g3", "g9"])


_CLUSTERS = PAIRS_SQL + """, b AS (SELECT candidate_id, target_id, task_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY candidate_id, target_id) AS size, count(*) AS n, sum(cc::INT) AS c, sum(bc::INT) AS b, sum((bc AND NOT cc)::INT) AS f, sum(tok) AS tok
  FROM p GROUP BY candidate_id, target_id, task_id WINDOW w AS (PARTITION BY candidate_id, target_id ORDER BY task_id)
), l AS (SELECT DISTINCT candidate_id, target_id, size, CAST(xor(('0x' || substr(sha256(candidate_id || chr(0) || target_id), 1, 16))::UBIGINT, 7::UBIGINT) AS VARCHAR) AS own FROM b
), d AS (SELECT candidate_id, target_id, r AS replicate, ('0x' || substr(md5(own || '|' || r || '|' || candidate_id || '/' || target_id || '|' || x), 1, 8))::BIGINT % size AS place, count(*) AS weight FROM l, generate_series(0, 39) g(r), generate_series(0, size - 1) h(x) GROUP BY ALL
), s AS (SELECT candidate_id, target_id, replicate, sum(weight * c) / sum(weight * n) AS accuracy, (sum(weight * c) - sum(weight * b)) / sum(weight * n) AS delta, sum(weight * f) / nullif(sum(weight * b), 0) AS regression, sum(weight * tok) / sum(weight * n) AS token_cost FROM b JOIN d USING (candidate_id, target_id, place) GROUP BY ALL)"""


@query(f"WITH {_CLUSTERS} SELECT candidate_id, target_id, " + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{n}" for m in finals.INTERVALS for n, q in (("low", 0.025), ("high", 0.975))) + " FROM s GROUP BY ALL")
def cluster_intervals(spark, sf):
    """Two-sided bounds by target, with tasks as clusters and a seed of its own for each."""
    names = [f"{m}_{n}" for m in finals.INTERVALS for n in ("low", "high")]
    return rounded(finals.cluster_intervals(pairs(spark, sf), 40, 7).select("candidate_id", "target_id", *names), *names)


@query(SQL["cluster_intervals"].replace("generate_series(0, 39)", "generate_series(0, 1999)"))
def cluster_intervals_full(spark, sf):
    """The same from as many replicates as the protocol's default."""
    names = [f"{m}_{n}" for m in finals.INTERVALS for n in ("low", "high")]
    return rounded(finals.cluster_intervals(pairs(spark, sf), 2000, 7).select("candidate_id", "target_id", *names), *names)


@query(f"WITH {OBJ_SQL} SELECT candidate_id, 0.0::DOUBLE AS accuracy_low, 1.0::DOUBLE AS accuracy_high, -1.0::DOUBLE AS delta_lcb, 1.0::DOUBLE AS delta_ucb, 0.0::DOUBLE AS token_cost_low, 999.0::DOUBLE AS token_cost_ucb, 1.0::DOUBLE AS regression_high FROM obj")
def wide_bounds(spark, sf):
    """Bounds of candidates with too few blocks: the whole range."""
    p = pairs(spark, sf)
    e = bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, 5, 1), objectives.block_counts(p), least_blocks=1_000_000, token_bound=999.0)
    return e.select("candidate_id", "accuracy_low", "accuracy_high", "delta_lcb", "delta_ucb", "token_cost_low", "token_cost_ucb", "regression_high")


_PROPOSALS = "e AS (SELECT user_id % 4 AS method, user_id % 3 AS search_seed, event_id % 3 = 0 AS accepted, event_id % 5 = 0 AS cache_hit, event_id % 97 AS input_tokens, event_id % 31 AS output_tokens FROM events)"


def _proposals(spark, sf):
    return events(spark, sf).selectExpr("user_id % 4 as method", "user_id % 3 as search_seed", "event_id % 3 = 0 as accepted", "event_id % 5 = 0 as cache_hit", "event_id % 97 as input_tokens", "event_id % 31 as output_tokens")


@query(f"WITH {_PROPOSALS} SELECT method, search_seed, count(*) AS proposals, count(*) FILTER (accepted) AS accepted, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS provider_calls, coalesce(sum(input_tokens) FILTER (NOT cache_hit), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (NOT cache_hit), 0)::BIGINT AS output_tokens FROM e GROUP BY ALL")
def proposal_accounting(spark, sf):
    """What each run's proposals cost."""
    return finals.proposal_accounting(_proposals(spark, sf), ["method", "search_seed"])


@query(f"WITH {_PROPOSALS} SELECT method, count(*) AS rows, 10::INT AS \"limit\" FROM e GROUP BY 1 HAVING count(*) > 10")
def over_budget(spark, sf):
    """Methods with more rows than their budget."""
    return finals.over_budget(_proposals(spark, sf), 10, ["method"])


@query("WITH t AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS task_id, 's' || l_linenumber % 3 AS split_id FROM lineitem) SELECT task_id, string_agg(split_id, ',' ORDER BY split_id) AS splits FROM t GROUP BY 1 HAVING count(*) > 1")
def split_drift(spark, sf):
    """Tasks that lie in several splits."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return finals.split_drift(li.select(F.col("l_partkey").cast("string").alias("task_id"), F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("split_id")))


@query(O + ", d AS (SELECT candidate_id, count(DISTINCT CASE WHEN candidate_id = 'c3' THEN task_id ELSE 'h' END) AS content_hash, count(DISTINCT CAST(CASE WHEN candidate_id = 'c5' THEN seed = 0 ELSE is_base END AS VARCHAR)) AS is_base FROM o GROUP BY 1) SELECT candidate_id, 'content_hash' AS \"column\", content_hash AS n FROM d WHERE content_hash > 1 UNION ALL SELECT candidate_id, 'is_base', is_base FROM d WHERE is_base > 1")
def candidate_drift(spark, sf):
    """Candidates with several contents or base flags."""
    o = outcomes(spark, sf).withColumn("content_hash", F.when(F.col("candidate_id") == "c3", F.col("task_id")).otherwise("h")).withColumn("is_base", F.when(F.col("candidate_id") == "c5", F.col("seed") == 0).otherwise(F.col("is_base")))
    return checks.varying(o, ["candidate_id"], ["content_hash", "is_base"])


@query(O + " SELECT candidate_id, target_id, task_id, seed, concat_ws(',', CASE WHEN task_id = 'k2' THEN 'empty_id' END, CASE WHEN seed = 1 AND task_id = 'k3' THEN 'tokens' END, CASE WHEN target_id = 't4' AND task_id = 'k4' THEN 'transfer_group' END) AS broken FROM (SELECT * REPLACE (CASE WHEN candidate_id = 'c1' THEN task_id ELSE 'zz' END AS task_id) FROM o) WHERE task_id IN ('k2') OR (seed = 1 AND task_id = 'k3') OR (target_id = 't4' AND task_id = 'k4')")
def broken_outcomes(spark, sf):
    """Rows that break a rule of their own."""
    o = outcomes(spark, sf).withColumn("task_id", F.when(F.col("candidate_id") == "c1", F.col("task_id")).otherwise("zz"))
    odd = o.withColumn("input_tokens", F.when((F.col("seed") == 1) & (F.col("task_id") == "k3"), -1).otherwise(F.col("input_tokens"))).withColumn("transfer_group", F.when((F.col("target_id") == "t4") & (F.col("task_id") == "k4"), "").otherwise(F.col("transfer_group")))
    odd = odd.withColumn("name", F.col("task_id")).withColumn("task_id", F.when(F.col("task_id") == "k2", "").otherwise(F.col("task_id")))
    return checks.bad_outcomes(odd).select("candidate_id", "target_id", F.col("name").alias("task_id"), "seed", F.array_join("broken", ",").alias("broken"))


@query("SELECT o_orderkey, o_totalprice / 1000 AS low, o_orderkey % 400 + 0.0 AS point, 300.0::DOUBLE AS high FROM orders WHERE o_orderkey % 400 > 350 OR o_totalprice / 1000 > 300 OR o_totalprice / 1000 < 0")
def broken_intervals(spark, sf):
    """Estimates out of range or order."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("low"), (F.col("o_orderkey") % 400 + 0.0).cast("double").alias("point"), F.lit(300.0).alias("high"))
    return checks.bad_intervals(o, "low", "point", "high", 0.0, 350.0)


@query("WITH u AS (SELECT p_partkey, [('p' || p_partkey % 7), ('p' || p_size % 9), ('p' || p_partkey % 3)] AS s FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN s IF x <> 'p7' AND x <> 'p8'])), ',') AS subset, CASE WHEN list_contains(s, 'p7') OR list_contains(s, 'p8') THEN 'unknown_patch' WHEN len(list_distinct(s)) < 3 THEN 'repeated_patch' END AS problem FROM u")
def canonical_subsets(spark, sf):
    """Subsets in the universe's order, with what is wrong with them."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    s = p.select("p_partkey", F.array(name(F.col("p_partkey") % 7), name(F.col("p_size") % 9), name(F.col("p_partkey") % 3)).alias("subset"))
    return search.canonical_subsets(s, search.patches(spark, [f"p{i}" for i in range(7)])).select("p_partkey", F.array_join("subset", ",").alias("subset"), "problem")


@query("WITH a AS (SELECT DISTINCT p_size % 40 AS k FROM part), s AS (SELECT p_size % 50 AS k FROM part WHERE p_size % 50 <> 7) SELECT coalesce('q' || a.k, 'q' || s.k) AS subset, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM a FULL JOIN (SELECT DISTINCT k FROM s) s ON a.k = s.k WHERE a.k IS NULL OR s.k IS NULL UNION ALL SELECT 'q' || k, 'repeated' FROM s GROUP BY k HAVING count(*) > 1")
def feedback_problems(spark, sf):
    """Scores that aren't exactly those asked for."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    one = lambda m: p.select(F.array(F.concat(F.lit("q"), (F.col("p_size") % m).cast("string"))).alias("subset"))
    return search.feedback_problems(one(40), one(50).where("subset[0] <> 'q7'"))


@query("WITH r AS (SELECT user_id AS request_fingerprint, min(event_id) % 5 AS fails, user_id % 3 AS retry_limit FROM events GROUP BY user_id) SELECT request_fingerprint, a::INT AS attempt_number, retry_limit, a <= retry_limit AS will_retry FROM r, generate_series(1, 3) g(a) WHERE a <= least(fails, retry_limit + 1)")
def retry_attempts(spark, sf):
    """Failure events of bounded retries."""
    r = events(spark, sf).groupBy(F.col("user_id").alias("request_fingerprint")).agg((F.min("event_id") % 5).alias("fails")).withColumn("retry_limit", F.col("request_fingerprint") % 3)
    return controllers.attempts(r)


_REQ = "r AS (SELECT o_orderkey, 'e1' AS experiment_id, o_orderpriority AS content_hash, 'k' || o_custkey AS task_id, o_custkey % 3 AS seed, CASE WHEN o_orderkey % 7 <> 0 THEN 't' || o_orderkey % 4 END AS target_id, o_orderstatus AS model_id, o_orderpriority AS payload FROM orders)"
_J = lambda c, quoted=True: f"'\"{c}\":' || coalesce(" + (f"'\"' || {c} || '\"'" if quoted else f"CAST({c} AS VARCHAR)") + ", 'null')"


def _requests(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", F.lit("e1").alias("experiment_id"), F.col("o_orderpriority").alias("content_hash"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("task_id"), (F.col("o_custkey") % 3).alias("seed"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string"))).alias("target_id"), F.col("o_orderstatus").alias("model_id"), F.col("o_orderpriority").alias("payload"))


@query(f"WITH {_REQ} SELECT o_orderkey, sha256('{{' || " + " || ',' || ".join(_J(c, c != "seed") for c in sorted(manifest.REQUEST)) + " || '}') AS cache_key FROM r")
def execution_keys(spark, sf):
    """Content-addressed keys of executions, in which names of candidates don't count."""
    return manifest.request_keys(_requests(spark, sf)).select("o_orderkey", "cache_key")


@query(f"WITH {_REQ}, q AS (SELECT *, 'c' || o_orderkey % 5 AS candidate_id, sha256(payload) AS payload_sha256 FROM r) SELECT o_orderkey, sha256('{{' || " + " || ',' || ".join(_J(c, c != "seed") for c in sorted(manifest.INVOCATION)) + " || '}') AS request_fingerprint FROM q")
def retry_fingerprints(spark, sf):
    """Digests of retried invocations; payloads count by their digests."""
    r = _requests(spark, sf).withColumn("candidate_id", F.concat(F.lit("c"), (F.col("o_orderkey") % 5).cast("string")))
    return manifest.invocations(r).select("o_orderkey", "request_fingerprint")


@query("SELECT p_brand, sha256(string_agg(path || chr(0) || sha || chr(0), '' ORDER BY path, sha)) AS sha256 FROM (SELECT p_brand, p_name || '/' || p_partkey AS path, sha256(p_type) AS sha FROM part) GROUP BY 1")
def tree_digests(spark, sf):
    """One digest of each tree of files."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return manifest.tree_digest(p.select("p_brand", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_type", 256).alias("sha256")), ["p_brand"])


@query("SELECT n_name AS target_id, CASE WHEN n_name IN ('BRAZIL', 'JAPAN') THEN 'id' WHEN n_name IN ('CHINA', 'INDIA', 'FRANCE') THEN 'transfer' WHEN n_regionkey = 4 THEN 'final' ELSE 'diagnostic' END AS objective_role, n_regionkey = 4 AS last FROM nation")
def target_roles(spark, sf):
    """Roles of targets by membership, then by phase."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("target_id"), F.when(F.col("n_regionkey") == 4, "final_only").otherwise("search").alias("phase"))
    t = manifest.roles(n, ["BRAZIL", "JAPAN"], ["CHINA", "INDIA", "FRANCE"])
    last = manifest.final_targets(t).select("target_id", F.lit(True).alias("l"))
    return t.join(last, "target_id", "left").select("target_id", "objective_role", F.coalesce("l", F.lit(False)).alias("last"))


@query("SELECT 's' || l_linenumber % 3 AS split_id, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1")
def tasks_of_split(spark, sf):
    """Tasks of one split, counted."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("split_id", F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")))
    return manifest.of_split(li, "s1").groupBy("split_id").agg(F.count("*").alias("n"))


@query("SELECT 'v' || s_suppkey AS candidate_id, sha256(s_name) AS content_hash, 'replace' AS injection_mode FROM supplier UNION ALL SELECT 'no_skill', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', 'none'")
def evaluation_candidates(spark, sf):
    """Versions as candidates, and the control without any."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return manifest.as_candidates(s.select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("version_id"), F.sha2("s_name", 256).alias("content_hash")))


@query(f"WITH {VEC_SQL} SELECT candidate_id FROM v b WHERE NOT EXISTS (SELECT 1 FROM v a WHERE a.accuracy >= b.accuracy AND -a.token_cost >= -b.token_cost AND (a.accuracy > b.accuracy OR -a.token_cost > -b.token_cost))")
def masked_front(spark, sf):
    """The front over two of the four objectives."""
    return pareto.front(objectives.maximised(points(spark, sf), ("token_cost", "accuracy"))).select("candidate_id")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, round(min(accuracy) OVER (), 6) AS lo_accuracy, round(max(accuracy) OVER (), 6) AS hi_accuracy, round(min(token_cost) OVER (), 6) AS lo_token_cost, round(max(token_cost) OVER (), 6) AS hi_token_cost FROM obj")
def pool_ranges(spark, sf):
    """Ranges of a pool, for normalisation without frozen ones."""
    names = ["lo_accuracy", "hi_accuracy", "lo_token_cost", "hi_token_cost"]
    return rounded(objectives.pool_ranges(points(spark, sf), ["accuracy", "token_cost"]).select("candidate_id", *names), *names)


_W = selection.dirichlet(4, 11)
_UNIT = ", ".join(f"({e} - {lo}) / {hi - lo} AS u{i}" for i, (e, (lo, hi)) in enumerate(zip(("accuracy", "transfer", "-token_cost", "-regression"), RANGES.values()), 1))


def _unit(spark, sf):
    v = vec(spark, sf)
    return v.withColumns({f"v{i}": (F.col(f"v{i}") - lo) / (hi - lo) for i, (lo, hi) in enumerate(RANGES.values(), 1)})


@query(f"WITH {VEC_SQL}, u AS (SELECT candidate_id, {_UNIT} FROM v) SELECT candidate_id FROM u ORDER BY round(greatest({', '.join(f'{w!r} * (1 - u{i})' for i, w in enumerate(_W, 1))}), 12), candidate_id LIMIT 1")
def chebyshev_parent(spark, sf):
    """The parent that random Chebyshev weights pick."""
    return selection.parent(_unit(spark, sf), 11).select("candidate_id")


@query(f"WITH {VEC_SQL}, u AS (SELECT candidate_id, accuracy AS x, (-token_cost + 200) / 200 AS y FROM v), k AS (SELECT a.candidate_id, greatest(0, (a.x - coalesce(max(b.x) FILTER (b.y >= a.y AND b.candidate_id <> a.candidate_id), 0)) * (a.y - coalesce(max(b.y) FILTER (b.x >= a.x AND b.candidate_id <> a.candidate_id), 0))) AS box, bool_or(b.candidate_id <> a.candidate_id AND b.x >= a.x AND b.y >= a.y) AS beaten, any_value(greatest(0.5 * (1 - a.x), 0.5 * (1 - a.y))) AS far FROM u a, u b GROUP BY a.candidate_id, a.x, a.y) SELECT candidate_id, (row_number() OVER (ORDER BY beaten, round(far, 12), candidate_id))::INT AS place FROM k QUALIFY place <= 3")
def contribution_order(spark, sf):
    """Those with a volume of their own first, then by their distance to the ideal."""
    d = points(spark, sf).select("candidate_id", F.col("accuracy").alias("v1"), ((-F.col("token_cost") + 200) / 200).alias("v2"))
    return selection.by_contribution(d, [0.5, 0.5], [0.0, 0.0], 3).select("candidate_id", "place")


@query(f"WITH {VEC_SQL}, ok AS (SELECT * FROM v WHERE NOT (accuracy + 1e-12 < 0.5 OR delta + 1e-12 < -0.05 OR token_cost - 1e-12 > 140)) SELECT candidate_id, (row_number() OVER (ORDER BY candidate_id))::INT AS place FROM ok b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE a.v1 + 1e-12 >= b.v1 AND a.v2 + 1e-12 >= b.v2 AND a.v3 + 1e-12 >= b.v3 AND a.v4 + 1e-12 >= b.v4 AND (a.v1 > b.v1 + 1e-12 OR a.v2 > b.v2 + 1e-12 OR a.v3 > b.v3 + 1e-12 OR a.v4 > b.v4 + 1e-12))")
def archive_selection(spark, sf):
    """What an archive with room for all selects."""
    return selection.archive_selection(objectives.feasibility(vec(spark, sf), CONSTRAINTS), 8).select("candidate_id", "place")


@query(f"WITH {OBJ_SQL} SELECT candidate_id, row_number() OVER (ORDER BY accuracy DESC, candidate_id)::INT AS place FROM obj QUALIFY place <= 2")
def capped_topk(spark, sf):
    """The most accurate, two at most though five are asked for."""
    return selection.capped(points(spark, sf), 5, 2).select("candidate_id", "place")


@query("SELECT 's' || s_suppkey AS candidate_id, row_number() OVER (ORDER BY s_suppkey)::INT AS place FROM supplier QUALIFY place <= 4")
def full_merge(spark, sf):
    """The first that came."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("candidate_id"), F.col("s_suppkey").alias("pos"))
    return selection.full_merge(s, 4).select("candidate_id", "place")


@query(O + " SELECT DISTINCT candidate_id, target_id FROM o WHERE candidate_id IN (SELECT 'c' || l_suppkey % 8 FROM lineitem WHERE l_suppkey % 8 > 4)")
def promotion_pool(spark, sf):
    """Rows of candidates that a controller kept."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey % 8 > 4").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 8).cast("string")).alias("candidate_id"))
    return controllers.promoted(outcomes(spark, sf).select("candidate_id", "target_id").distinct(), li)


@query("SELECT doc_id, md5(CASE WHEN (length(text) - length(replace(text, 'the and', ''))) / 7 = 1 THEN replace(text, 'the and', 'THE') END) AS replaced, coalesce(CAST((length(text) - length(replace(text, 'the and', ''))) / 7 AS INT), NULL) AS n FROM documents")
def replaced_once(spark, sf):
    """Exact replacement where the match occurs once."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(lineage.replace_once(F.col("text"), F.lit("the and"), F.lit("THE"))).alias("replaced"), canonical.occurrences(F.col("text"), F.lit("the and")).alias("n"))


@query("SELECT doc_id, contains(chr(10) || text || chr(10), chr(10) || split_part(text, chr(10), 2) || chr(10)) AS whole FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def whole_blocks(spark, sf):
    """Whether a line stands as a block of its own."""
    t = F.coalesce("text", F.lit(""))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.alias("text"))
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return d.select("doc_id", canonical.whole_block(doubled, F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))).alias("whole"))


@query("SELECT count(DISTINCT sha256(p_type)) AS contents, count(*) AS derivations FROM part")
def version_store(spark, sf):
    """Contents once, all derivations."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.sha2("p_type", 256).alias("content_hash"), F.col("p_type").alias("content"), F.col("p_partkey").alias("version_id"), F.lit(None).alias("parent_version_id"))
    contents, derived = lineage.store(p)
    return contents.agg(F.count("*").alias("contents")).join(derived.agg(F.count("*").alias("derivations")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 4 = 0 AS broken FROM events")
def fenced_json(spark, sf):
    """Values out of fenced JSON, and texts that are none."""
    e = events(spark, sf)
    fence = F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```\nmore"))
    twice = F.when(F.col("event_id") % 4 == 0, F.lit('{"a": 1, "a": 2}')).otherwise(F.col("props"))
    return e.select("event_id", verify.json_text(verify.fenced_json(fence), "$.k").alias("k"), F.try_parse_json(twice).isNull().alias("broken"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 3 = 1 THEN props WHEN event_id % 2 = 0 THEN event_type END END AS output, CASE WHEN event_id % 3 = 0 THEN 'no_record' WHEN event_id % 3 = 2 AND event_id % 2 <> 0 THEN 'no_output' END AS problem FROM events")
def replayed_generations(spark, sf):
    """Generations from records, and what is missing."""
    e = events(spark, sf)
    rec = e.where("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("props")).alias("model_output"), F.lit(None).cast("string").alias("raw_response"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("response_text"))
    return ledger.replayed_generations(e.select("event_id"), rec, "event_id")


@query("SELECT doc_id, true AS reported_correct, CASE WHEN lang = 'en' THEN contains(lower(coalesce(text, '')), 'the and') WHEN lang = 'fr' THEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' WHEN lang = 'de' THEN coalesce(regexp_full_match(source, 'src1[0-9]'), false) ELSE false END AS correct FROM documents")
def verified_scores(spark, sf):
    """Responses scored by the verifiers of their tasks."""
    specs = {"en": {"kind": "builtin", "rule": "contains", "expected": "the AND", "case_sensitive": False}, "fr": {"kind": "builtin", "rule": "nonempty"}, "de": {"kind": "builtin", "rule": "regex_fullmatch", "pattern": "src1[0-9]"}}
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("verifier_id"), F.when(F.col("lang") == "de", F.col("source")).otherwise(F.col("text")).alias("raw_response"), F.lit(True).alias("correct"))
    return manifest.scored(d, {k: manifest.Verifier.parse(v) for k, v in specs.items()}).select("doc_id", "reported_correct", "correct")


_RUNS = "r AS (SELECT 'm' || l_suppkey % 3 AS method_id, l_linenumber % 2 AS search_seed, 'k' || l_partkey % 90 AS task_id, l_suppkey % 2 = 0 AS correct, l_partkey % 90 AS tokens FROM lineitem)"


@query(f"WITH {_RUNS} SELECT task_id, min(correct) AS correct, min(tokens)::BIGINT AS tokens, string_agg(DISTINCT method_id || '/' || search_seed, ',' ORDER BY method_id || '/' || search_seed) AS runs, count(DISTINCT (correct, tokens)) - 1 AS conflicts FROM r GROUP BY 1")
def rolled_up_runs(spark, sf):
    """One ledger of all runs, with the runs that have each row."""
    r = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("method_id"), (F.col("l_linenumber") % 2).alias("search_seed"), F.concat(F.lit("k"), (F.col("l_partkey") % 90).cast("string")).alias("task_id"), (F.col("l_suppkey") % 2 == 0).alias("correct"), (F.col("l_partkey") % 90).cast("long").alias("tokens"))
    return finals.rolled_up(r, ["task_id"], ["correct", "tokens"])


@query("WITH r AS (SELECT 'c' || event_id AS parent_id, CASE WHEN user_id % 2 = 0 THEN 'cost' ELSE 'transfer' END AS direction, event_id % 9 AS turn FROM events), h AS (SELECT *, sha256(parent_id || '|' || direction || '|' || turn) AS h FROM r) SELECT substr(h, 1, 16) AS request_id, CASE WHEN ('0x' || substr(h, 1, 4))::BIGINT % 2 = 0 THEN 'add' ELSE 'rewrite' END AS operation, 'For ' || direction || ': note ' || substr(h, 5, 8) AS content FROM h")
def mock_proposals(spark, sf):
    """Made-up patches that the request decides."""
    e = events(spark, sf).select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("parent_id"), F.when(F.col("user_id") % 2 == 0, "cost").otherwise("transfer").alias("direction"), (F.col("event_id") % 9).alias("turn"))
    return manifest.mock_proposals(e)


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS payload FROM events")
def request_payloads(spark, sf):
    """What would be sent for a request."""
    return manifest.payloads(events(spark, sf), ["user_id", "event_type"]).select("event_id", "payload")


@query(O + " SELECT 'all' AS provider_id, count(*) AS provider_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM o")
def usage_of_all(spark, sf):
    """Usage of one configured provider."""
    return accounting.usage(outcomes(spark, sf), F.lit("all"))
