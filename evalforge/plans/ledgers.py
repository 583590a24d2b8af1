"""Queries over ledgers: accounting, dedup, roles, inference, verifiers, lineage and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import accounting, archive, dedup, inference, lineage, objectives, verify
from ..sources import ledger
from ..sources.outcomes import outcomes, outcomes_sql
from .evaluation import OBJ_SQL, PAIRS_SQL, _D3, _E, _pool, pairs, rounded

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


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


_USE = f"{O}, t AS (SELECT * FROM (VALUES ('t0', 'pa'), ('t1', 'pb'), ('t2', ' '), ('t3', 'pc')) x(target_id, configured)), u AS (SELECT coalesce(CASE WHEN o.seed = 2 AND o.target_id = 't1' THEN 'pd' END, nullif(trim(configured), ''), 'solo') AS provider_id, input_tokens, output_tokens FROM o LEFT JOIN t USING (target_id)), g AS (SELECT provider_id, count(*) AS provider_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM u GROUP BY 1)"
_COST = _USE + ", pr AS (SELECT * FROM (VALUES ('pa', 'USD', 2.0, 8.0), ('pb', 'USD', 0.5, 1.5), ('pc', 'EUR', 1.0, 3.0), ('solo', 'USD', 0.25, 1.0)) x(provider_id, currency, pi, po)), c AS (SELECT g.*, currency, currency IS NOT NULL AS price_defined, (input_tokens * pi + output_tokens * po) / 1e6 AS cost FROM g LEFT JOIN pr USING (provider_id))"


def _usage(spark, sf):
    o = outcomes(spark, sf)
    t = spark.createDataFrame([("t0", "pa"), ("t1", "pb"), ("t2", " "), ("t3", "pc")], "target_id string, configured string")
    o = o.join(F.broadcast(t), "target_id", "left").withColumn("reported", F.when((F.col("seed") == 2) & (F.col("target_id") == "t1"), "pd"))
    return accounting.usage(o, accounting.provider_of("reported", "configured", "solo"))


def _costs(spark, sf):
    prices = spark.createDataFrame([("pa", "USD", 2.0, 8.0), ("pb", "USD", 0.5, 1.5), ("pc", "EUR", 1.0, 3.0), ("solo", "USD", 0.25, 1.0)], "provider_id string, currency string, input_per_million double, output_per_million double")
    return accounting.costs(_usage(spark, sf), prices)


@query(_USE + " SELECT * FROM g")
def usage_by_provider(spark, sf):
    """Calls and tokens by provider."""
    return _usage(spark, sf)


@query(_COST + " SELECT provider_id, provider_calls, input_tokens + output_tokens AS total_tokens, currency, price_defined, round(cost, 6) AS monetary_cost FROM c")
def cost_reconciliation(spark, sf):
    """Costs with unknown prices left undefined."""
    return rounded(_costs(spark, sf).select("provider_id", "provider_calls", "total_tokens", "currency", "price_defined", "monetary_cost"), "monetary_cost")


@query(_COST + " SELECT currency, round(sum(cost), 6) AS total FROM c WHERE price_defined GROUP BY 1")
def currency_totals(spark, sf):
    """Costs by currency."""
    return rounded(accounting.currency_totals(_costs(spark, sf)), "total")


@query(_COST + " SELECT bool_and(price_defined) AS all_prices_defined, count(DISTINCT currency) AS currencies, NULL::DOUBLE AS total, NULL::VARCHAR AS currency FROM c")
def cost_total(spark, sf):
    """A single total only where all prices are defined in one currency."""
    return accounting.cost_total(_costs(spark, sf))


_LEDGER = f"{O}, a AS (SELECT candidate_id, target_id, task_id, seed, correct, input_tokens FROM o WHERE seed < 2 UNION ALL SELECT candidate_id, target_id, task_id, seed, correct, input_tokens + (task_id = 'k4')::INT FROM o WHERE seed > 0)"


def _two_ledgers(spark, sf):
    o = outcomes(spark, sf).select("candidate_id", "target_id", "task_id", "seed", "correct", "input_tokens")
    return [o.where("seed < 2"), o.where("seed > 0").withColumn("input_tokens", F.col("input_tokens") + F.when(F.col("task_id") == "k4", 1).otherwise(0))]


@query(_LEDGER + " SELECT candidate_id, target_id, task_id, seed, min(correct) AS correct, min(input_tokens) AS input_tokens, count(*) AS copies, count(DISTINCT (correct, input_tokens)) - 1 AS conflicts FROM a GROUP BY 1, 2, 3, 4")
def merge_ledgers(spark, sf):
    """Union of two ledgers by key, with conflicting payloads counted."""
    return accounting.merged(_two_ledgers(spark, sf), ["candidate_id", "target_id", "task_id", "seed"], ["correct", "input_tokens"])


@query(_LEDGER + " SELECT candidate_id, target_id, task_id, seed FROM a GROUP BY ALL HAVING count(DISTINCT (correct, input_tokens)) > 1")
def ledger_conflicts(spark, sf):
    """Keys with two payloads."""
    keys = ["candidate_id", "target_id", "task_id", "seed"]
    return accounting.merged(_two_ledgers(spark, sf), keys, ["correct", "input_tokens"]).where("conflicts > 0").select(*keys)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_seen(spark, sf):
    """The first event of each user."""
    return accounting.first_seen(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(O + " SELECT candidate_id, count(*) AS n FROM o WHERE NOT (seed = 1 AND target_id IN ('t0', 't2')) GROUP BY 1")
def incremental_rows(spark, sf):
    """Rows of the full matrix that the screen hasn't paid for."""
    o = outcomes(spark, sf)
    key = ["candidate_id", "target_id", "task_id", "seed"]
    return accounting.incremental(o, o.where("seed = 1 and target_id in ('t0', 't2')"), key).groupBy("candidate_id").agg(F.count("*").alias("n"))


_RETRY = "r AS (SELECT user_id AS request_fingerprint, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt_number, 1 + user_id % 5 AS retry_limit, event_id FROM events)"


def _retries(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = events(spark, sf).select(F.col("user_id").alias("request_fingerprint"), n.alias("attempt_number"), (1 + F.col("user_id") % 5).alias("retry_limit"), "event_id")
    return e.withColumn("will_retry", F.when(F.col("event_id") % 97 == 0, True).otherwise(F.col("attempt_number") <= F.col("retry_limit")))


@query(f"WITH {_RETRY} SELECT request_fingerprint, attempt_number::INT AS attempt_number FROM r WHERE event_id % 97 = 0 AND NOT attempt_number <= retry_limit")
def retry_violations(spark, sf):
    """Failure events that break their retry rule."""
    return accounting.retry_events(_retries(spark, sf)).select("request_fingerprint", "attempt_number")


@query(f"WITH {_RETRY}, x AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN true ELSE attempt_number <= retry_limit END AS w FROM r) SELECT request_fingerprint, count(*) AS events, max(attempt_number)::INT AS attempts FROM x GROUP BY 1 HAVING NOT arg_max(w, attempt_number)")
def retry_exhausted(spark, sf):
    """Requests that gave up."""
    return accounting.exhausted(_retries(spark, sf))


@query(O + ", s AS (SELECT DISTINCT candidate_id FROM o), a AS (SELECT * FROM (VALUES ('c1'), ('c4'), ('c7'), ('zz')) x(candidate_id)) SELECT count(*) AS n, count(*) FILTER (a.candidate_id IS NULL) AS lost, round(count(*) FILTER (a.candidate_id IS NULL) / count(*), 6) AS rate FROM s LEFT JOIN a USING (candidate_id)")
def false_admission(spark, sf):
    """Share of screened candidates that the archive lacks."""
    a = spark.createDataFrame([("c1",), ("c4",), ("c7",), ("zz",)], "candidate_id string")
    return rounded(accounting.false_admission(outcomes(spark, sf), a), "rate")


@query(O + ", s AS (SELECT DISTINCT candidate_id FROM o WHERE candidate_id <> 'c5'), v AS (SELECT DISTINCT candidate_id FROM o WHERE candidate_id > 'c2') SELECT count(*) AS n, count(*) FILTER (candidate_id NOT IN ('c4', 'c7')) AS lost, string_agg(candidate_id, ',' ORDER BY candidate_id) FILTER (candidate_id NOT IN ('c4', 'c7')) AS lost_ids, round(count(*) FILTER (candidate_id NOT IN ('c4', 'c7')) / count(*), 6) AS rate FROM s JOIN v USING (candidate_id)")
def false_admission_validated(spark, sf):
    """The same over candidates that were validated."""
    o = outcomes(spark, sf)
    a = spark.createDataFrame([("c4",), ("c7",)], "candidate_id string")
    return rounded(accounting.validated_false_admission(o.where("candidate_id <> 'c5'"), o.where("candidate_id > 'c2'"), a), "rate")


_POOL2 = "e AS (SELECT s_suppkey AS id, s_suppkey % 4 AS run, round(s_acctbal / 1000) AS v1, CAST((s_suppkey * 37) % 23 AS DOUBLE) AS v2 FROM supplier)"


@query(f"WITH {_POOL2}, s AS (SELECT *, 'c' || (id % 20) AS cid, sum(40) OVER (PARTITION BY run ORDER BY id) AS spent FROM e), k AS (SELECT * FROM (VALUES (100), (400), (900), (2000)) x(cp)), l AS (SELECT s.run, cp, cid, arg_max(v1, id) AS v1, arg_max(v2, id) AS v2, arg_max(id, id) AS id FROM s JOIN k ON spent <= cp GROUP BY ALL), f AS (SELECT run, cp, v1, v2 FROM l WHERE id % 3 <> 0 AND v1 >= -2 AND v2 >= -1), w AS (SELECT DISTINCT run, cp, v1, max(v2) OVER (PARTITION BY run, cp ORDER BY v1 DESC) AS top FROM f), g AS (SELECT run, cp, sum((v1 - nxt) * (top + 1)) AS hv FROM (SELECT *, coalesce(lead(v1) OVER (PARTITION BY run, cp ORDER BY v1 DESC), -2) AS nxt FROM w) GROUP BY ALL) SELECT CAST(r.run AS VARCHAR) AS run_id, CAST(k.cp AS BIGINT) AS checkpoint, (SELECT count(*) FROM l WHERE l.run = r.run AND l.cp = k.cp) AS candidates, round(coalesce(g.hv, 0), 6) AS hypervolume, r.total >= k.cp AS reached FROM (SELECT run, max(spent) AS total FROM s GROUP BY run) r CROSS JOIN k LEFT JOIN g ON g.run = r.run AND g.cp = k.cp")
def budget_curve(spark, sf):
    """Volume of what was known at each budget checkpoint."""
    e = _pool(spark, sf).select(F.col("run").cast("string").alias("run_id"), F.col("id").alias("pos"), F.lit(40).alias("cost"), F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("candidate_id"), (F.col("id") % 3 != 0).alias("feasible"), "v1", "v2")
    return rounded(accounting.budget_curve(e, [100, 400, 900, 2000], [-2.0, -1.0]), "hypervolume")


_TARGETS = "t AS (SELECT 't' || c_custkey AS target_id, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS excluded, CASE WHEN c_custkey % 7 = 0 THEN 'transfer' END AS override, CASE c_custkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'transfer' WHEN 2 THEN 'other' END AS role, CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey % 6 END AS transfer_group, CASE WHEN c_custkey % 11 = 0 THEN 'mine' END AS declared_group, 's' || round(c_acctbal)::INT AS signature, CASE c_custkey % 13 WHEN 0 THEN true WHEN 1 THEN false END AS reuse FROM customer)"


def _targets(spark, sf):
    """Customers as targets, with all combinations of what may be declared."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return c.select(
        text("t", k).alias("target_id"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("excluded"), F.when(k % 7 == 0, "transfer").alias("override"), F.when(k % 4 == 0, "id").when(k % 4 == 1, "transfer").when(k % 4 == 2, "other").alias("role"),
        F.when(k % 3 == 0, text("g", k % 6)).alias("transfer_group"), F.when(k % 11 == 0, "mine").alias("declared_group"), text("s", F.round("c_acctbal").cast("int")).alias("signature"), F.when(k % 13 == 0, True).when(k % 13 == 1, False).alias("reuse"),
    )


_ROLES = "CASE WHEN coalesce(excluded, false) THEN 'diagnostic' ELSE coalesce(override, CASE WHEN role IN ('id', 'transfer', 'diagnostic') THEN role END, CASE WHEN transfer_group IS NOT NULL THEN 'transfer' END) END"


@query(f"WITH {_TARGETS} SELECT target_id, {_ROLES} AS role FROM t")
def role_resolution(spark, sf):
    """Final roles of targets by precedence."""
    return dedup.roles(_targets(spark, sf))


_GROUPS = "coalesce(declared_group, CASE WHEN max(coalesce(reuse, false)) OVER (PARTITION BY signature) THEN 'shared:' || sha256(signature) END, 'target:' || target_id)"


@query(f"WITH {_TARGETS} SELECT target_id, {_GROUPS} AS execution_group FROM t")
def execution_groups(spark, sf):
    """Targets that share their executions."""
    return dedup.execution_groups(_targets(spark, sf))


def _final_rows(spark, sf):
    """t9 repeats the execution of t0, once with another outcome."""
    o = outcomes(spark, sf).withColumn("content_hash", F.sha2("candidate_id", 256))
    again = o.where("target_id = 't0'").withColumn("target_id", F.lit("t9")).withColumn("input_tokens", F.col("input_tokens") + F.when((F.col("task_id") == "k8") & (F.col("seed") == 1), 1).otherwise(0))
    rows = o.unionByName(again)
    role = F.when(F.col("target_id") == "t0", "id").when(F.col("target_id") == "t9", "diagnostic").otherwise("transfer")
    return rows.withColumn("role", role).withColumn("execution_group", F.when(F.col("target_id").isin("t0", "t9"), "shared").otherwise(F.col("target_id")))


_FINAL = f"{O}, f AS (SELECT * FROM (SELECT candidate_id, target_id, task_id, seed, input_tokens FROM o UNION ALL SELECT candidate_id, 't9', task_id, seed, input_tokens + (task_id = 'k8' AND seed = 1)::INT FROM o WHERE target_id = 't0'))"


@query(_FINAL + " SELECT target_id, count(*) AS n FROM f WHERE target_id <> 't9' GROUP BY 1")
def overlap_dedup(spark, sf):
    """Overlapping executions once, id before transfer before diagnostic."""
    return dedup.overlap_dedup(_final_rows(spark, sf)).groupBy("target_id").agg(F.count("*").alias("n"))


@query(O + " SELECT candidate_id, task_id, seed, 'shared' AS execution_group, 'conflicting_outcomes' AS problem FROM o WHERE target_id = 't0' AND task_id = 'k8' AND seed = 1")
def overlap_violations(spark, sf):
    """Overlaps that disagree."""
    return dedup.overlap_violations(_final_rows(spark, sf)).select("candidate_id", "task_id", "seed", "execution_group", "problem")


@query("SELECT p_partkey AS pos, row_number() OVER w = 1 AS accepted, CASE WHEN row_number() OVER w > 1 THEN first_value('c' || p_partkey) OVER w END AS original FROM part WINDOW w AS (PARTITION BY p_brand || p_type || p_size ORDER BY p_partkey)")
def content_dedup(spark, sf):
    """Repeats of a content with the candidate that came first."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("candidate_id"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("content_hash"))
    return dedup.content_dedup(p).select("pos", "accepted", "original")


_METRIC = "m AS (SELECT 'm' || (l_suppkey % 6) AS method_id, l_linenumber % 5 AS search_seed, (sum(l_partkey) % 97)::DOUBLE AS value FROM lineitem GROUP BY ALL)"


def _metrics(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("method_id"), (F.col("l_linenumber") % 5).alias("search_seed")).agg((F.sum("l_partkey") % 97).cast("double").alias("value"))


_FLIP = f"WITH {_METRIC}, d AS (SELECT c.method_id AS comparison, c.search_seed, t.value - c.value AS d FROM m t JOIN m c USING (search_seed) WHERE t.method_id = 'm0' AND c.method_id <> 'm0'), s AS (SELECT comparison, m.mask, abs(sum(CASE WHEN (m.mask >> search_seed) & 1 = 1 THEN d ELSE -d END) / 5) AS stat FROM d, generate_series(0, 31) m(mask) GROUP BY ALL), b AS (SELECT comparison, avg(d) AS mean FROM d GROUP BY 1), p AS (SELECT comparison, mean, count(*) FILTER (stat + 1e-15 >= abs(mean)) / 32 AS p FROM s JOIN b USING (comparison) GROUP BY ALL)"


@query(_FLIP + " SELECT comparison, round(mean, 6) AS mean, round(p, 6) AS p FROM p")
def sign_flip(spark, sf):
    """Exact sign-flip p of each contrast over five seeds."""
    c = inference.seed_contrasts(_metrics(spark, sf), "m0", [f"m{i}" for i in range(1, 6)], list(range(5)))
    return rounded(c.select("comparison", "mean", "p"), "mean", "p")


_NATIONS = "d AS (SELECT c_nationkey AS k, (count(*) FILTER (c_custkey % 2 = 0) - count(*) FILTER (c_custkey % 2 = 1) + sum(c_custkey) % 7)::DOUBLE AS d FROM customer GROUP BY 1), l AS (SELECT list(d ORDER BY k) AS d FROM d), z AS (SELECT d, len(d) AS n, len(d) // 2 AS h FROM l)"
_HALF = "list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN d[{at} + i] ELSE -d[{at} + i] END))"


@query(f"WITH {_NATIONS}, a AS (SELECT {_HALF.format(n='h', at='0')} AS s, n, abs(list_sum(d)) AS seen FROM z, range((1 << h)::BIGINT) t(m)), b AS (SELECT {_HALF.format(n='n - h', at='h')} AS s FROM z, range((1 << (n - h))::BIGINT) t(m)), x AS (SELECT s, n, seen, count(*) AS k FROM a GROUP BY ALL), y AS (SELECT s, count(*) AS k FROM b GROUP BY ALL) SELECT any_value(n) AS differences, round(sum(CASE WHEN abs(x.s + y.s) >= seen THEN x.k * y.k ELSE 0 END) / pow(2, any_value(n)), 9) AS p FROM x, y")
def sign_flip_nations(spark, sf):
    """Exact p of as many differences as there are nations: half sums that meet in the middle."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    d = c.groupBy("c_nationkey").agg((F.count_if(F.col("c_custkey") % 2 == 0) - F.count_if(F.col("c_custkey") % 2 == 1) + F.sum("c_custkey") % 7).cast("double").alias("d"))
    one = d.agg(F.transform(F.array_sort(F.collect_list(F.struct("c_nationkey", "d"))), lambda x: x["d"]).alias("d"))  # one number a nation
    return one.select(F.size("d").cast("long").alias("differences"), F.round(inference.sign_flip_p("d"), 9).alias("p"))


@query(_FLIP + ", h AS (SELECT *, least(1, (5 - row_number() OVER (ORDER BY p, comparison) + 1) * p) AS step FROM p) SELECT comparison, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING), 6) AS holm FROM h")
def holm(spark, sf):
    """Holm's step-down over the family."""
    c = inference.seed_contrasts(_metrics(spark, sf), "m0", [f"m{i}" for i in range(1, 6)], list(range(5)))
    return rounded(c.select("comparison", "p", "holm"), "p", "holm")


@query(_FLIP + " SELECT comparison, CASE WHEN comparison <> 'm3' THEN round(p, 6) END AS p, NULL::DOUBLE AS holm, (CASE WHEN comparison = 'm3' THEN 1 ELSE 0 END)::BIGINT AS missing FROM p")
def seed_contrasts(spark, sf):
    """A family with one undefined contrast has no adjusted p at all."""
    m = _metrics(spark, sf).where("not (method_id = 'm3' and search_seed = 2)")
    c = inference.seed_contrasts(m, "m0", [f"m{i}" for i in range(1, 6)], list(range(5)))
    return rounded(c.select("comparison", "p", "holm", "missing"), "p")


@query("SELECT doc_id, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '', false) AS nonempty, coalesce(contains(lower(text), 'and the'), false) AS contains, coalesce(regexp_full_match(text, '[A-Z][^0-9]*'), false) AS matches, coalesce(lower(trim(lang)) = 'en', false) AS exact FROM documents")
def verify_text(spark, sf):
    """String predicates over whole texts."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = F.col("text")
    return d.select("doc_id", verify.nonempty(t).alias("nonempty"), verify.contains(t, "AND the", True).alias("contains"), verify.full_match(t, "[A-Z][^0-9]*").alias("matches"), verify.exact(F.col("lang"), " EN", True, True).alias("exact"))


@query("SELECT event_id, coalesce(abs(try_cast(json_extract_string(props, '$.k') AS DOUBLE) - 50) <= 10, false) AS near, coalesce(json_extract_string(props, '$.k') = '42', false) AS field, event_id % 3 = 0 AS flag, sha256(props) = sha256(props) AS same FROM events")
def verify_json(spark, sf):
    """JSON path predicates."""
    e = events(spark, sf)
    at = verify.json_text(F.col("props"), "$.k")
    said = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, '"true"').otherwise("false")
    flagged = F.concat(F.lit('{"p":'), "props", F.lit(',"ok":'), said, F.lit("}"))
    return e.select("event_id", verify.numeric(at, 50.0, 10.0).alias("near"), verify.exact_json_field(["k"], 42)("props").alias("field"), verify.json_boolean(flagged, "$.ok", True).alias("flag"), canonical.stable_hash(F.col("props")).isNotNull().alias("same"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS cache_key FROM events")
def request_keys(spark, sf):
    """Content-addressed keys: digest of canonical JSON."""
    return events(spark, sf).select("event_id", canonical.stable_hash(F.col("props")).alias("cache_key"))


@query("SELECT event_id, value FROM events")
def replay_join(spark, sf):
    """Requests with their recorded results."""
    e = events(spark, sf)
    return ledger.replay(e.select("event_id"), events(spark, sf).select("event_id", "value"), "event_id")


@query("SELECT event_id FROM events WHERE user_id % 3 = 0")
def replay_misses(spark, sf):
    """Requests without a recorded result."""
    e = events(spark, sf)
    return ledger.replay_misses(e.select("event_id"), e.where("user_id % 3 <> 0"), "event_id")


_LINE = "l AS (SELECT 'v' || p_partkey AS version_id, CASE WHEN p_partkey % 100 <> 1 THEN 'v' || (p_partkey - 1) END AS parent_version_id FROM part)"


def _lineage(spark, sf):
    """Chains of 100 versions."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("version_id"), F.when(F.col("p_partkey") % 100 != 1, F.concat(F.lit("v"), (F.col("p_partkey") - 1).cast("string"))).alias("parent_version_id"), F.col("p_name").alias("content_hash"))


_ANCESTORS = "a AS (SELECT version_id, parent_version_id AS ancestor_id, 1 AS distance FROM l WHERE parent_version_id IS NOT NULL UNION ALL SELECT a.version_id, l.parent_version_id, distance + 1 FROM a JOIN l ON l.version_id = a.ancestor_id WHERE l.parent_version_id IS NOT NULL)"


@query(f"WITH RECURSIVE {_LINE}, {_ANCESTORS} SELECT * FROM a")
def lineage_ancestors(spark, sf):
    """All ancestors of all versions, by doubling."""
    return lineage.ancestors(_lineage(spark, sf))


_LOOP = _LINE.replace("CASE WHEN", "CASE WHEN p_partkey = 1 THEN 'v100' WHEN")


@query(f"WITH RECURSIVE {_LOOP}, k AS (SELECT * FROM l WHERE version_id <> 'v205'), c AS (SELECT version_id, parent_version_id AS up FROM k WHERE parent_version_id IS NOT NULL UNION SELECT c.version_id, k.parent_version_id FROM c JOIN k ON k.version_id = c.up WHERE k.parent_version_id IS NOT NULL) SELECT version_id, 'missing_parent' AS problem FROM k WHERE parent_version_id IS NOT NULL AND parent_version_id NOT IN (SELECT version_id FROM k) UNION ALL SELECT version_id, 'cycle' FROM c WHERE version_id = up")
def lineage_violations(spark, sf):
    """Versions whose parent is gone, and a cycle of 100 versions."""
    rows = _lineage(spark, sf).withColumn("parent_version_id", F.when(F.col("version_id") == "v1", "v100").otherwise(F.col("parent_version_id")))
    return lineage.lineage_violations(rows.where("version_id <> 'v205'"))


def _entries(spark, sf):
    p = _pool(spark, sf)
    return p.select(F.col("run").cast("string").alias("run_id"), F.col("id").alias("pos"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"), F.concat(F.lit("h"), (F.col("id") % 60).cast("string")).alias("content_hash"), F.lit(1).alias("cost"), F.when(F.col("id") % 7 == 0, F.array(F.lit("token_budget"))).otherwise(F.array().cast("array<string>")).alias("reasons"), "v1", "v2", "v3")


@query()
def archive_decisions(spark, sf):
    """Decisions on arrivals in their order; tests hold them against hand-checked sequences."""
    return archive.decisions(_entries(spark, sf), 6, 20)


@query(f"WITH {_E}, x AS (SELECT * FROM e WHERE id % 7 <> 0) SELECT CAST(run AS VARCHAR) AS run_id, 'c' || id AS candidate_id FROM x b WHERE NOT EXISTS (SELECT 1 FROM x a WHERE a.run = b.run AND {_D3})")
def scientific_front(spark, sf):
    """Feasible front of each run, whatever the order of arrival."""
    return archive.scientific_front(_entries(spark, sf)).select("run_id", "candidate_id")


@query(f"WITH {PAIRS_SQL} SELECT split, count(*) AS n, count(*) FILTER (bc AND NOT cc) AS lost, count(*) FILTER (cc AND NOT bc) AS gained FROM p GROUP BY 1")
def transitions(spark, sf):
    """Passes lost and gained against the base."""
    c, b = objectives.passed(), objectives.base_passed()
    return pairs(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.count_if(b & ~c).alias("lost"), F.count_if(c & ~b).alias("gained"))


@query(f"WITH {OBJ_SQL} SELECT candidate_id, least(v1, v2) AS worst FROM (SELECT candidate_id, round(accuracy, 6) AS v1, round(transfer, 6) AS v2 FROM obj)")
def worst_objective(spark, sf):
    """The lower of accuracy and transfer."""
    d = rounded(objectives.objectives(pairs(spark, sf)), "accuracy", "transfer")
    return d.select("candidate_id", F.least("accuracy", "transfer").alias("worst"))

