"""Queries over subset search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import search
from .evaluation import _pool

IDS = [f"p{i}" for i in range(7)]
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


_DRAWS = "g AS (SELECT d AS draw, r_name AS patch_id FROM generate_series(0, 299) a(d), region), s AS (SELECT draw, string_agg(patch_id, ',' ORDER BY patch_id) AS subset FROM g WHERE ('0x' || substr(md5('11|' || draw || '|' || patch_id), 1, 8))::BIGINT / 4294967296.0 < 0.5 GROUP BY draw)"


def _universe(spark, sf):
    return spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("patch_id"))


@query(f"WITH {_DRAWS} SELECT draw, subset FROM s")
def bernoulli_subsets(spark, sf):
    """Random subsets of a universe."""
    return search.bernoulli(_universe(spark, sf), 0, 300, 0.5, 11).select("draw", F.array_join("subset", ",").alias("subset"))


@query(f"WITH {_DRAWS} SELECT min(draw) AS draw, subset FROM s GROUP BY subset HAVING subset NOT IN ('ASIA', 'AFRICA,EUROPE')")
def unique_subsets(spark, sf):
    """Each subset once, without those that are known."""
    seen = spark.createDataFrame([(["ASIA"],), (["AFRICA", "EUROPE"],)], "subset array<string>")
    return search.unique(search.bernoulli(_universe(spark, sf), 0, 300, 0.5, 11), seen).select("draw", F.array_join("subset", ",").alias("subset"))


@query("SELECT event_id, ('0x' || substr(h, 1, 2))::BIGINT < 166 AS correct, 24 + ('0x' || substr(h, 3, 2))::BIGINT % 9 AS input_tokens, 8 + ('0x' || substr(h, 5, 2))::BIGINT % 13 AS output_tokens, (1 + ('0x' || substr(h, 7, 2))::BIGINT % 5)::DOUBLE AS latency_ms FROM (SELECT event_id, sha256(sha256(replace(props, ' ', ''))) AS h FROM events)")
def synthetic_outcomes(spark, sf):
    """Stable made-up outcomes of content-addressed requests."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", canonical.stable_hash(F.col("props")).alias("cache_key"))
    return search.synthetic(e).drop("cache_key")


@query("SELECT 'c' || s_suppkey AS candidate_id FROM supplier ORDER BY round(s_acctbal / 1000) DESC, 'h' || (s_suppkey * 31 % 101), 'c' || s_suppkey LIMIT 8")
def topk_incumbents(spark, sf):
    """Incumbents after two batches."""
    p = _pool(spark, sf).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"), F.col("v1").alias("accuracy"), F.concat(F.lit("h"), (F.col("id") * 31 % 101).cast("string")).alias("content_hash"), "id")
    first = search.incumbents(None, p.where("id % 2 = 0"), 8)
    return search.incumbents(first, p.where("id % 2 = 1"), 8).select("candidate_id")


@query()
def genetic_offspring(spark, sf):
    """A generation of children; tests check its properties."""
    subset = F.filter(F.array(*[F.lit(i) for i in IDS]), lambda p: search.uniform(F.lit("s"), F.col("id").cast("string"), p) < 0.5)
    pop = _pool(spark, sf).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), subset.alias("subset"), "v1", "v2", "v3")
    return search.offspring(pop, search.patches(spark, IDS), 1, 40, 7).select("draw", F.array_join("subset", ",").alias("subset"))
