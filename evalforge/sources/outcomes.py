"""The outcome table: one row per candidate, target, task and seed.

The test data has no outcomes, so they are derived from ``lineitem`` with exact integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["candidate_id", "target_id", "task_id", "seed"]
SCHEMA = T.StructType(
    [
        T.StructField("candidate_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("task_id", T.StringType(), False),
        T.StructField("seed", T.LongType(), False),
        T.StructField("is_base", T.BooleanType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("transfer_group", T.StringType(), True),
        T.StructField("correct", T.BooleanType(), False),
        T.StructField("input_tokens", T.LongType(), False),
        T.StructField("output_tokens", T.LongType(), False),
    ]
)


def outcomes(spark: SparkSession, sf_dir: str, candidates: int = 8, tasks: int = 40) -> DataFrame:
    """Outcomes of ``candidates`` x 5 targets x ``tasks`` x 3 seeds; one aggregation with map-side partial sums."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy((F.col("l_suppkey") % candidates).alias("c"), (F.col("l_partkey") % 5).alias("t"), (F.col("l_orderkey") % tasks).alias("k"), (F.col("l_linenumber") % 3).cast("long").alias("seed"))
    g = g.agg(F.sum(F.col("l_partkey") + 7 * F.col("l_suppkey") + 13 * F.col("l_orderkey")).alias("mixed"), F.sum("l_partkey").alias("parts"), F.sum("l_suppkey").alias("supps"))
    return g.select(
        F.concat(F.lit("c"), F.col("c").cast("string")).alias("candidate_id"),
        F.concat(F.lit("t"), F.col("t").cast("string")).alias("target_id"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("task_id"),
        "seed",
        (F.col("c") == 0).alias("is_base"),
        F.when(F.col("t") == 0, "id").otherwise("transfer").alias("split"),
        F.when(F.col("t") != 0, F.concat(F.lit("g"), F.col("t").cast("string"))).alias("transfer_group"),
        (F.col("mixed") % 100 < 50 + 4 * F.col("c")).alias("correct"),
        (40 + 10 * F.col("c") + F.col("parts") % 50).cast("long").alias("input_tokens"),
        (8 + F.col("supps") % 13).cast("long").alias("output_tokens"),
    )


def outcomes_sql(candidates: int = 8, tasks: int = 40) -> str:
    """The same table as a DuckDB common table expression named ``o``."""
    return f"""o AS (
  SELECT 'c' || c AS candidate_id, 't' || t AS target_id, 'k' || k AS task_id, CAST(s AS BIGINT) AS seed, c = 0 AS is_base,
         CASE WHEN t = 0 THEN 'id' ELSE 'transfer' END AS split, CASE WHEN t <> 0 THEN 'g' || t END AS transfer_group,
         mixed % 100 < 50 + 4 * c AS correct, CAST(40 + 10 * c + parts % 50 AS BIGINT) AS input_tokens, CAST(8 + supps % 13 AS BIGINT) AS output_tokens
  FROM (SELECT l_suppkey % {candidates} AS c, l_partkey % 5 AS t, l_orderkey % {tasks} AS k, l_linenumber % 3 AS s,
               sum(l_partkey + 7 * l_suppkey + 13 * l_orderkey) AS mixed, sum(l_partkey) AS parts, sum(l_suppkey) AS supps
        FROM lineitem GROUP BY ALL)
)"""
