"""Usage, costs, ledgers and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pareto


def usage(df: DataFrame, provider: Column) -> DataFrame:
    """Calls and tokens by provider."""
    return df.groupBy(provider.alias("provider_id")).agg(F.count("*").alias("provider_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def provider_of(reported: str, configured: str, single: str | None = None) -> Column:
    """Reported provider, else the one configured for the target, else the only one."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(blank(reported), blank(configured), F.lit(single).cast("string"))


def costs(use: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with monetary_cost; an unknown price gives null, never 0."""
    p = prices.select("provider_id", "currency", F.col("input_per_million").alias("pi"), F.col("output_per_million").alias("po"))
    cost = (F.col("input_tokens") * F.col("pi") + F.col("output_tokens") * F.col("po")) / 1e6
    good = F.col("currency").isNotNull() & F.col("pi").isNotNull() & F.col("po").isNotNull() & (F.col("pi") >= 0) & (F.col("po") >= 0)
    j = use.join(p, "provider_id", "left").withColumn("price_defined", F.coalesce(good, F.lit(False)))
    return j.select(*use.columns, (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "currency", "price_defined", F.when(F.col("price_defined"), cost).alias("monetary_cost"))


def cost_total(priced: DataFrame) -> DataFrame:
    """One row: all_prices_defined, currencies, and the total if all prices are defined in one currency."""
    a = priced.agg(F.bool_and("price_defined").alias("all_prices_defined"), F.count_distinct("currency").alias("currencies"), F.sum("monetary_cost").alias("s"), F.max("currency").alias("c"))
    single = F.col("all_prices_defined") & (F.col("currencies") == 1)
    return a.select(F.coalesce("all_prices_defined", F.lit(True)).alias("all_prices_defined"), "currencies", F.when(single, F.col("s")).alias("total"), F.when(single, F.col("c")).alias("currency"))


def currency_totals(priced: DataFrame) -> DataFrame:
    """Cost by currency."""
    return priced.where("price_defined").groupBy("currency").agg(F.sum("monetary_cost").alias("total"))


def merged(tables: list[DataFrame], key: list[str], payload: list[str]) -> DataFrame:
    """Union of ledgers with one row for each key; ``conflicts`` counts its payloads beyond the first."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    p = F.struct(*payload)
    return every.groupBy(*key).agg(F.min(p).alias("p"), (F.count_distinct(p) - 1).alias("conflicts"), F.count("*").alias("copies")).select(*key, "p.*", "copies", "conflicts")


def merged_strictly(tables: list[DataFrame], key: list[str], payload: list[str]) -> DataFrame:
    """Union of ledgers with one row for each key; a key with several payloads is an error when its row is read."""
    m = merged(tables, key, payload)
    text = F.concat(F.lit("records that differ: "), F.to_json(F.struct(*key)))
    checked = F.when(F.col("conflicts") > 0, F.raise_error(text).cast(m.schema[payload[0]].dataType)).otherwise(F.col(payload[0]))
    return m.withColumn(payload[0], checked).drop("conflicts")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("turn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("turn_ = 1").drop("turn_")


def incremental(full: DataFrame, screened: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the full matrix that the screen hasn't paid for."""
    return full.join(screened.select(*key).distinct(), key, "left_anti")


def retry_events(df: DataFrame) -> DataFrame:
    """Failure events whose will_retry doesn't agree with their limit."""
    return df.where("will_retry <> (attempt_number <= retry_limit)")


def exhausted(df: DataFrame) -> DataFrame:
    """Requests whose last attempt won't be retried, with their events counted."""
    last = df.groupBy("request_fingerprint").agg(F.count("*").alias("events"), F.max("attempt_number").alias("attempts"), F.max_by("will_retry", "attempt_number").alias("retry"))
    return last.where("not retry").select("request_fingerprint", "events", "attempts")


def budget_curve(events: DataFrame, checkpoints: list[int], reference: list[float]) -> DataFrame:
    """checkpoint, candidates, hypervolume, reached: what was known when so much was spent.

    ``events``: (run_id, pos, cost, candidate_id, feasible, v1..).  A later score of a candidate replaces an earlier one.
    The running sum is over a run's events; scores known at a checkpoint are a range join on ``spent``.
    """
    spark, cols = events.sparkSession, pareto.dims(events)
    spent = events.withColumn("spent", F.sum("cost").over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    marks = spark.createDataFrame([(int(c),) for c in checkpoints], "checkpoint long")
    known = spent.join(F.broadcast(marks), F.col("spent") <= F.col("checkpoint"))  # a handful of checkpoints
    w = Window.partitionBy("run_id", "checkpoint", "candidate_id").orderBy(F.desc("pos"))
    latest = known.withColumn("r", F.row_number().over(w)).where("r = 1")
    n = latest.groupBy("run_id", "checkpoint").agg(F.count("*").alias("candidates"))
    hv = pareto.hypervolume(latest.where("feasible").select("run_id", "checkpoint", *cols), reference, ["run_id", "checkpoint"])
    total = spent.groupBy("run_id").agg(F.max("spent").alias("total"))
    grid = total.join(F.broadcast(marks))
    out = grid.join(n, ["run_id", "checkpoint"], "left").join(hv, ["run_id", "checkpoint"], "left")
    return out.select("run_id", "checkpoint", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"), (F.col("total") >= F.col("checkpoint")).alias("reached"))


def false_admission(screened: DataFrame, archived: DataFrame) -> DataFrame:
    """One row: share of screened ids that the archive lacks, 0 without any."""
    s, a = screened.select("candidate_id").distinct(), archived.select("candidate_id").distinct()
    lost = s.join(a, "candidate_id", "left_anti").agg(F.count("*").alias("lost"))
    return lost.join(s.agg(F.count("*").alias("n"))).select("n", "lost", F.coalesce(F.col("lost") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("rate"))


def validated_false_admission(screened: DataFrame, validated: DataFrame, archived: DataFrame) -> DataFrame:
    """One row over ids both screened and validated: n, lost (not archived), rate (null without any), lost_ids."""
    s, v, a = (d.select("candidate_id").distinct() for d in (screened, validated, archived))
    both = s.join(v, "candidate_id").join(a.withColumn("kept", F.lit(True)), "candidate_id", "left")
    gone = F.col("kept").isNull()
    return both.agg(F.count("*").alias("n"), F.count_if(gone).alias("lost"), F.array_join(F.array_sort(F.collect_list(F.when(gone, F.col("candidate_id")))), ",").alias("lost_ids")).withColumn("rate", F.col("lost") / F.nullif("n", F.lit(0)))
