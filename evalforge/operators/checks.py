"""Integrity checks.  Each returns the rows that break a rule; an empty result means that the rule holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with ``problem`` missing or extra.  Each side is reduced to its keys before the join."""
    e = expected.select(*[F.col(k).alias(f"e_{k}") for k in keys]).distinct().withColumn("in_expected", F.lit(True))
    o = observed.select(*[F.col(k).alias(f"o_{k}") for k in keys]).distinct().withColumn("in_observed", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(f"e_{k}").eqNullSafe(F.col(f"o_{k}")) for k in keys])
    both = e.join(o, on, "full_outer").select(*[F.coalesce(f"e_{k}", f"o_{k}").alias(k) for k in keys], "in_expected", "in_observed")
    return both.where("in_expected is null or in_observed is null").select(*keys, F.when(F.col("in_observed").isNull(), "missing").otherwise("extra").alias("problem"))


def unclosed(df: DataFrame, group: list[str], cell: list[str]) -> DataFrame:
    """Groups that don't hold each cell of the whole table exactly once: group, cells, rows, wanted."""
    wanted = df.select(*cell).distinct().agg(F.count("*").alias("wanted"))
    got = df.groupBy(*group).agg(F.count_distinct(F.struct(*cell)).alias("cells"), F.count("*").alias("rows"))
    return got.join(F.broadcast(wanted)).where("cells <> wanted or rows <> wanted")  # one row


def varying(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys under which a column that must be constant has several values: key, column, n."""
    per = df.groupBy(*key).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))
    return per.select(*key, pairs.alias("x")).select(*key, "x.column", "x.n").where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference has no parent; null references are none."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def declared_overlaps(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """Tasks that lie in two splits declared disjoint: split_id, other_id, task_id.

    ``tasks``: (split_id, task_id); ``splits``: (split_id, disjoint_from array).
    """
    pairs = splits.select("split_id", F.explode("disjoint_from").alias("other_id"))
    tasks = tasks.select("split_id", "task_id").distinct()  # a task's rows don't multiply in the join
    left = tasks.join(pairs, "split_id")
    right = tasks.select(F.col("split_id").alias("other_id"), "task_id")
    return left.join(right, ["other_id", "task_id"]).select("split_id", "other_id", "task_id").distinct()


def wrong_counts(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits whose task count isn't the declared one: split_id, expected_count, n."""
    n = tasks.groupBy("split_id").agg(F.count("*").alias("n"))
    return splits.select("split_id", "expected_count").join(n, "split_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected_count")


def bad_outcomes(df: DataFrame) -> DataFrame:
    """Outcome rows that break a row rule, with the list of broken rules."""
    rules = {
        "empty_id": "candidate_id = '' or target_id = '' or task_id = '' or candidate_id is null or target_id is null or task_id is null",
        "split": "split is null or split not in ('id', 'transfer', 'final', 'diagnostic')",
        "tokens": "input_tokens is null or output_tokens is null or input_tokens < 0 or output_tokens < 0",
        "correct": "correct is null",
        "transfer_group": "transfer_group = ''",
    }
    broken = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def bad_intervals(df: DataFrame, low: str, point: str, high: str, least: float, most: float) -> DataFrame:
    """Estimates that aren't finite, ordered or within [least, most]."""
    cols = [F.col(c) for c in (low, point, high)]
    odd = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (c < least) | (c > most) for c in cols])
    return df.where(odd | (F.col(low) > F.col(high)))


def rejoined(columns: list[str], a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two tables differ, repeats counted: for snapshots that must be the same."""
    return a.select(*columns).exceptAll(b.select(*columns)).withColumn("side", F.lit("left")).unionByName(b.select(*columns).exceptAll(a.select(*columns)).withColumn("side", F.lit("right")))
