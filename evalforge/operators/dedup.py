"""Roles of targets, execution groups, and priority dedup of overlapping executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"id": 0, "transfer": 1, "diagnostic": 2}


def roles(targets: DataFrame) -> DataFrame:
    """target_id, role by precedence: excluded, override, the target's own role, transfer group; null if none applies."""
    own = F.when(F.col("role").isin(*PRIORITY), F.col("role"))
    return targets.select("target_id", F.when(F.coalesce("excluded", F.lit(False)), "diagnostic").otherwise(F.coalesce("override", own, F.when(F.col("transfer_group").isNotNull(), "transfer"))).alias("role"))


def execution_groups(targets: DataFrame) -> DataFrame:
    """target_id, execution_group: the declared one, else a digest shared by equal signatures if one of them opts in, else its own."""
    digest = F.sha2("signature", 256)
    reuse = F.max(F.coalesce("reuse", F.lit(False))).over(Window.partitionBy("signature"))
    return targets.select("target_id", F.coalesce("declared_group", F.when(reuse, F.concat(F.lit("shared:"), digest)), F.concat(F.lit("target:"), F.col("target_id"))).alias("execution_group"))


IDENTITY = ["candidate_id", "content_hash", "task_id", "seed", "execution_group"]


def overlap_violations(rows: DataFrame) -> DataFrame:
    """Identities that break a rule of overlaps: (identity.., problem).

    ``rows``: outcomes with content_hash, role and execution_group.  Problems: a target twice, outcomes that differ, id
    and transfer roles together, several transfer groups.
    """
    g = rows.groupBy(*IDENTITY).agg(
        (F.count("*") - F.count_distinct("target_id")).alias("again"),
        F.count_distinct(F.struct("correct", "input_tokens", "output_tokens")).alias("outcomes"),
        F.count_distinct(F.when(F.col("role") != "diagnostic", F.col("role"))).alias("primary"),
        F.count_distinct(F.when(F.col("role") == "transfer", F.coalesce("transfer_group", "target_id"))).alias("groups"),
    )
    found = F.array_compact(F.array(F.when(F.col("again") > 0, F.lit("repeated_target")), F.when(F.col("outcomes") > 1, F.lit("conflicting_outcomes")), F.when(F.col("primary") > 1, F.lit("mixed_roles")), F.when(F.col("groups") > 1, F.lit("mixed_groups"))))
    return g.select(*IDENTITY, F.explode(found).alias("problem"))


def overlap_dedup(rows: DataFrame) -> DataFrame:
    """One row for each identity: id before transfer before diagnostic, then by target."""
    order = F.when(F.col("role") == "id", 0).when(F.col("role") == "transfer", 1).otherwise(2)
    w = Window.partitionBy(*IDENTITY).orderBy(order, "target_id")
    return rows.withColumn("turn_", F.row_number().over(w)).where("turn_ = 1").drop("turn_")


def content_dedup(df: DataFrame, key: str = "content_hash", order: str = "pos") -> DataFrame:
    """Rows with ``accepted`` and, for a repeat, the ``original`` that came first."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first("candidate_id").over(w)
    return df.withColumn("accepted", F.row_number().over(w) == 1).withColumn("original", F.when(~F.col("accepted"), first))
