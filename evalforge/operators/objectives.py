"""Pairing with the base, the four objectives, and feasibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = ["task_id", "seed"]


def compatible(target: str = "target", block: str = "block") -> Column:
    """Whether a target takes a block: same domain, split and role unless unset, group unless it is "*"."""
    t, b = (lambda c: F.col(f"{target}.{c}")), (lambda c: F.col(f"{block}.{c}"))
    same = (t("domain_id") == b("domain_id")) & (t("task_group").isin("*") | (t("task_group") == b("group_id")))
    return same & (t("split_id").isNull() | t("split_id").eqNullSafe(b("split_id"))) & (b("objective_role").isNull() | (t("objective_role") == b("objective_role")))


def evaluation_matrix(candidates: DataFrame, targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(candidate_id, target_id, task_id, seed) to be evaluated: targets meet blocks on their domain, then each candidate takes them all."""
    t, b = targets.alias("target"), blocks.alias("block")
    met = t.join(b, compatible()).select("target.target_id", "block.task_id", "block.seed")
    return candidates.select("candidate_id").join(met)


def pair_with_base(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the base candidate's result on the same target, task and seed.

    One equi-join; the base side is one candidate's rows, and the optimiser broadcasts it where its size allows.
    ``grp`` is the transfer group, or the target where a transfer row names none.
    """
    base = outcomes.where("is_base").select("target_id", *BLOCK, F.col("correct").alias("base_correct"))
    group = F.when(F.col("split") == "transfer", F.coalesce("transfer_group", "target_id"))
    return outcomes.join(base, ["target_id", *BLOCK]).select(
        "candidate_id", "target_id", *BLOCK, "split", group.alias("grp"), F.col("correct").alias("candidate_correct"), "base_correct", "input_tokens", "output_tokens"
    )


def unpaired(outcomes: DataFrame) -> DataFrame:
    """Outcomes without a base result."""
    base = outcomes.where("is_base").select("target_id", *BLOCK)
    return outcomes.join(base, ["target_id", *BLOCK], "left_anti")


def rate(condition: Column, of: Column) -> Column:
    """Share of the rows of ``of`` that meet ``condition``; null if there are none."""
    return F.count_if(condition & of) / F.nullif(F.count_if(of), F.lit(0))


def passed() -> Column:
    """Whether the candidate passes."""
    return F.col("candidate_correct")


def base_passed() -> Column:
    """Whether the base passes."""
    return F.col("base_correct")


def _tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens")


def objectives(pairs: DataFrame) -> DataFrame:
    """candidate_id, accuracy, transfer, token_cost, regression, regression_defined, delta.

    accuracy: mean success on id rows; transfer: least mean success over transfer groups; token_cost: mean tokens of
    all rows; regression: failures among rows that the base passes, 1 where there are none; delta: mean difference to
    the base on id rows.  Two aggregations: by group, then by candidate over group sums, so a hot candidate's rows are
    combined before the shuffle.
    """
    one = lambda c: F.count_if(c)
    by_group = pairs.groupBy("candidate_id", "split", "grp").agg(
        F.count("*").alias("n"), one(passed()).alias("c"), one(base_passed()).alias("b"), one(base_passed() & ~passed()).alias("f"), F.sum(_tokens()).alias("tok")
    )
    is_id, is_tr = F.col("split") == "id", F.col("split") == "transfer"
    part = lambda c, w: F.sum(F.when(w, F.col(c)))
    eligible, failed = F.sum("b"), F.sum("f")
    return by_group.groupBy("candidate_id").agg(
        (part("c", is_id) / part("n", is_id)).alias("accuracy"),
        F.min(F.when(is_tr, F.col("c") / F.col("n"))).alias("transfer"),
        (F.sum("tok") / F.sum("n")).alias("token_cost"),
        F.when(eligible > 0, failed / eligible).otherwise(1.0).alias("regression"),
        (eligible > 0).alias("regression_defined"),
        ((part("c", is_id) - part("b", is_id)) / part("n", is_id)).alias("delta"),
    )


def group_rates(pairs: DataFrame) -> DataFrame:
    """Mean success by candidate and transfer group."""
    return pairs.where("split = 'transfer'").groupBy("candidate_id", "grp").agg(F.avg(passed().cast("int")).alias("rate"), F.count("*").alias("n"))


def target_statistics(pairs: DataFrame) -> DataFrame:
    """By candidate and target: accuracy, delta, regression (null without eligible rows), tokens."""
    return pairs.groupBy("candidate_id", "target_id").agg(
        F.avg(passed().cast("int")).alias("accuracy"), F.avg(passed().cast("int") - base_passed().cast("int")).alias("delta"), rate(~passed(), base_passed()).alias("regression"), F.avg(_tokens()).alias("token_cost")
    )


def block_counts(pairs: DataFrame) -> DataFrame:
    """Distinct blocks by candidate: all, id, base-correct, and the least over transfer groups."""
    per = pairs.groupBy("candidate_id", *BLOCK, "split", "grp").agg(F.max(base_passed().cast("int")).alias("b"))
    groups = per.where("split = 'transfer'").groupBy("candidate_id", "grp").agg(F.count_distinct(*BLOCK).alias("n")).groupBy("candidate_id").agg(F.min("n").alias("transfer_blocks"))
    block = F.struct(*BLOCK)
    all_ = per.groupBy("candidate_id").agg(
        F.count_distinct(block).alias("blocks"), F.count_distinct(F.when(F.col("split") == "id", block)).alias("id_blocks"), F.count_distinct(F.when(F.col("b") == 1, block)).alias("base_correct_blocks")
    )
    return all_.join(groups, "candidate_id", "left")


def hard_easy(outcomes: DataFrame, count: int) -> DataFrame:
    """candidate_id, hard, easy: success on the ``count`` hardest and easiest id tasks of the base (half of the tasks at most)."""
    base = outcomes.where("is_base and split = 'id'").groupBy("task_id").agg(F.avg(F.col("correct").cast("int")).alias("mean"))
    from pyspark.sql import Window

    every = Window.partitionBy()  # one row a task
    ranked = base.select("task_id", F.row_number().over(Window.orderBy("mean", "task_id")).alias("r"), F.count("*").over(every).alias("n"))
    probes = ranked.withColumn("k", F.least(F.lit(count), F.floor(F.col("n") / 2))).select("task_id", (F.col("r") <= F.col("k")).alias("is_hard"), (F.col("r") > F.col("n") - F.col("k")).alias("is_easy")).where("is_hard or is_easy")
    rows = outcomes.where("split = 'id'").join(probes, "task_id")
    mean = lambda c: F.avg(F.when(F.col(c), F.col("correct").cast("int")))
    return rows.groupBy("candidate_id").agg(mean("is_hard").alias("hard"), mean("is_easy").alias("easy"))


@dataclass(frozen=True)
class Constraints:
    """Floors and budget; a disabled gate passes all."""

    accuracy_floor: float
    token_budget: float
    delta_floor: float | None = None
    enabled: bool = True

    @classmethod
    def from_base(cls, base_accuracy: float, epsilon: float, token_budget: float) -> Constraints:
        """Absolute floor, ``epsilon`` below the base."""
        return cls(max(0.0, base_accuracy - epsilon), token_budget)

    @classmethod
    def from_paired(cls, epsilon: float, token_budget: float) -> Constraints:
        """Floor on the paired difference to the base."""
        return cls(0.0, token_budget, -epsilon)


def reasons(c: Constraints, accuracy: str = "accuracy", token_cost: str = "token_cost", delta: str = "delta", tolerance: float = 1e-12) -> Column:
    """Array of the reasons for which a row is infeasible."""
    if not c.enabled:
        return F.array().cast("array<string>")
    found = [F.when(F.col(accuracy) + tolerance < c.accuracy_floor, F.lit("accuracy_floor"))]
    if c.delta_floor is not None:
        found.append(F.when(F.col(delta).isNull(), F.lit("accuracy_delta_unavailable")).when(F.col(delta) + tolerance < c.delta_floor, F.lit("accuracy_delta_floor")))
    found.append(F.when(F.col(token_cost) - tolerance > c.token_budget, F.lit("token_budget")))
    return F.array_compact(F.array(*found))


def feasibility(df: DataFrame, c: Constraints, **names) -> DataFrame:
    """Adds ``reasons`` and ``feasible``."""
    return df.withColumn("reasons", reasons(c, **names)).withColumn("feasible", F.size("reasons") == 0)


#: The objectives in canonical order, all turned so that more is better.
OBJECTIVES = ("accuracy", "transfer", "token_cost", "regression")


def maximised(df: DataFrame, active: tuple[str, ...] = OBJECTIVES, pessimistic: bool = False) -> DataFrame:
    """Adds v1.. for the active objectives: lower bounds of benefits, negated upper bounds of costs if ``pessimistic``."""
    if not active or len(set(active)) != len(active) or set(active) - set(OBJECTIVES):
        raise ValueError(f"active objectives must be some of {OBJECTIVES}, each once")
    for i, name in enumerate([o for o in OBJECTIVES if o in active], 1):
        benefit = name in ("accuracy", "transfer")
        c = F.col(name if not pessimistic else f"{name}_{'lcb' if benefit else 'ucb'}")
        df = df.withColumn(f"v{i}", c if benefit else -c)
    return df


def normalised(df: DataFrame, ranges: dict[str, tuple[float, float]], on_degenerate: float | None = None, clip: bool = False) -> DataFrame:
    """Adds n_<column> = (x - low) / (high - low); a range without width gives ``on_degenerate`` or is an error."""
    for c, (low, high) in ranges.items():
        if high <= low and on_degenerate is None:
            raise ValueError(f"range of {c} has no width")
        v = F.lit(float(on_degenerate or 0.0)) if high <= low else (F.col(c) - low) / (high - low)
        df = df.withColumn(f"n_{c}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if clip else v)
    return df


def pool_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds lo_ and hi_ of each column over the whole pool: one aggregate row, joined back."""
    r = df.agg(*[f(c).alias(p + c) for c in columns for f, p in ((F.min, "lo_"), (F.max, "hi_"))])
    return df.join(F.broadcast(r))  # one row
