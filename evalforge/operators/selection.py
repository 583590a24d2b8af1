"""Selectors: top-k with full tie-breaks, and deployment policies."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pareto

#: Frozen [low, high] of each objective, in the maximised orientation.
Ranges = dict[str, tuple[float, float]]


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows with their 1-based ``place``: a distributed top-k, then a window over k rows."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_accuracy(df: DataFrame, k: int) -> DataFrame:
    """Highest accuracy, then id."""
    return top(df, [F.desc("accuracy"), F.asc("candidate_id")], k)


def feasible_by_accuracy(df: DataFrame, k: int) -> DataFrame:
    """Feasible rows by accuracy, then fewer tokens, then id."""
    return top(df.where("feasible"), [F.desc("accuracy"), F.asc("token_cost"), F.asc("candidate_id")], k)


def scalarised(df: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Highest weighted sum of normalised columns n_*."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(f"n_{c}") * w
    return top(df.withColumn("scalar", total), [F.desc("scalar"), F.asc("candidate_id")], k)


def hard_easy_product(df: DataFrame, k: int) -> DataFrame:
    """Highest product of success on hard and easy probe tasks."""
    return top(df.withColumn("product", F.col("hard") * F.col("easy")), [F.desc("product"), F.asc("candidate_id")], k)


def survivors(df: DataFrame, k: int) -> DataFrame:
    """Whole fronts in order of rank, the last one by crowding (boundaries first), then id."""
    ranked = pareto.crowding(pareto.ranks(df, "candidate_id"), "candidate_id", ["rank"])
    return top(ranked, [F.asc("rank"), F.desc("boundary"), F.desc("crowding"), F.asc("candidate_id")], k)


def chebyshev(columns: list[str], weights: list[float]) -> Column:
    """Largest weighted distance of normalised columns to 1."""
    parts = [(1 - F.col(c)) * w for c, w in zip(columns, weights, strict=True)]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def by_contribution(df: DataFrame, weights: list[float], reference: list[float], k: int) -> DataFrame:
    """Rows with an exclusive volume first, then by Chebyshev distance, volume and id; over vectors v*."""
    c = pareto.contributions(df.withColumn("pool", F.lit(0)), "candidate_id", reference, ["pool"]).drop("pool")
    c = c.withColumn("chebyshev", chebyshev(pareto.dims(df), weights))
    return top(c, [F.asc(F.col("contribution") <= 0), F.asc("chebyshev"), F.desc("contribution"), F.asc("candidate_id")], k)


def dirichlet(n: int, seed: int) -> list[float]:
    """Random weights that sum to one, from gamma draws."""
    draw = random.Random(seed)
    g = [draw.gammavariate(1.0, 1.0) for _ in range(n)]
    return [x / sum(g) for x in g]


def parent(df: DataFrame, seed: int) -> DataFrame:
    """The row nearest to the ideal under random Chebyshev weights."""
    cols = pareto.dims(df)
    return top(df.withColumn("chebyshev", chebyshev(cols, dirichlet(len(cols), seed))), [F.asc("chebyshev"), F.asc("candidate_id")], 1)


def controls(df: DataFrame, k: int) -> DataFrame:
    """The first rows by id."""
    return top(df, [F.asc("candidate_id")], k)


def capped(df: DataFrame, k: int, cap: int) -> DataFrame:
    """Highest accuracy, of no more than ``cap`` rows."""
    return by_accuracy(df, min(k, cap))


def full_merge(df: DataFrame, k: int) -> DataFrame:
    """The first rows in the order in which they came (pos)."""
    return top(df, [F.asc("pos")], k)


def archive_selection(df: DataFrame, k: int) -> DataFrame:
    """The feasible front, or what an archive of ``k`` keeps of it, by id: (.., reasons array, v1..)."""
    kept = pareto.capacity_kept(pareto.front(df.where(F.size("reasons") == 0), tolerance=1e-12), "candidate_id", k)
    return top(kept, [F.asc("candidate_id")], k)


def _ties() -> list[Column]:
    return [F.asc("regression"), F.asc("token_cost"), F.asc("content_hash")]


def min_tokens(df: DataFrame, accuracy_floor: float) -> DataFrame:
    """The cheapest row that reaches the floor; no row if none does."""
    return top(df.where(F.col("accuracy") >= accuracy_floor), [F.asc("token_cost"), *_ties()], 1)


def max_transfer(df: DataFrame, token_budget: float) -> DataFrame:
    """The best transfer within the budget; no row if none fits."""
    return top(df.where(F.col("token_cost") <= token_budget), [F.desc("transfer"), *_ties()], 1)


def knee(df: DataFrame, ranges: Ranges) -> DataFrame:
    """The row nearest to the ideal corner of the frozen ranges; a range without width counts as reached."""
    square = F.lit(0.0)
    for c, sign in (("accuracy", 1), ("transfer", 1), ("token_cost", -1), ("regression", -1)):
        low, high = ranges[c]
        n = F.lit(1.0) if high <= low else (F.col(c) * sign - low) / (high - low)
        square = square + F.pow(1 - n, 2)
    return top(df.withColumn("distance", F.sqrt(square)), [F.asc("distance"), *_ties()], 1)


def deployments(df: DataFrame, accuracy_floor: float, token_budget: float, ranges: Ranges) -> DataFrame:
    """policy_id, defined, candidate_id for the three policies; an undefined policy has its reason."""
    spark = df.sparkSession
    names = spark.createDataFrame([("min_tokens", "no_candidate_meets_accuracy_floor"), ("max_transfer", "no_candidate_within_token_budget"), ("knee", "no_candidates")], "policy_id string, why string")
    found = [min_tokens(df, accuracy_floor), max_transfer(df, token_budget), knee(df, ranges)]
    picks = None
    for p, f in zip(("min_tokens", "max_transfer", "knee"), found, strict=True):
        one = f.select(F.lit(p).alias("policy_id"), "candidate_id")
        picks = one if picks is None else picks.unionByName(one)
    return names.join(picks, "policy_id", "left").select("policy_id", F.col("candidate_id").isNotNull().alias("defined"), "candidate_id", F.when(F.col("candidate_id").isNull(), F.col("why")).alias("reason"))


def hash_sample(blocks: DataFrame, n: int, salt: str, per: str = "target_id") -> DataFrame:
    """The first ``n`` blocks of each target by a salted SHA-256, with their place: a fixed pseudo-random sample."""
    digest = F.sha2(F.concat_ws("\0", F.lit(salt), per, "block_id", F.col("seed").cast("string")), 256)
    w = Window.partitionBy(per).orderBy("digest", "block_id", "seed")
    return blocks.withColumn("digest", digest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


@dataclass(frozen=True)
class Plugin:
    """A method: how it proposes subsets (ids, most, seed) and how it selects (table, k)."""

    select: Callable[..., DataFrame]
    propose: Callable[..., list[tuple[str, ...]]] | None = None


@dataclass
class Registry:
    """Named plugins; a name can be registered once."""

    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, name: str, plugin: Plugin | Callable[..., DataFrame]) -> None:
        """Adds a plugin, or a selector alone."""
        if name in self.plugins:
            raise ValueError(f"{name!r} is registered already")
        self.plugins[name] = plugin if isinstance(plugin, Plugin) else Plugin(plugin)

    def plugin(self, name: str) -> Plugin:
        """The plugin of this name."""
        if name not in self.plugins:
            raise KeyError(f"no plugin {name!r}")
        return self.plugins[name]

    def get(self, name: str) -> Callable[..., DataFrame]:
        """The selector of this name."""
        return self.plugin(name).select


def builtin(weights: dict[str, float] | None = None, reference: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0), cap: int = 8) -> Registry:
    """The twelve methods: two controls, composition, merge, accuracy, weighted sum, product, capped top-k, fronts, contribution, and two archives."""
    from . import controllers

    r = Registry()
    equal = [1.0 / len(reference)] * len(reference)
    selectors = {
        "no_skill": controls,
        "base": controls,
        "random_composition": feasible_by_accuracy,
        "full_merge": full_merge,
        "accuracy": by_accuracy,
        "fixed_scalarization": lambda df, k: scalarised(df, weights or {"accuracy": 0.25, "transfer": 0.25, "token_cost": 0.25, "regression": 0.25}, k),
        "hard_easy_product": hard_easy_product,
        "capped_top_k": lambda df, k: capped(df, k, cap),
        "fronts": survivors,
        "contribution": lambda df, k: by_contribution(df, equal, list(reference), k),
        "passive_archive": archive_selection,
        "conditioned_archive": archive_selection,
    }
    for name, f in selectors.items():
        r.register(name, Plugin(f, lambda ids, most, seed, method=name: controllers.static_subsets(method, ids, most, seed)))
    return r
