"""Stratified paired block bootstrap.

Blocks (task, seed) with the same sorted composition of (split, target, group)
form a stratum.  A replicate draws as many blocks of each stratum as it has, with
replacement.  Draws are kept as multiplicities of blocks, so that a replicate's
metrics are weighted sums of sufficient statistics of blocks, and candidates that
share their blocks share one set of draws.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .objectives import BLOCK, base_passed, passed

METRICS = ("accuracy", "delta", "transfer", "token_cost", "regression")


def strata(pairs: DataFrame) -> DataFrame:
    """(candidate_id, task_id, seed, stratum, place, size): place counts from 0 in the order of (task_id, seed)."""
    sign = F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "split", "target_id", F.coalesce("grp", F.lit(""))))), ";"))
    blocks = pairs.groupBy("candidate_id", *BLOCK).agg(sign.alias("stratum"))
    w = Window.partitionBy("candidate_id", "stratum")
    return blocks.withColumn("place", F.row_number().over(w.orderBy(*BLOCK)) - 1).withColumn("size", F.count("*").over(w))


def own_seed(seed: int, name: Column) -> Column:
    """``seed`` xor the first 16 hex digits of the name's SHA-256, as an unsigned decimal text."""
    h = F.sha2(name, 256)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    high, low = half(1).bitwiseXOR(F.lit(seed >> 32)), half(9).bitwiseXOR(F.lit(seed & 0xFFFFFFFF))
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(20,0)").cast("string")


def hash_draws(layout: DataFrame, replicates: int, seed: int | str) -> DataFrame:
    """(stratum, size, replicate, place, weight) from a hash of (seed, replicate, stratum, draw), the same on any engine.

    ``layout``: (stratum, size), and the seed if ``seed`` names a column.  The index of a draw is the first 8 hex digits
    of the md5 of the key, modulo size.
    """
    of = F.col(seed) if isinstance(seed, str) else F.lit(str(seed))
    s = layout.select("stratum", "size", of.alias("seed_")).distinct()
    d = s.select("stratum", "size", "seed_", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))).alias("draw"))
    key = F.concat_ws("|", "seed_", "replicate", "stratum", "draw")
    place = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.col("size")
    return d.groupBy("stratum", "size", "replicate", place.alias("place")).agg(F.count("*").alias("weight"))


def block_statistics(pairs: DataFrame) -> DataFrame:
    """Sums of each block by split and group: n, correct, base, eligible, failed, tokens."""
    one = lambda c: F.count_if(c)
    return pairs.groupBy("candidate_id", *BLOCK, "split", "grp").agg(
        F.count("*").alias("n"), one(passed()).alias("c"), one(base_passed()).alias("b"), one(base_passed() & ~passed()).alias("f"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tok")
    )


def samples(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """candidate_id, replicate and the METRICS of each replicate; null where a replicate lacks a metric's rows.

    A replicate's transfer is only defined if it has every group of the candidate.
    """
    st = strata(pairs)
    draws = hash_draws(st, replicates, seed)
    stats = block_statistics(pairs).join(st, ["candidate_id", *BLOCK])
    w = lambda c: F.sum(F.col(c) * F.col("weight")).alias(c)
    by_group = stats.join(draws, ["stratum", "size", "place"]).groupBy("candidate_id", "replicate", "split", "grp").agg(*map(w, ("n", "c", "b", "f", "tok")))
    return metrics(by_group, pairs)


def metrics(by_group: DataFrame, pairs: DataFrame) -> DataFrame:
    """candidate_id, replicate and the METRICS from a replicate's sums (n, c, b, f, tok) by split and group; sums without rows don't count."""
    groups = pairs.where("split = 'transfer'").groupBy("candidate_id").agg(F.count_distinct("grp").alias("groups"))
    by_group = by_group.where("n > 0")
    is_id, is_tr = F.col("split") == "id", F.col("split") == "transfer"
    part = lambda c: F.sum(F.when(is_id, F.col(c)))
    out = by_group.groupBy("candidate_id", "replicate").agg(
        (part("c") / part("n")).alias("accuracy"),
        ((part("c") - part("b")) / part("n")).alias("delta"),
        F.min(F.when(is_tr, F.col("c") / F.col("n"))).alias("least"),
        F.count(F.when(is_tr, F.lit(1))).alias("got"),
        (F.sum("tok") / F.sum("n")).alias("token_cost"),
        (F.sum("f") / F.nullif(F.sum("b"), F.lit(0))).alias("regression"),
    )
    out = out.join(groups, "candidate_id", "left")
    return out.select("candidate_id", "replicate", "accuracy", "delta", F.when(F.col("got") == F.col("groups"), F.col("least")).alias("transfer"), "token_cost", "regression")


def _bounds(metric: str, level: float) -> list[Column]:
    a = (1 - level) / 2
    p = F.percentile(metric, F.array(F.lit(a), F.lit(1 - a), F.lit(1 - level), F.lit(level)))
    return [p[i].alias(f"{metric}_{name}") for i, name in enumerate(("low", "high", "lcb", "ucb"))]


def estimates(points: DataFrame, draws: DataFrame, counts: DataFrame, level: float = 0.95, least_blocks: int = 2, token_bound: float | None = None) -> DataFrame:
    """Points with two-sided (low, high) and one-sided (lcb, ucb) bounds of all METRICS by candidate.

    ``points``: ``objectives``; ``draws``: ``samples``; ``counts``: ``block_counts``.  A metric with fewer than
    ``least_blocks`` blocks has its whole range as interval, tokens [0, ``token_bound``]; a regression that isn't
    defined is 1 in [0, 1].
    """
    b = draws.groupBy("candidate_id").agg(*[x for m in METRICS for x in _bounds(m, level)])
    t = points.join(counts, "candidate_id").join(b, "candidate_id", "left")
    ranges = {"accuracy": ("id_blocks", 0.0, 1.0), "delta": ("id_blocks", -1.0, 1.0), "transfer": ("transfer_blocks", 0.0, 1.0), "token_cost": ("blocks", 0.0, token_bound), "regression": ("base_correct_blocks", 0.0, 1.0)}
    cols = []
    for m, (n, low, high) in ranges.items():
        few = (F.coalesce(n, F.lit(0)) < least_blocks) | F.col(f"{m}_low").isNull()
        cols.append(F.col(m))
        for name in ("low", "high", "lcb", "ucb"):
            edge = low if name in ("low", "lcb") else high
            wide = F.raise_error(F.lit("a token bound is needed for so few blocks")).cast("double") if edge is None else F.lit(float(edge))
            cols.append(F.when(few, wide).otherwise(F.col(f"{m}_{name}")).alias(f"{m}_{name}"))
    return t.select("candidate_id", *cols, "blocks", "id_blocks", "transfer_blocks", "base_correct_blocks")


def cluster_samples(pairs: DataFrame, replicates: int, seed: int, own_seeds: bool = False) -> DataFrame:
    """candidate_id, target_id, replicate, accuracy, delta, regression, token_cost with tasks as clusters, by target.

    With ``own_seeds`` each candidate's target draws with a seed of its own.
    """
    tasks = pairs.groupBy("candidate_id", "target_id", "task_id").agg(
        F.count("*").alias("n"), F.count_if(passed()).alias("c"), F.count_if(base_passed()).alias("b"), F.count_if(base_passed() & ~passed()).alias("f"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tok")
    )
    w = Window.partitionBy("candidate_id", "target_id")
    placed = tasks.withColumn("place", F.row_number().over(w.orderBy("task_id")) - 1).withColumn("size", F.count("*").over(w)).withColumn("stratum", F.concat_ws("/", "candidate_id", "target_id"))
    placed = placed.withColumn("own_", own_seed(seed, F.concat_ws("\0", "candidate_id", "target_id")))
    draws = hash_draws(placed, replicates, "own_" if own_seeds else seed)
    s = placed.join(draws, ["stratum", "size", "place"]).groupBy("candidate_id", "target_id", "replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n", "c", "b", "f", "tok")])
    n = F.col("n")
    return s.select("candidate_id", "target_id", "replicate", (F.col("c") / n).alias("accuracy"), ((F.col("c") - F.col("b")) / n).alias("delta"), (F.col("f") / F.nullif(F.col("b"), F.lit(0))).alias("regression"), (F.col("tok") / n).alias("token_cost"))


def twister_samples(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``samples`` with draws by a Mersenne twister, for comparison with results that used one.

    Strata in the order of their signatures draw block after block, one generator for all replicates.  A candidate's
    blocks meet in one task; its replicates are one product of the draws' multiplicities and the blocks' sums.
    """
    columns = ["candidate_id", *BLOCK, "split", "target_id", "grp", "candidate_correct", "base_correct", "tokens"]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(grp=df["grp"].fillna(""))
        sign: dict = {}
        for key, g in df.groupby(BLOCK):
            sign[key] = tuple(sorted(zip(g["split"], g["target_id"], g["grp"])))
        blocks = sorted(sign)
        layout: dict = {}
        for i, k in enumerate(blocks):
            layout.setdefault(sign[k], []).append(i)
        draw, weights = random.Random(seed), np.zeros((replicates, len(blocks)))
        for r in range(replicates):
            for s in sorted(layout):
                members = layout[s]
                for _ in members:
                    weights[r, members[draw.randrange(len(members))]] += 1
        place = pd.Series(range(len(blocks)), index=pd.MultiIndex.from_tuples(blocks))
        at = place.loc[list(zip(df["task_id"], df["seed"]))].to_numpy()

        def total(values, mask) -> np.ndarray:
            return weights @ np.bincount(at, weights=np.asarray(values, float) * mask, minlength=len(blocks))

        c, b = df["candidate_correct"].to_numpy(float), df["base_correct"].to_numpy(float)
        is_id = (df["split"] == "id").to_numpy(float)
        div = lambda x, y: np.where(y > 0, x / np.where(y > 0, y, 1), np.nan)
        n_id = total(1 + 0 * c, is_id)
        worst = np.full(replicates, np.inf)
        whole = np.ones(replicates, bool)
        for _, m in df[df["split"] == "transfer"].groupby("grp").groups.items():
            mask = df.index.isin(m).astype(float)
            n = total(1 + 0 * c, mask)
            whole &= n > 0
            worst = np.minimum(worst, np.nan_to_num(div(total(c, mask), n), nan=np.inf))
        out = pd.DataFrame({"candidate_id": df["candidate_id"].iloc[0], "replicate": np.arange(replicates)})
        out["accuracy"], out["delta"] = div(total(c, is_id), n_id), div(total(c - b, is_id), n_id)
        out["transfer"] = np.where(whole & np.isfinite(worst), worst, np.nan)
        out["token_cost"] = div(total(df["tokens"], 1.0), total(1 + 0 * c, 1.0))
        out["regression"] = div(total(1 - c, b), total(b, 1.0))
        return out.astype(object).where(out.notna(), None)

    src = pairs.withColumn("tokens", (F.col("input_tokens") + F.col("output_tokens")).cast("double")).select(*columns)
    return src.groupBy("candidate_id").applyInPandas(one, "candidate_id string, replicate int, accuracy double, delta double, transfer double, token_cost double, regression double")
