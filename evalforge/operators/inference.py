"""Exact sign-flip tests and Holm's correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Differences of which all sign patterns are tried one by one, and of which halves are.
MOST_FLIPS, MOST_HALVES = 20, 40


def half_sums(d: np.ndarray) -> np.ndarray:
    """Sums of all sign patterns of a few differences."""
    out = np.zeros(1)
    for x in d:
        out = np.concatenate([out - x, out + x])
    return out


def halves_p(d: np.ndarray) -> float:
    """Exact two-sided p: a pattern is one of the first half and one of the second, so sorted sums of the second are searched for each of the first.

    Patterns whose mean is within 1e-15 of the observed one, or within rounding of its sum, count as equal to it.
    """
    n = len(d)
    a, b = half_sums(d[: n // 2]), np.sort(half_sums(d[n // 2 :]))
    edge = abs(float(d.sum())) - 1e-15 * n - 8 * np.finfo(float).eps * float(np.abs(d).sum())
    if edge <= 0:
        return 1.0
    up = len(b) - np.searchsorted(b, edge - a, side="left")
    down = np.searchsorted(b, -edge - a, side="right")
    return float(int(up.sum()) + int(down.sum())) / 2.0**n


def sign_flip_p(differences: str, most: int = MOST_HALVES) -> Column:
    """Exact two-sided p of an array of paired differences.

    Up to MOST_FLIPS, all 2**n sign patterns are tried by higher-order functions; up to MOST_HALVES, their halves meet in
    the middle, 2**(n/2) sums on either side.  More differences are an error; a null array has no p.
    Where ``most`` says that no row has over MOST_FLIPS, no Python runs.
    """
    d = F.col(differences)
    few = F.when(F.size(d) <= MOST_FLIPS, d)
    n = F.size(few)
    signed = lambda mask: F.aggregate(
        F.transform(few, lambda x, i: F.when(F.floor(mask / F.pow(F.lit(2), i)) % 2 == 1, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x
    )
    observed = F.abs(F.aggregate(few, F.lit(0.0), lambda a, x: a + x) / n)
    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)
    hits = F.size(F.filter(masks, lambda m: F.abs(signed(m) / n) + 1e-15 >= observed))

    @F.pandas_udf("double")
    def far(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else halves_p(np.asarray(x, float)) for x in column], dtype="float64")

    many = far(F.when(F.size(d).between(MOST_FLIPS + 1, MOST_HALVES), d)) if most > MOST_FLIPS else F.lit(None).cast("double")
    beyond = F.raise_error(F.lit(f"exact p of over {MOST_HALVES} differences")).cast("double")
    return F.when(F.size(d) > MOST_HALVES, beyond).when(F.size(d) > MOST_FLIPS, many).when(n > 0, hits / F.pow(F.lit(2), n))


def holm(df: DataFrame, p: str, name: str, family: list[str] | None = None) -> DataFrame:
    """Adds ``holm``: running maximum of min(1, (m - rank) p) over the family's rows by (p, name); null p stay null."""
    family = family or []
    w = Window.partitionBy(*family, F.col(p).isNull())
    rank = F.row_number().over(w.orderBy(p, name)) - 1
    step = df.withColumn("step", F.least(F.lit(1.0), (F.count("*").over(w) - rank) * F.col(p)))
    return step.withColumn("holm", F.when(F.col(p).isNotNull(), F.max("step").over(w.orderBy(p, name).rowsBetween(Window.unboundedPreceding, 0)))).drop("step")


def seed_contrasts(values: DataFrame, treatment: str, comparisons: list[str], seeds: list[int], higher_is_better: bool = True, incomplete: str = "undefined") -> DataFrame:
    """Paired contrasts of a treatment with each comparison over declared seeds, with exact p and Holm's p.

    ``values``: (method_id, search_seed, value).  A contrast with a missing or null value is undefined; ``incomplete``:
    "undefined" leaves the whole family without Holm's p then, "drop" corrects over the defined contrasts.
    """
    spark = values.sparkSession
    if not comparisons or treatment in comparisons or len(set(comparisons)) != len(comparisons) or len(set(seeds)) != len(seeds):
        raise ValueError("comparisons and seeds must be unique, without the treatment")
    grid = spark.createDataFrame([(c, s) for c in comparisons for s in seeds], "comparison string, search_seed long")
    v = values.select("method_id", F.col("search_seed").cast("long").alias("search_seed"), F.col("value").cast("double").alias("value"))
    t = v.where(F.col("method_id") == treatment).select("search_seed", F.col("value").alias("tv"))
    c = v.select(F.col("method_id").alias("comparison"), "search_seed", F.col("value").alias("cv"))
    d = (F.col("tv") - F.col("cv")) * (1 if higher_is_better else -1)
    rows = grid.join(t, "search_seed", "left").join(c, ["comparison", "search_seed"], "left").withColumn("d", d)
    order = F.array(*[F.lit(s).cast("long") for s in seeds])
    per = rows.groupBy("comparison").agg(F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct(F.array_position(order, F.col("search_seed")).alias("i"), "d")))).alias("x"), F.count_if(F.col("d").isNull()).alias("missing"))
    per = per.withColumn("differences", F.transform("x", lambda s: s["d"])).drop("x")
    per = per.withColumn("p", F.when(F.col("missing") == 0, sign_flip_p("differences", len(seeds)))).withColumn("mean", F.when(F.col("missing") == 0, F.aggregate("differences", F.lit(0.0), lambda a, x: a + x) / F.size("differences")))
    out = holm(per, "p", "comparison")
    if incomplete == "undefined":
        out = out.withColumn("holm", F.when(F.max("missing").over(Window.partitionBy()) == 0, F.col("holm")))
    return out.select("comparison", "differences", "missing", "mean", "p", "holm")
