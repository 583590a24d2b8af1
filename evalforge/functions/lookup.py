"""Joins with a table of one row a key, whatever share of the rows one key holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut

#: Keys of over one in so many rows are broadcast, so many keys at most.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``table`` (one row a key; null keys equal each other), null where it has none.

    The rows of frequent keys get theirs from a broadcast of ``HOT`` keys at most, the others by a join.
    """
    more = [c for c in table.columns if c not in keys]
    same = lambda a, b: reduce(lambda p, q: p & q, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows_"))
    sized = cut(table.alias("t").join(counts.alias("c"), same("t", "c")).select("t.*", "rows_"))
    edge = rows.count() // HOT + 1
    often = sized.where(F.col("rows_") >= edge).select(*keys, *more, F.lit(True).alias("found_"))
    told = rows.alias("r").join(F.broadcast(often).alias("o"), same("r", "o"), "left").select("r.*", *[f"o.{c}" for c in more], "found_")
    rare = told.where("found_ is null").select(*rows.columns)
    other = sized.where(F.col("rows_") < edge).select(*keys, *more)
    joined = rare.alias("r").join(other.alias("o"), same("r", "o"), "left").select("r.*", *[f"o.{c}" for c in more])
    return told.where("found_").drop("found_").unionByName(joined)
