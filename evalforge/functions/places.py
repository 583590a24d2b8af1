"""Numbers within groups without a window: no group has to fit a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .lookup import lookup


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``place`` (long, from 0 in ``order`` within the group) and ``size`` (rows of the group).

    Rows are sorted by a range partitioning over group and order; a row's place is its place in its partition plus the
    rows that its group has in the partitions before.  Rows that agree in group and order come in any order.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*group, *order]
    dealt = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"part_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}))
    held = dealt.groupBy(*group, "part_").agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    all_ = held.groupBy(*group).agg(F.sum("n_").alias("size"), F.collect_list(F.struct("part_", "n_")).alias("parts_"))  # a group has as many rows here as there are partitions, at most
    earlier = F.aggregate(F.filter("parts_", lambda x: x["part_"] < F.col("part_")), F.lit(0).cast("long"), lambda a, x: a + x["n_"])
    starts = lookup(held, all_, group).select(*group, "part_", "size", (F.col("first_") - earlier).alias("from_"))
    return lookup(dealt, starts, [*group, "part_"]).withColumn("place", F.col("row_") - F.col("from_")).drop("part_", "row_", "from_")
