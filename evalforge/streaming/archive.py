"""Archive admission over a stream of scored candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions at ``path`` that were committed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("version=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def front_sink(path: str, run: str = "run_id", keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps each run's front at ``path``, a table of versions by batch.

    The front of old and new entries is the front of the old front and the new entries, so a batch reads one front and
    not the history.  The old front is the last version that was committed before the batch; a batch that is run again
    writes the same version again.  A version that can't be read is an error.  The last ``keep`` versions stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < number]
        new = batch.where(F.size("reasons") == 0)
        pool = new.unionByName(spark.read.parquet(f"{path}/version={before[-1]}")) if before else new
        pool = pool.dropDuplicates([run, "candidate_id"])
        archive.scientific_front(pool, run).write.mode("overwrite").parquet(f"{path}/version={number}")
        for v in before[: max(len(before) + 1 - keep, 0)]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return merge


def usage_by_window(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Calls and tokens by provider and event-time window, with a watermark for late rows."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "provider_id").agg(F.count("*").alias("provider_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select("window.start", "window.end", "provider_id", "provider_calls", "input_tokens", "output_tokens")
