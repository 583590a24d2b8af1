"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points other than ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one Python step turns into objects at a time.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests) a temporary folder of this machine is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evalforge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_staged: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: columnar, for tables too large for ``cut``.

    The files stay until ``release``, for the result may be read again at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_now() -> int:
    """How many staged tables there are, for ``release``."""
    return len(_staged)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that ``staged`` wrote in this process after ``since`` others; call it once results are written.  Returns their number."""
    n = 0
    while len(_staged) > since:
        n += remove(spark, _staged.pop())
    return n


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def bounded(df: DataFrame, key, rows: int) -> DataFrame:
    """At most ``rows`` of the rows of ``df``: those with the smallest ``key`` (a hash, a long), found by a histogram of its upper 16 bits.

    The driver reads 65,536 counts at most, and nothing is sorted.  Rows that share a key come or go together.
    """
    slot = F.shiftrightunsigned(key, 48).cast("int")
    sizes = sorted((r.slot, r["count"]) for r in df.groupBy(slot.alias("slot")).count().collect())
    if sum(n for _, n in sizes) <= rows:
        return df
    edge, room = 0, rows
    for at, n in sizes:
        if n > room:
            break
        room -= n
        edge = at + 1
    return df.where(slot < edge)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Within it, what runs sends so many rows at a time to Python, so that neither side holds much text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within it, a write deletes its shuffle files as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def pieces(batches, column: str = "text"):
    """Slices of Arrow batches that hold few enough rows to become Python objects, with the text column as a list."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column(batch.schema.get_field_index(column)).to_pylist()


def arrow(**columns) -> pa.RecordBatch:
    """A record batch of named arrays."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in columns.values()], list(columns))


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus
