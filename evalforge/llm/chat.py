"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is in turn the assistant: the dialogue is
rendered once for each, with all others as named users, and only the chosen
speaker's texts are trained on.  The rendered dialogue is kept as segments, one
row a turn, with offsets into the whole: a conversation of any length is never
gathered in one task.  Turns are dealt to ranges; offsets are prefix sums in two
levels, over the ranges (from counts and lengths alone) and within each range, so
that texts are shuffled twice and no more.  Texts and names can't forge a turn:
"<|", which begins every control token, is broken up in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import cut, staged, table

#: Role whose turns are instructions to all, not a participant's.
SYSTEM = "system"
#: Name of the speaker of turns without a role.
UNNAMED = "unknown"
START, STOP = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """A text in which no control token can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(who: str, speaker: Column) -> Column:
    """What a turn of ``who`` begins with as ``speaker`` sees it; a null speaker is nobody's name."""
    name = escaped(F.regexp_replace(who, r"[\x00-\x1F\x7F]", " "))
    return F.when(F.col(who) == SYSTEM, F.lit(f"{START}system\n")).when(F.col(who) == speaker, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row for each turn and perspective: conv_id, speaker, turn, role, segment, start, train_start, train_end, train.

    ``speaker`` is the participant who is the assistant; ``start`` is the segment's offset (code points) in the
    dialogue as that perspective renders it; [train_start, train_end) is the part of the dialogue to train on, empty
    unless ``train``.  System turns belong to all perspectives; a conversation of system turns alone has none.  Null
    roles are named "unknown", null texts are empty, turns with a null number come first; turns that share a number
    are ordered by role and text, repeated rows stay; a null conv_id is a conversation; other columns are ignored; an
    empty table gives no row.  In a segment, "<|" of a text or role reads "< |", and control characters of a role are
    spaces.
    """
    spark = conversations.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    src = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("who"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said")
    )
    # ranges of turns; rows that agree in all columns may lie anywhere, for they are alike
    ranges = src.repartitionByRange(parts, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "who", "said").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "who", "said")
    rows = staged(ranges.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id(), "size": F.length(escaped(F.col("said"))).cast("long")}))
    # a row for each participant of a conversation in each range: what all turns there, and what the speaker's own, add
    own = rows.groupBy("part", "conv_id", "who").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    own = cut(own.withColumn("long", F.col("size") + F.col("n") * (F.length(_head("who", F.lit(None).cast("string"))) + len(STOP))))
    people = own.where(F.col("who") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("who").alias("speaker")).distinct()
    ranges = own.groupBy("part", "conv_id").agg(F.sum("long").alias("long"))
    seen = ranges.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    mine = own.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.col("who").alias("w"), "n")
    seen = seen.join(mine, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("w")), "left")
    saved = F.length(_head("speaker", F.lit(None).cast("string"))) - F.length(_head("speaker", F.col("speaker")))
    total = F.col("long") - F.coalesce("n", F.lit(0)) * saved
    over = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = seen.select(F.col("conv_id").alias("c"), "speaker", F.col("part").alias("p"), F.coalesce(F.sum(total).over(over), F.lit(0)).alias("before"))
    spread = rows.join(before, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("p", "c")
    head = _head("who", F.col("speaker"))
    inside = Window.partitionBy("part", "conv_id", "speaker").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.length(head) + F.col("size") + len(STOP)).over(inside), F.lit(0))
    out = spread.withColumn("start", start.cast("long")).withColumn("train", F.col("who") == F.col("speaker"))
    at = F.col("start") + F.length(head)
    return out.select("conv_id", "speaker", "turn", F.col("who").alias("role"), F.concat(head, escaped(F.col("said")), F.lit(STOP)).alias("segment"), "start", F.when(F.col("train"), at).otherwise(F.col("start")).cast("long").alias("train_start"), F.when(F.col("train"), at + F.col("size") + len(STOP) - 1).otherwise(F.col("start")).cast("long").alias("train_end"), "train")


def rendered(conversations: DataFrame) -> DataFrame:
    """Whole dialogues: conv_id, speaker, text, spans (array of start, end to train on).  For conversations that fit in a row."""
    r = rotate(conversations).groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "train", "train_start", "train_end"))).alias("x"))
    return r.select("conv_id", "speaker", F.array_join(F.transform("x", lambda s: s["segment"]), "").alias("text"), F.transform(F.filter("x", lambda s: s["train"]), lambda s: F.struct(s["train_start"].alias("start"), s["train_end"].alias("end"))).alias("spans"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All perspectives of all ``conversations``."""
    return rotate(table(spark, sf_dir, "conversations"))


_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS own,
         replace(coalesce(text, ''), '<|', '< |') AS said, replace(regexp_replace(coalesce(role, 'unknown'), '[\x00-\x1F\x7F]', ' ', 'g'), '<|', '< |') AS name
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), s AS (
  SELECT t.conv_id, p.speaker, t.turn, t.role, t.said, t.own,
         CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN t.role = p.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || t.name || chr(10) END AS head
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment,
         CAST(coalesce(sum(length(head || said) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, own
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s
)
SELECT conv_id, speaker, turn, role, segment, start,
       CAST(CASE WHEN role = speaker THEN start + length(head) ELSE start END AS BIGINT) AS train_start,
       CAST(CASE WHEN role = speaker THEN start + length(head) + length(said) + 10 ELSE start END AS BIGINT) AS train_end,
       role = speaker AS train
FROM o
"""
QUERIES = {"op10_chat_rotation": op10}
SQL = {"op10_chat_rotation": _SQL}
