"""Document fingerprints by a homomorphic multiset hash.

A paragraph (line) is hashed to a wide vector, and a document is the sum of its
paragraphs' vectors: the order of paragraphs doesn't matter, and a paragraph is
inserted or deleted by adding or subtracting its vector.  The vector has

* ``EXACT`` lanes modulo 2**64 from a 2048-bit digest of the paragraph (SHAKE-256), for equality of multisets: so wide
  that a second multiset with the same sums costs some 2**90 steps even by generalised birthday search;
* ``SKETCH`` lanes modulo 2**16, to which each pair of neighbouring words adds +1 or -1 in one lane, so that the
  cosine of two documents' lanes estimates how much of their wording they share (a signed count sketch is linear too).
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import arrow, cut, pieces, table

EXACT, SKETCH = 32, 256
#: Words that a worker remembers before it starts anew.
REMEMBERED = 500_000


class _Hashes(dict):
    """Word to its 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)
        return out


_known = _Hashes()


def vector(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the paragraphs' vectors: EXACT lanes (uint64) and SKETCH lanes (int64, not yet reduced)."""
    if not paragraphs:
        return np.zeros(EXACT, np.uint64), np.zeros(SKETCH, np.int64)
    digests = b"".join(hashlib.shake_256(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT) for p in paragraphs)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    seq = ["\n"]  # ends a paragraph and starts the next, so each pair belongs to one paragraph
    for p in paragraphs:
        seq += p.split()
        seq.append("\n")
    h = np.fromiter(map(_known.__getitem__, seq), np.uint64, len(seq))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(32)
    lane = (pair >> np.uint64(8)).astype(np.int64) & (SKETCH - 1)
    sign = 1 - 2 * (pair & np.uint64(1)).astype(np.int64)
    return exact, np.bincount(lane, weights=sign, minlength=SKETCH).astype(np.int64)


def add(a, b):
    """Fingerprint vector of the union of two multisets of paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a, b):
    """Fingerprint vector after the deletion of paragraphs."""
    return a[0] - b[0], a[1] - b[1]


def text_vector(text: str | None):
    """Vector of a whole text; null counts as empty, which is one empty paragraph."""
    return vector((text or "").split("\n"))


def encoded(v) -> str:
    """The fingerprint as text: all lanes, little-endian, in base 64."""
    return base64.b64encode(v[0].astype("<u8").tobytes() + (v[1] & 0xFFFF).astype("<u2").tobytes()).decode()


def decoded(fingerprint: str):
    """Vector of a fingerprint; SKETCH lanes are centred."""
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: EXACT * 8], "<u8").astype(np.uint64), np.frombuffer(raw[EXACT * 8 :], "<i2").astype(np.int64)


def likeness(a, b) -> float:
    """Estimated share of wording, 0 to 1; 1 for equal multisets of paragraphs."""
    if (a[0] == b[0]).all():
        return 1.0
    x, y = (v[1].astype(np.int16).astype(np.float64) for v in (a, b))
    return float(min(max(x @ y / max(np.sqrt((x @ x) * (y @ y)), 1e-9), 0.0), 1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row; nulls count as empty, repeated rows and null ids stay."""

    def step(batches):
        for part, texts in pieces(batches):
            yield arrow(doc_id=part.column(0), n_chars=[len(x or "") for x in texts], fingerprint=[encoded(text_vector(x)) for x in texts])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(step, "doc_id long, n_chars long, fingerprint string")


def replaced(text: str, new: str, v):
    """(text, vector) after the last third of ``text`` gives way to the beginning of ``new``: tail paragraphs are deleted and inserted."""
    n = len(text) // 3
    keep = len(text) - n
    edited = text[:keep] + new[:n]
    at = text.rfind("\n", 0, keep) + 1  # paragraphs before are the same
    v = add(subtract(v, vector(text[at:].split("\n"))), vector(edited[at:].split("\n")))
    return edited, v


def _own_task(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` parts, such that hashing these numbers to ``parts`` tasks gives each part a task of its own."""
    found: dict[int, int] = {}
    upto = 16 * parts + 64
    while len(found) < parts:
        got = spark.range(upto, numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
        found = {r.to: r.id for r in got}
        upto *= 2
    return [found[i] for i in range(parts)]


def _order(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part) with rows dealt by id ranges, largest ids first, and each part followed by the next part's first row.

    The bounds are quantiles of the ids (``parts`` numbers).  An id that holds a part's share of all rows or more, null
    among them, is cut further by ranges of its texts' hashes.  The row after a part is sent to it as well; after the
    last comes the first.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    quantiles = [int(x) for x in src.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    counts = src.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    # an id that is several quantiles holds several parts' share of the rows
    often: dict[int | None, int] = {i: k + 1 for i, k in Counter(quantiles).items() if k > 1}
    if counts.none * parts > counts.n:
        often[None] = -(-counts.none * parts // counts.n)
    bounds = sorted({*quantiles, *(x for i in often if i is not None for x in (i, i + 1) if x < 1 << 63)})
    # parts are numbered from the largest ids down; null ids come last
    part = F.lit(0)
    if bounds:
        part = len(bounds) - F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(part)
    pieces_ = F.lit(1)
    for i, k in often.items():
        pieces_ = F.when(F.col("doc_id").eqNullSafe(F.lit(i).cast("long")), k).otherwise(pieces_)
    most = max(often.values(), default=1)
    within = F.least(F.floor((F.col("hash") / float(1 << 64) + 0.5) * pieces_), pieces_ - 1)
    dealt = src.withColumn("part", (part * most + within).cast("int"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "hash").alias("first")
    heads = cut(dealt.select("part", first).groupBy("part").agg(F.min("first").alias("first")))
    order = [r.part for r in heads.select("part").orderBy("part").collect()]
    named = spark.createDataFrame([(p, order[i - 1], i, i - 1 if i else len(order) - 1) for i, p in enumerate(order)], "of int, before int, number int, to int") if order else None
    if named is None:
        return dealt.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("guest")).limit(0)
    heads = heads.join(F.broadcast(named), F.col("part") == F.col("of")).select("of", "to", "first.*")
    # of rows that agree in id and hash any is the first
    same = (F.col("part") == F.col("of")) & F.bitwise_not("doc_id").eqNullSafe(F.col("down")) & (F.col("hash") == F.col("h"))
    guests = dealt.join(F.broadcast(heads.withColumnRenamed("hash", "h")), same).dropDuplicates(["of"]).select("doc_id", "text", "hash", F.col("to").alias("part"), F.lit(True).alias("guest"))
    own = dealt.join(F.broadcast(named), F.col("part") == F.col("of")).select("doc_id", "text", "hash", F.col("number").alias("part"), F.lit(False).alias("guest"))
    tasks = _own_task(spark, len(order))
    rows = own.unionByName(guests).withColumn("task", F.element_at(F.array(*[F.lit(t).cast("long") for t in tasks]), F.col("part") + 1))
    return rows.repartition(len(order), "task").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "hash").select("doc_id", "text", "part", "guest")


def edits(docs: DataFrame) -> DataFrame:
    """The contract's table: each text, its edit with the next document (descending id), fingerprints and likenesses.

    Rows that share an id are ordered by their text's hash; null ids come last; a lone document is its own next;
    other columns are ignored, whatever their names; an empty table gives no row.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def step(batches):
        cur = None  # (id, text, vector, part) that waits for the next row
        out: list[tuple] = []
        done = None  # the part whose guest has been met

        for part, texts in pieces(batches):
            for doc, text, p, guest in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if guest and done == p:
                    continue
                v = text_vector(text)
                if cur is not None and cur[3] == p:
                    edited, ev = replaced(cur[1], text, cur[2])
                    out.append((cur[0], len(cur[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(cur[2]), encoded(ev), likeness(cur[2], ev), likeness(cur[2], v)))
                if guest:
                    done, cur = p, None
                else:
                    cur = (doc, text, v, p)
            if out:
                ids, *rest = zip(*out, strict=True)
                yield arrow(doc_id=pa.array(ids, pa.int64()), **dict(zip(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), rest, strict=True)))
                out = []

    return _order(docs, parts).mapInArrow(step, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return edits(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprint_multiset": op3}
SQL: dict[str, str] = {}
