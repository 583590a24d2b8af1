"""SimHash near-dedup by segment popcounts.

A 64-bit fingerprint is mapped to the popcounts of sixteen 4-bit segments.  The
Manhattan distance of two such vectors is a lower bound of the fingerprints'
Hamming distance, so all links lie within Manhattan distance 2.  Two lattice
points at that distance share a lattice point at distance 1 or less from both:
each fingerprint is sent to that unit ball (33 grid cells at most) and meets its
partners there.  Candidates are verified on the bits.  Work is on *distinct*
fingerprints, so a group of exact copies is one row.

A cell that holds over ``PAIRS_UP_TO`` distinct fingerprints isn't expanded into
pairs: its members go to their 64 one-bit variants, and those that share a
variant (exactly those at distance 2 or less) are linked to its smallest member.
That is linear in the group and loses no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import arrow, cut, pieces, staged, table

SEGMENTS, BITS = 16, 4
#: A cell's run of fingerprints is compared pairwise up to this length; longer runs take the linear way.
PAIRS_UP_TO = 48
SEED = 42
#: Fingerprints of over one in so many rows are joined by a broadcast of so many rows at most.
HOT = 1000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    if width == 3:
        hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for at in range(0, len(h), 65536):  # memory stays bounded for very long texts
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for each row; null texts count as empty."""

    def step(batches):
        for part, texts in pieces(batches):
            fp = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
            yield arrow(doc_id=part.column(0), fp=fp)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(step, "doc_id long, fp long")


def _grid(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint at the lattice points within Manhattan distance 1 of its popcount vector, three bits a coordinate."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(2**BITS - 1).cast("long"))).cast("long") for i in range(SEGMENTS)]
    at = counts[0]
    for i in range(1, SEGMENTS):
        at = at + F.shiftleft(counts[i], 3 * i)
    home = fps.select("fp", at.alias("home"))
    moves = [F.col("home")]
    for i in range(SEGMENTS):
        one, here = F.lit(1 << (3 * i)).cast("long"), F.shiftrightunsigned("home", 3 * i).bitwiseAND(F.lit(7).cast("long"))
        moves += [F.when(here < BITS, F.col("home") + one), F.when(here > 0, F.col("home") - one)]
    return home.select("fp", F.explode(F.array_compact(F.array(*moves))).alias("cell"))


def _links(batches):
    """Over rows sorted by (cell, fp): verified pairs of short runs as (a, b, 0), members of long runs as (fp, fp, 1)."""
    held_c, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
    hot_cell = None  # a cell whose run is too long already: its members go on as they come, and none is held

    def members(f):
        f = np.unique(f)
        return arrow(a=f, b=f, hot=np.ones(len(f), bool))

    def emit(c, f):
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[starts, len(c)])
        length = np.repeat(sizes, sizes)
        many = length > 1
        c, f, length = c[many], f[many], length[many]
        short = length <= PAIRS_UP_TO
        cs, fs = c[short], f[short]
        out_a, out_b, hot = [], [], []
        for d in range(1, int(length[short].max(initial=1))):
            same = np.flatnonzero(cs[d:] == cs[:-d])
            a, b = fs[same], fs[same + d]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= 2) & (a != b)
            out_a.append(a[near])
            out_b.append(b[near])
        long_run = np.unique(f[~short])
        a = np.concatenate([*out_a, long_run]).astype(np.int64)
        b = np.concatenate([*out_b, long_run]).astype(np.int64)
        hot = np.r_[np.zeros(len(a) - len(long_run), bool), np.ones(len(long_run), bool)]
        return arrow(a=a, b=b, hot=pa.array(hot))

    for batch in batches:
        c = np.concatenate([held_c, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if hot_cell is not None:
            more = int(np.searchsorted(c, hot_cell, side="right"))
            if more:
                yield members(f[:more])
            c, f = c[more:], f[more:]
        if not len(c):
            continue
        last = int(np.searchsorted(c, c[-1]))  # the last run may go on in the next batch
        held_c, held_f = c[last:], f[last:]
        if last:
            yield emit(c[:last], f[:last])
        hot_cell = None
        if len(held_c) > PAIRS_UP_TO:
            hot_cell = c[-1]
            yield members(held_f)
            held_c, held_f = held_c[:0], held_f[:0]
    if len(held_c):
        yield emit(held_c, held_f)


def _variants(hot: DataFrame) -> DataFrame:
    """Star edges of the fingerprints that share a variant of one changed bit or none."""
    flips = [F.lit(0).cast("long")] + [F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]
    spread = hot.select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    centre = spread.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("variant", "a")
    return spread.join(centre, "variant").where("fp <> a").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a < b) over distinct fingerprints that give the same components as all links of 2 or fewer differing bits."""
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = cut(_grid(fps).repartition(parts, "cell").sortWithinPartitions("cell", "fp").select("cell", "fp").mapInArrow(_links, "a long, b long, hot boolean"))
    pairs = found.where("not hot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    return pairs.unionByName(_variants(hot)).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of undirected edges (a, b) by alternating large-star and small-star rounds; root is the smallest node.

    Kiveris et al., "Connected components in MapReduce and beyond", 2014.  Each round is a fixed number of
    equi-joins and aggregates; the state is checkpointed in the shared folder.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """``fps``, one row a fingerprint, with the root of its component."""
    comp = components(links(fps.select("fp")))
    return fps.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links of two or fewer bits).

    Null or empty texts have fingerprint 0 and are linked like any other; a null id takes part in links but is
    never the smallest, so a component of null ids alone has a null component_id; repeated rows stay; an empty
    table gives no row; other columns of ``docs`` are ignored, whatever their names.
    """
    own = cut(fingerprints(docs, id_col, text_col))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    rooted = _rooted(fps)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(rooted.join(least, "root").select("fp", "component_id", "n"))
    # copies of one text: the fingerprints of more than a thousandth of all rows, a thousand at most, are broadcast
    edge = (fps.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    often = F.broadcast(by_fp.where(F.col("n") >= edge).select("fp", F.col("component_id").alias("often"), F.lit(True).alias("found")))
    told = own.join(often, "fp", "left")
    rare = told.where("found is null").select("doc_id", "fp").join(by_fp.where(F.col("n") < edge).select("fp", "component_id"), "fp")
    return told.where("found").select("doc_id", "fp", F.col("often").alias("component_id")).unionByName(rare.select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per component: that with the smallest id, or of null ids alone, the first by its columns' hash.

    Each row is judged by its own fingerprint; of rows that share the smallest id, the first by hash stays.
    """
    lower = [c.lower() for c in docs.columns]
    text, key = f"d{lower.index(text_col.lower())}", F.col(f"d{lower.index(id_col.lower())}").cast("long")
    flat = docs.toDF(*[f"d{i}" for i in range(len(lower))])

    def step(batches):
        for part, texts in pieces(batches, text):
            fp = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            yield arrow(**{c: part.column(c) for c in part.schema.names}, fp=fp)

    carried = flat.mapInArrow(step, T.StructType([*flat.schema.fields, T.StructField("fp", T.LongType())]))
    # the row number is fixed by writing the table
    own = staged(carried.withColumns({"hash": F.xxhash64(*flat.columns), "row": F.monotonically_increasing_id()}))
    fps = cut(own.groupBy("fp").agg(F.min(F.struct(key.isNull().alias("none"), key.alias("id"), "hash", "row")).alias("first")))
    kept = _rooted(fps).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    out = own.join(kept, "row", "left_semi")
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``."""
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9}
SQL: dict[str, str] = {}
