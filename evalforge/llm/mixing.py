"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source is to be taken target / size times.  The whole part is
taken at once; the fractional part is a copy probability.  Two documents of about the
same size swap probability mass at a time, weighted by their sizes, so that one of the
two becomes 0 or 1 and the source's expected words stay exactly the same (the pivotal
method of Deville and Tille, 1998, in its weighted form).  Each block of documents
leaves one undecided; these residuals are paired again in a tree of ``FAN``-wide
levels until a source has no more than a block of them in each class of sizes.  At the
tree's root, a source's residuals settle from the largest down: each against the pool
of all smaller ones, which takes up the mass that it gains or loses.  So the words
that a source is off its target are about those of its smallest residuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents or residuals that one step of the tree pairs.
FAN = 48
SEED = 20240601
_SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(stats: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): shares of all words by weight, none above ``most`` times its size.

    Sources by code point, null last, take ``weights`` in turn.  The excess of a capped source goes to the others by
    weight until none is above: the largest level at which all caps hold.  It is found in one pass over sources in
    the order in which they reach their cap.  There is one row per source.
    """
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("reach", F.col("cap") / F.col("weight"))
    full = Window.partitionBy()
    up = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("level", (F.sum("source_size").over(full) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))))
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(full)["level"])
    return level.withColumn("target", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))).drop("rank", "cap", "reach", "level")


_DONE = "array<struct<k:struct<doc_id:bigint,size:bigint,text:bigint,n:bigint,sure:bigint>,extra:int>>"


def _chance(h: Column) -> Column:
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def _settled(unit: Column, extra) -> Column:
    return F.array(F.struct(unit["k"].alias("k"), F.lit(extra).cast("int").alias("extra")))


def _pair(acc: Column, x: Column) -> Column:
    """One pivotal step: of acc.held and x one becomes integral and joins acc.done, the other is held."""
    a, b = acc["held"], x
    wa, wb, pa, pb = a["w"], b["w"], a["p"], b["p"]
    sums = F.struct(F.least(wa * (1 - pa), wb * pb).alias("up"), F.least(wa * pa, wb * (1 - pb)).alias("down"))

    def chosen(s: Column) -> Column:
        up = _chance(F.xxhash64(a["h"], b["h"], F.lit(SEED))) * (s["up"] + s["down"]) < s["down"]
        held = lambda o, p: F.struct(o["o"].alias("o"), o["h"].alias("h"), o["k"].alias("k"), o["w"].alias("w"), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias("p"))
        both = lambda h, d: F.struct(h.alias("held"), F.concat(acc["done"], d).alias("done"))
        return F.when(
            up, F.when(wa * (1 - pa) <= wb * pb, both(held(b, pb - s["up"] / wb), _settled(a, 1))).otherwise(both(held(a, pa + s["up"] / wa), _settled(b, 0)))
        ).otherwise(F.when(wa * pa <= wb * (1 - pb), both(held(b, pb + s["down"] / wb), _settled(a, 0))).otherwise(both(held(a, pa - s["down"] / wa), _settled(b, 1))))

    return F.transform(F.array(sums), chosen)[0]


def _level(rows: DataFrame) -> DataFrame:
    """(source, class, blocks, block, held, done) from (.., unit): the units of a block, largest first, paired in turn."""
    keys = ["source", "class", "blocks", "block"]
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    first = F.struct(F.col("units")[0].alias("held"), F.expr("array()").cast(_DONE).alias("done"))
    return got.select(*keys, F.aggregate(F.slice("units", F.lit(2), F.size("units")), first, _pair).alias("r")).select(*keys, "r.held", "r.done")


def _root(rows: DataFrame) -> DataFrame:
    """Settles the last residuals, a few for each class of sizes, of each source: (source, k, extra).

    ``owed`` is what the larger ones gave to the pool (less what they took), ``room`` the mass that the pool can take
    up.  A unit is settled by chance as long as the pool can take up its mass, and else to the nearer side.
    """
    got = rows.groupBy("source").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    mass = lambda u: u["w"] * F.least(u["p"], 1 - u["p"])
    room = F.aggregate("units", F.lit(0.0), lambda a, u: a + mass(u))
    first = F.struct(F.lit(0.0).alias("owed"), room.alias("room"), F.expr("array()").cast(_DONE).alias("done"))

    def step(acc: Column, u: Column) -> Column:
        room, due = acc["room"] - mass(u), acc["owed"] + u["w"] * u["p"]
        edge = F.when(room >= 2 * u["w"], _chance(F.xxhash64(u["h"], F.lit(SEED + 1)))).otherwise(0.5)
        one = F.transform(F.array(F.struct(room.alias("room"), due.alias("due"), (due > edge * u["w"]).alias("take"))), lambda s: F.struct(F.when(s["take"], s["due"] - u["w"]).otherwise(s["due"]).alias("owed"), s["room"].alias("room"), F.concat(acc["done"], F.array(F.struct(u["k"].alias("k"), s["take"].cast("int").alias("extra")))).alias("done")))
        return one[0]

    return got.select("source", F.inline(F.aggregate("units", first, step)["done"]))


def _keys(docs: DataFrame) -> list[Column]:
    """What a document is known by: doc_id, source, size, text (a hash)."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text")]


def decided(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, text (hash), n, base, extra, source_size, target: of the ``n`` rows that agree in the first four, ``extra`` are taken base + 1 times, the others base times."""
    units = cut(docs.select(*_keys(docs)).groupBy("doc_id", "source", "size", "text").agg(F.count("*").alias("n")).withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")))
    kinds = units.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("units"))
    stats = targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "name")
    kinds = cut(kinds.join(stats, F.col("source").eqNullSafe(F.col("name"))).select("name", F.col("class").alias("c"), "units", "source_size", "target"))
    top = kinds.agg(F.max("units").alias("units"), F.count("*").alias("kinds")).first()
    kinds = F.broadcast(kinds) if top.kinds <= 100_000 else kinds  # checked: a few rows a source, or joined by shuffling
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(most))
    all_ = units.join(kinds, F.col("source").eqNullSafe(F.col("name")) & (F.col("class") == F.col("c"))).drop("name", "c").withColumns({"rate": rate, "h": F.xxhash64("doc_id", "size", "source", "text", F.lit(SEED))})
    # rows that agree share their expected copies: the whole part is sure, and one row has the rest
    hoped = F.col("n") * (F.col("rate") - F.floor("rate"))
    all_ = all_.withColumn("sure", F.floor(hoped).cast("long")).withColumn("p", hoped - F.floor(hoped))
    plain = (F.col("size") == 0) | (F.col("p") <= 0)
    k = F.struct("doc_id", "size", "text", "n", "sure")
    alone = all_.where(plain).select("source", k.alias("k"), F.when(_chance(F.col("h")) < F.col("p"), 1).otherwise(0).alias("extra"))
    unit = F.struct((-F.col("size")).alias("o"), "h", k.alias("k"), F.col("size").cast("double").alias("w"), "p")
    blocks = F.ceil(F.col("units") / FAN).cast("long")
    rows = all_.where(~plain).select("source", "class", blocks.alias("blocks"), F.pmod(F.xxhash64("h"), blocks).alias("block"), unit.alias("unit"))
    out, last, count = [alone], [rows.where("blocks <= 1")], -(-(top.units or 0) // FAN)
    while count > 1:
        level = cut(_level(rows.where("blocks > 1")))
        out.append(level.select("source", F.inline("done")))
        count = -(-count // FAN)
        rows = level.select("source", "class", F.ceil(F.col("blocks") / FAN).cast("long").alias("blocks"), F.floor(F.col("block") / FAN).alias("block"), F.col("held").alias("unit"))
        last.append(rows.where("blocks <= 1"))
    ends = last[0]
    for d in last[1:]:
        ends = ends.unionByName(d)
    done = cut(_root(ends))
    for d in out:
        done = done.unionByName(d)
    s = kinds.select("name", "source_size", "target").distinct()
    s = F.broadcast(s) if top.kinds <= 100_000 else s
    done = done.join(s, F.col("source").eqNullSafe(F.col("name")))
    return done.select("k.doc_id", "source", "k.size", "k.text", "k.n", F.floor(rate).cast("long").alias("base"), (F.col("k.sure") + F.col("extra")).alias("extra"), "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """How often each document is taken: doc_id, source, size, n, copies, source_size, target.

    A row stands for ``n`` input rows that agree in doc_id, source, text and copies; of rows that agree in the first
    three (repeated rows, null ids) some may be taken once more than the others.  Null text has size 0 and null is a
    source like any other.  Documents of size 0 are taken by chance, for they move no words.  An empty table gives no
    row; other columns are ignored, whatever their names.
    """
    d = decided(docs, weights, most)
    part = lambda n, more: F.struct(n.cast("long").alias("n"), (F.col("base") + more).alias("copies"))
    two = F.filter(F.array(part(F.col("extra"), 1), part(F.col("n") - F.col("extra"), 0)), lambda x: x["n"] > 0)
    return d.select("doc_id", "source", "size", F.inline(two), "source_size", "target").select("doc_id", "source", "size", "n", "copies", "source_size", "target")


#: Rows that one step makes of one row.
CHUNK = 4096


def _repeated(rows: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times; very frequent ones are spread over tasks."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("_n", n.cast("int"))
    few = rows.where(F.col("_n").between(1, CHUNK)).withColumn("_i", F.explode(F.sequence(F.lit(1), "_n")))
    many = rows.where(F.col("_n") > CHUNK).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(CHUNK)))).repartition(parts)
    many = many.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("_n") - F.col("_c"))))).drop("_c")
    return few.unionByName(many).drop("_n", "_i")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    d = cut(decided(docs))
    even = F.col("extra").isin(0) | (F.col("extra") == F.col("n"))
    keys = ["doc_id", "source", "size", "text"]
    named = docs.select(F.struct("*").alias("doc"), F.struct(*_keys(docs)).alias("key"))
    on = lambda t: named.join(t, F.expr(" and ".join(f"key.{c} <=> {c}" for c in keys)))
    all_ = d.where(even).withColumn("copies", F.col("base") + F.when(F.col("extra") > 0, 1).otherwise(0)).where("copies > 0").select(*keys, "copies")
    out = on(all_).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
    odd = d.where(~even).select(*keys, "base", "extra")
    if odd.isEmpty():
        return out
    # rows alike: those that agree in all columns are counted, and the first of them are taken once more
    alike = on(odd).groupBy("key", "doc", "base", "extra").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("extra") - before, F.lit(0)), F.col("k"))
    return out.unionByName(_repeated(alike.select("doc", (F.col("k") * F.col("base") + more).alias("total")), F.col("total")).select("doc.*"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``, one row per input row."""
    out = mix(table(spark, sf_dir, "documents"))
    each = out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "n")
    return _repeated(each, F.col("n")).drop("n")


QUERIES = {"op1_mixing_pivotal": op1}
SQL: dict[str, str] = {}
