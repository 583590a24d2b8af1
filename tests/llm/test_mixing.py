import random

from pyspark.sql import functions as F

from evalforge.llm import mixing


def slow_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in rest) for s in names}
        over = {s for s in rest if t[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return t
        capped |= over


def test_targets(spark):
    rnd = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i}": rnd.choice([0, 1, 10, 1000, 50000]) + rnd.randrange(50) for i in range(9)} | {None: 77, "S": 0}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want), (got, want)


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " \x0b".join(["wörd"] * rnd.choice([0, 1, 5, 40, 300])) + rnd.choice(["", "\n", " "]), rnd.choice(["a", "a", "a", "b", "c", "ä", None]), 1) for i in range(1500)]
    rows += [(None, "x y", "a", 1), (7000, None, None, 1), (7001, "p q r", "b", 1), (7001, "p q r", "b", 1), (7001, "p q", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert sum(r.n for r in got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want, taken, big = slow_targets(size), {}, {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size * r.n
        big.setdefault(r.source, set()).add(r.size)
    # off by no more than a small document's words
    assert all(abs(taken[s] - want[s]) <= max(min(big[s] - {0}, default=0) + 1e-6, 0.002 * want[s]) if len(big[s]) > 3 else max(big[s]) for s in want), (taken, want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {(r.doc_id, r.source, r.text): r["count"] for r in out.groupBy("doc_id", "source", "text").count().collect()}
    copies = {}
    for r in got:
        copies[r.doc_id, r.source, r.size] = copies.get((r.doc_id, r.source, r.size), 0) + r.copies * r.n
    for d, t, s, _ in set(rows):
        assert counts.get((d, s, t), 0) == copies[d, s, len((t or "").split())]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where(F.col("text").isNull())).collect()[0].target == 0


def test_every_document_can_be_taken(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    rate = mixing.mix(docs).where("source = 'a'").agg(F.sum(F.col("copies") * F.col("size")) / F.max("target")).first()[0]
    assert abs(rate - 1) < 0.02


def test_rows_alike_are_split(spark):
    """Rows without an id, or repeated ones, are taken one by one: 2,000 that agree in all don't go all together."""
    rows = [(None, "one two three", "a", i % 2) for i in range(6000)] + [(i, "w " * (i % 50 + 1), "b", 0) for i in range(1200)] + [(3, "x " * 400, "b", 1)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    got = mixing.mix(docs).collect()
    assert sum(r.n for r in got) == len(rows)
    for s in "ab":
        taken = sum(r.copies * r.size * r.n for r in got if r.source == s)
        assert abs(taken - next(r.target for r in got if r.source == s)) <= 3
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {s: sum(r.copies * r.size * r.n for r in got if r.source == s) for s in "ab"}
    most = out.groupBy("doc_id", "text", "source", "more").count().collect()
    assert all(r["count"] <= 3 * rows.count(tuple(r)[:4]) for r in most)


def test_query(spark, tmp_path):
    """One row per input row, and each source near its target."""
    rnd = random.Random(6)
    rows = [(rnd.choice([i, None, 5]), "w " * int(rnd.paretovariate(0.9) * 5 % 4000), rnd.choice(["a", "b", "c", "c", "c", None])) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((d or -1, s or "", len(t.split())) for d, t, s in rows)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
        assert r.taken <= 3 * r.size
    assert all(abs(sum(v) - t) < 0.01 * t for (_, t), v in by.items())
