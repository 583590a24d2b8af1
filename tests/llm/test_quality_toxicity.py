import random

import numpy as np

from evalforge.llm import quality, toxicity


def slow_segments(scores):
    """All maximal segments by their definition: repeatedly the best one, then both sides of it (Ruzzo and Tompa, 1999)."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or (at and abs(total - best) < 1e-9 and j - i < at[1] - at[0] - 1):
                best, at = max(total, best), (i, j + 1)
    if at is None:
        return []
    return slow_segments(scores[: at[0]]) + [(at[0], at[1], best)] + [(s + at[1], e + at[1], v) for s, e, v in slow_segments(scores[at[1] :])]


def test_segments():
    rnd = random.Random(1)
    for _ in range(60):
        scores = np.array([rnd.choice([-0.13, -0.13, -0.13, 1.07, 2.31]) for _ in range(rnd.randrange(40))])
        got = sorted((s, e, round(v, 6)) for s, e, v in toxicity.segments(scores, -0.13))
        assert got == sorted((s, e, round(v, 6)) for s, e, v in slow_segments(list(scores)))


def corpus(spark, n=900):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(30, 150))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Rotten,", "vile", "zq" + word()]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "no id", "en", "s", 5), (0, rows[0][1], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 2"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    held = [(r.doc_id % 5 == 0, r.score >= toxicity.THRESHOLD) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert 0 <= r.score <= 1
        for p in r.passages:
            assert 0 <= p.start < p.end <= len(texts[r.doc_id])
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).select("score").distinct().count()
    assert empty == 1


def test_held_out_quality(spark):
    docs, labels = corpus(spark)
    got = quality.score(docs, labels.where("doc_id % 4 <> 2")).collect()
    assert len(got) == docs.count()
    held = [(r.doc_id % 7 != 0, r.kept) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.score(docs, labels.limit(0)).select("score").distinct().count() == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_queries(spark, tmp_path):
    """The contracts' columns; a null id is not held out; labels of held-out rows change no score."""
    import zlib

    docs, labels = corpus(spark, 400)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op7(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other.write.mode("overwrite").parquet(f"{tmp_path}/two/labels.parquet")
    docs.write.parquet(f"{tmp_path}/two/documents.parquet")
    again = {(r.doc_id, r.score) for r in toxicity.op7(spark, f"{tmp_path}/two").collect()}
    assert {i for i, _ in again} == {r.doc_id for r in got}
    assert quality.op2(spark, str(tmp_path)).columns[:2] == ["doc_id", "score"]


def test_log_odds():
    """Evidence counts both ways and grows with the number of documents; one document tells little."""
    telling = lambda c, t: toxicity.telling_odds(c, t, 800, 100)
    other = lambda c, t: toxicity.other_odds(c, t, 80_000, 10_000)
    assert telling(0, 30) > telling(0, 8) > telling(0, 2) > 0 > telling(60, 0)
    assert other(100, 800) > other(400, 400) > 0 > other(9000, 300)
    assert other(8000, 1000) == other(0, 1) == other(0, 0) == 0


def test_long_texts_and_clashing_names(spark):
    rows = [(i, "calm words " * 30 + ("vile " * 3 if i % 4 == 0 else ""), "en", "s", 1, 0.5, True) for i in range(80)] + [(500, "calm vile words " * 60000, None, None, None, 0.1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, toxic boolean")
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 4 == 0) for i in range(80)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 81
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert quality.score(docs, labels).count() == 81 and quality.keep_good(docs, labels).columns == docs.columns


def test_exchange_is_kept_only_if_it_helps():
    """Of a round's weights, each view keeps those with which held rows are told apart best."""
    r = np.random.default_rng(1)
    y = (r.random(300) < 0.5).astype(float)
    x = {"c": np.column_stack([y + r.normal(0, 0.6, 300), r.normal(size=300)]), "m": np.column_stack([y + r.normal(0, 1.5, 300)])}

    def learners():
        return {v: quality.Learner.start(x[v][:150], y[:150]) for v in "cm"}

    held = {v: x[v][150:] for v in "cm"}
    for spoiled, better in ((("c",), ()), (("m",), ()), (("c", "m"), ()), ((), ("c",)), (("m",), ("c",))):
        own = learners()
        good = {v: l.beta for v, l in own.items()}
        noise = {v: r.normal(size=len(b)) * 3 for v, b in good.items()}
        before = {v: noise[v] if v in better else good[v] for v in "cm"}
        for v, l in own.items():
            l.beta = noise[v] if v in spoiled else good[v]
        assert quality._gained(own, before, held, y[150:]) == bool(better)
        for v in "cm":
            want = good[v]
            assert own[v].beta is want or (own[v].beta == want).all()
