import random

from pyspark.sql import functions as F

import corpus_pipeline
from evalforge.llm import mixing, packing, simhash


def corpus(spark, path):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rnd.randrange(25, 120))]
        kind = "toxic" if i % 9 == 0 else "junk" if i % 7 == 0 else "good"
        if kind == "toxic":
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum"]))
        if kind == "junk":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words).capitalize() + ".", "en", rnd.choice(["s1", "s2", None]), kind))
        if i % 4:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows += [(2000 + i, rows[1][1], "en", "s1", "good") for i in range(70)]  # exact copies
    rows += [(3000, rows[2][1] + " tail", "en", "s2", "good"), (3001, None, None, None, "empty"), (3002, "", "en", "s1", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string").withColumn("n_chars", F.length("text").cast("long"))
    docs.drop("kind").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r for r in rows}


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != "packing":
            assert docs.columns == names
            assert docs.join(before, [docs[c].eqNullSafe(before[c]) for c in names], "left_anti").count() == 0
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    kinds = lambda ids: {k: sum(rows[i][4] == k for i in ids) for k in ("toxic", "junk", "good", "empty")}
    all_, t, q = kinds(rows), kinds(kept["toxicity"]), kinds(kept["quality"])
    assert t["toxic"] <= 0.03 * all_["toxic"] and t["good"] >= 0.99 * all_["good"] and t["junk"] >= 0.97 * all_["junk"]
    assert q["junk"] == 0 and q["good"] >= 0.99 * t["good"]
    # one of each group, by comparing all pairs
    left = sorted(kept["quality"])
    fp = {i: simhash.fingerprint(rows[i][1]) for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(kept["dedup"]) == sorted(i for i in left if find(i) == i)
    # the mix keeps each source's words near its target
    mixed = spark.read.parquet(f"{tmp_path}/out3").groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    want = {r.source: r.target for r in mixing.mix(spark.read.parquet(f"{tmp_path}/out2")).collect()}
    assert all(abs(r.n - want[r.source]) < 130 for r in mixed)
    # every copy is packed once
    known = packing.words(packing.default_tokenizer())
    ids = sum(len(known.ids(rows[i][1] or "")) + 1 for i in kept["mixing"])
    assert docs.agg(F.sum("length")).first()[0] == ids
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_entry(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] and names["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, and repeated ids; nothing but the last result is left in the shared folder."""
    import os

    from evalforge.llm import _base

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    spark.createDataFrame([(1, words(i), "en", "s", 5) for i in range(20)] + [(None, words(3), None, None, None)], shape).write.parquet(f"{tmp_path}/same/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/same/labels.parquet")
    mark = _base.staged_now()
    out = corpus_pipeline.run(spark, f"{tmp_path}/same")
    assert out.agg(F.sum("length")).first()[0] > 0 and _base.staged_now() == mark
    folder = _base.shared_dir(spark).removeprefix("file:")
    left = [n for n in os.listdir(folder) if n.startswith("pipeline-")]
    assert all(n.endswith("packing") for n in left)
