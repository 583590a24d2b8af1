"""The pipeline's stages judge rows by themselves: null and repeated ids hide nothing."""

import random

from pyspark.sql import functions as F

from evalforge.llm import quality, simhash, toxicity

from test_quality_toxicity import corpus


def unnamed(docs):
    """Some rows again, without their id or under the id of another row."""
    some = docs.where("doc_id between 1 and 140")
    shared = some.where("doc_id % 5 = 0 or doc_id % 7 = 0").withColumn("doc_id", F.lit(1).cast("long"))
    return docs.unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(shared)


def test_toxic_and_poor_rows_go(spark):
    docs, labels = corpus(spark)
    both = unnamed(docs)
    model = toxicity.fit(both, labels)
    want = toxicity.score(both, model).where("score < 0.3")
    got = toxicity.keep_clean(both, labels)
    assert got.schema == both.schema
    assert got.where("doc_id is null").count() == want.where("doc_id is null").count() < 125
    assert got.where("doc_id = 1").count() == want.where("doc_id = 1").count() > 0
    good = quality.keep_good(both, labels)
    kept = quality.score(both, labels).where("kept")
    assert good.columns == both.columns and good.where("doc_id is null").count() == kept.where("doc_id is null").count() < 130
    assert good.where("doc_id = 1").count() == kept.where("doc_id = 1").count() > 0


def test_copies_without_id_go(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdefghijkl") * rnd.randrange(1, 5) for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (None, a), (2, b), (None, b), (None, c), (None, d), (None, d), (2, text()), (1, b)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (0, d), (2, rows[7][1])])
    assert rows[7][1] != b
