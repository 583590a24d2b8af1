"""Proposals, controllers' parts and budgets."""

import pytest

from evalforge.operators import search
from evalforge.plans import searching

IDS = ["a", "b", "c", "d"]


def test_stream(spark):
    s = search.SubsetStream(IDS, 0.5, 3)
    first = s.ask(5)
    copy = search.SubsetStream.restore(s.state())
    assert s.ask(4) == copy.ask(4) and len(set(first)) == 5
    everything = first + search.SubsetStream.restore(s.state()).ask(s.remaining())
    assert len(everything) == 11 and s.remaining() == 6
    got = search.unique(search.bernoulli(search.patches(spark, IDS), 0, s.next_draw, 0.5, 3)).orderBy("draw").collect()
    assert [tuple(r.subset) for r in got][:5] == first
    stuck = search.SubsetStream(["a"], 0.0, 1, patience=5)
    with pytest.raises(ValueError):
        stuck.ask(1)
    assert stuck.next_draw == 0
    with pytest.raises(ValueError):
        s.ask(100)


def test_subsets(spark):
    d = search.diverse(["b", "a", "c"], 5, 1)
    assert d[0] == ("a", "b", "c") and d[1:4] == [("a",), ("b",), ("c",)] and len(set(d)) == 5
    rows = spark.createDataFrame([(["b", "a"],), (["z"],), (["a", "a"],), ([],)], "subset array<string>")
    got = search.canonical_subsets(rows, search.patches(spark, IDS)).collect()
    assert [(r.subset, r.problem) for r in got] == [(["a", "b"], None), ([], "unknown_patch"), (["a"], "repeated_patch"), ([], "empty")]
    pending = spark.createDataFrame([(["a"],), (["b"],)], "subset array<string>")
    scored = spark.createDataFrame([(["a"],), (["a"],), (["c"],)], "subset array<string>")
    assert {(r.subset, r.problem) for r in search.feedback_problems(pending, scored).collect()} == {("b", "missing"), ("c", "extra"), ("a", "repeated")}


def test_offspring(spark):
    got = searching.genetic_offspring(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 40 and all(r.subset and set(r.subset.split(",")) <= set(searching.IDS) for r in got)
    pop = spark.createDataFrame([("c1", "h1", ["a", "b"], 1.0, 1.0), ("c2", "h2", ["c"], 0.0, 0.0)], "candidate_id string, content_hash string, subset array<string>, v1 double, v2 double")
    same = search.offspring(pop.where("v1 > 0"), search.patches(spark, IDS), 0, 6, 1, mutation=0.0)
    assert {tuple(r.subset) for r in same.collect()} == {("a", "b")}
    kids = search.offspring(pop, search.patches(spark, IDS), 0, 60, 1, mutation=0.0).collect()
    assert sum(r.subset == ["a", "b"] for r in kids) > 20
    assert all("d" not in r.subset or r.subset == ["d"] for r in kids)  # only a child left empty gets a patch of neither parent


def test_acceptance():
    assert search.accept([0.1, 0.1], [], 0, 10, 1, [0.0, 0.0])
    assert search.accept([0.9, 0.9], [[0.5, 0.5]], 0, 10, 1, [0.0, 0.0])
    assert not search.accept([0.4, 0.4], [[0.5, 0.5]], 0, 10, 1, [0.0, 0.0])
    assert not search.accept([0.4, 0.4], [[0.5, 0.5]], 10, 10, 1, [0.0, 0.0])
    with pytest.raises(ValueError):
        search.accept([0.4], [[0.5]], 11, 10, 1, [0.0])


def test_routing(spark):
    e = spark.createDataFrame([("e1", ["Accuracy", "x"]), ("e2", ["COMPRESS", "regression"]), ("e3", [])], "evidence_id string, tags array<string>")
    assert {(r.evidence_id, r.direction) for r in search.routed(e).collect()} == {("e1", "accuracy"), ("e2", "cost"), ("e2", "regression")}
    a = spark.createDataFrame([("a", 0.0, 1.0, 0.5, 0.5), ("b", 1.0, 0.0, 0.5, 0.5), ("m", 0.5, 0.5, 0.5, 0.5)], "candidate_id string, v1 double, v2 double, v3 double, v4 double")
    who, what = search.condition(a, ["accuracy", "transfer"], 4)
    assert (who, what) in {("a", "accuracy"), ("b", "transfer")}
    with pytest.raises(ValueError):
        search.condition(a, [], 4)


def test_budget(spark):
    b = search.Budget(3)
    b.consume(2)
    with pytest.raises(ValueError):
        b.consume(2)
    assert b.spent == 2
    r = search.synthetic(spark.createDataFrame([("k" * 64,)], "cache_key string")).first()
    assert 24 <= r.input_tokens < 33 and 8 <= r.output_tokens < 21
