"""Tree draws: their law, their sums against the weights, numbering without windows, and sign flips by halves."""

import itertools
import random

import numpy as np
import pytest

from evalforge.functions.places import numbered
from evalforge.operators import bootstrap, inference, resampling


def whole(seed, size, replicates):
    return np.concatenate([resampling.weights(seed, "s", size, replicates, i) for i in range(-(-size // resampling.LEAF))], 1)


def test_law(monkeypatch):
    monkeypatch.setattr(resampling, "LEAF", 4)
    n, r = 26, 20_000
    w = whole(3, n, r)
    assert w.shape == (r, n) and (w.sum(1) == n).all()  # every replicate draws as many as there are
    c = np.cov(w.T)
    assert abs(w.mean(0) - 1).max() < 0.05
    assert abs(np.diag(c) - (1 - 1 / n)).max() < 0.06 and abs(c[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.04
    share = np.bincount(w[:, 25].astype(int), minlength=4)[:4] / r  # a block's draws are binomial
    assert np.allclose(share, [(25 / 26) ** 26, (25 / 26) ** 25, 26 * 25 / 2 / 26**2 * (25 / 26) ** 24, 2600 / 26**3 * (25 / 26) ** 23], atol=0.015)


def test_tasks_agree(monkeypatch):
    monkeypatch.setattr(resampling, "LEAF", 7)
    again = np.concatenate([resampling.weights(5, "s", 60, 40, i) for i in reversed(range(9))][::-1], 1)
    assert (whole(5, 60, 40) == again).all()
    assert (whole(5, 60, 40) != whole(6, 60, 40)).any()
    assert (resampling.weights(1, "s", 1, 5, 0) == 1).all()


def table(spark, candidates=3, tasks=30, seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in range(candidates):
        for t in range(tasks):
            targets = ["a", "b", "x"] if t % 5 else ["a", "b"]
            for target in targets:
                split = "id" if target == "a" else "transfer"
                rows.append((f"c{c}", target, f"t{t:03}", t % 2, split, None if split == "id" else f"g{target}", rnd.random() < 0.6, rnd.random() < 0.5, rnd.randrange(50), rnd.randrange(9)))
    return rows, spark.createDataFrame(rows, "candidate_id string, target_id string, task_id string, seed long, split string, grp string, candidate_correct boolean, base_correct boolean, input_tokens long, output_tokens long")


def test_sums_are_those_of_the_weights(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HELD", 2)
    rows, pairs = table(spark)
    got = {(r.candidate_id, r.replicate): r for r in resampling.samples(pairs.repartition(5), 50, 9).collect()}
    assert len(got) == 150
    layout = {(r.candidate_id, r.task_id): (r.stratum, r.place, r["size"]) for r in bootstrap.strata(pairs).collect()}
    for c in ("c0", "c1", "c2"):
        w = {}
        for t in {r[2] for r in rows}:
            s, place, size = layout[c, t]
            w[t] = resampling.weights(9, s, size, 50, 0)[:, place]
        for k in range(50):
            own = [(r, w[r[2]][k]) for r in rows if r[0] == c]
            total = lambda f: sum(x * f(r) for r, x in own)  # noqa: B023, E731
            n = total(lambda r: r[4] == "id")
            r = got[c, k]
            assert r.accuracy == pytest.approx(total(lambda r: r[4] == "id" and r[6]) / n)
            assert r.delta == pytest.approx(total(lambda r: (r[4] == "id") * (r[6] - r[7])) / n)
            assert r.token_cost == pytest.approx(total(lambda r: r[8] + r[9]) / total(lambda r: 1))
            assert r.regression == pytest.approx(total(lambda r: r[7] and not r[6]) / total(lambda r: r[7]))
            assert r.transfer == pytest.approx(min(total(lambda r, g=g: r[5] == g and r[6]) / total(lambda r, g=g: r[5] == g) for g in ("gb", "gx")))


def test_bounds_are_those_of_hash_draws(spark):
    _, pairs = table(spark, candidates=1, tasks=200)
    one, two = (f(pairs, 1500, 4).selectExpr("avg(accuracy) a", "stddev(accuracy) s", "percentile(token_cost, 0.05) p").first() for f in (bootstrap.samples, resampling.samples))
    assert one.a == pytest.approx(two.a, abs=0.006) and one.s == pytest.approx(two.s, rel=0.1) and one.p == pytest.approx(two.p, abs=0.6)


def test_numbered(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(10**6), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(9)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((k, i) for g2, k, i in rows if g2 == g)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own)}
    assert {r.i: (r.place, r["size"]) for r in numbered(df, ["g"], ["k", "i"]).collect()} == want
    assert numbered(df.where("i < 0"), ["g"], ["k"]).count() == 0
    assert "Window" not in numbered(df, ["g"], ["k"])._jdf.queryExecution().executedPlan().toString()


def enumerated(d):
    seen = abs(sum(d)) / len(d)
    return sum(abs(sum(x if s else -x for x, s in zip(d, signs))) / len(d) + 1e-15 >= seen for signs in itertools.product((0, 1), repeat=len(d))) / 2 ** len(d)


@pytest.mark.parametrize("d", [[1.0], [1.0, -1.0], [0.0, 0.0, 0.0], [0.1] * 11, [0.1, 0.2, 0.3, -0.6], [3.0, -1.5, 2.25, 7.0, 1.0, 1.0, 1.0], [1e-9, 1.0, 1e6], [0.3, 0.1, -0.2] * 4])
def test_halves_are_all_patterns(d):
    assert inference.halves_p(np.array(d)) == enumerated(d)


def test_halves_of_random_differences():
    r = np.random.default_rng(4)
    for n in range(2, 15):
        for d in (r.normal(size=n), np.round(r.normal(size=n), 1), r.integers(-3, 4, n).astype(float)):
            assert inference.halves_p(d) == enumerated(d.tolist())
    assert inference.halves_p(np.ones(40)) == 2 / 2**40
    assert inference.halves_p(np.array([1.0] * 38 + [-1.0, 0.0])) == 2 * 2 * (38 + 2 - 1 + 1) / 2**40


def test_flips_of_any_length(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(0.3, 1, n).tolist()) for i, n in enumerate([1, 5, 18, 20, 21, 24, 40])] + [(7, None), (8, [])]
    got = {x.i: x.p for x in spark.createDataFrame(rows, "i int, d array<double>").select("i", inference.sign_flip_p("d").alias("p")).collect()}
    for i, d in rows:
        assert (got[i] is None) if not d else got[i] == pytest.approx(inference.halves_p(np.array(d)), abs=1e-15)
