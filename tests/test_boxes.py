"""Cells and boxes against all pairs, fronts against peeling, volumes against slabs."""

import math
import random

import numpy as np
import pytest

from evalforge.operators import boxes, pareto


def cloud(seed, n, d, steps=None):
    r = np.random.default_rng(seed)
    v = r.random((n, d))
    return np.round(v * steps) / steps if steps else v


def frame(spark, v, **more):
    cols = ", ".join(f"v{i + 1} double" for i in range(v.shape[1]))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], f"id long, {cols}")


def dominated(v):
    ge = (v[:, None, :] >= v[None, :, :]).all(2)
    return ge & (v[:, None, :] > v[None, :, :]).any(2)


def peeled(v):
    by, rank, left, turn = dominated(v), np.full(len(v), -1), np.ones(len(v), bool), 0
    while left.any():
        now = left & ~by[left].any(0)
        rank[now], turn = turn, turn + 1
        left &= ~now
    return rank


CLOUDS = [cloud(1, 700, 3), cloud(2, 900, 2, 12), cloud(3, 500, 4, 6), cloud(4, 300, 1, 40), np.repeat(cloud(5, 40, 3), 9, 0), np.zeros((50, 3)), np.stack([np.arange(400.0)] * 3, 1), np.stack([np.arange(400.0), -np.arange(400.0)], 1), cloud(6, 1, 3)]


@pytest.mark.parametrize("v", CLOUDS, ids=range(len(CLOUDS)))
def test_within_a_task(v):
    by, one = dominated(v), np.ones(len(v), np.int64)
    above, below = boxes.counted(v, v, one)
    assert (above == by.sum(0)).all() and (below == by.sum(1)).all()
    weight = np.arange(len(v), dtype=np.int64)
    assert (boxes.counted(v, v, weight)[0] == weight @ by).all()
    assert (boxes.beaten(v, v, True) == by.any(0)).all()
    some = v[::7]
    assert (boxes.beaten(v, some, False) == (some[:, None] >= v[None]).all(2).any(0)).all()
    assert np.allclose(boxes.least(v, some, boxes.shift_bound, boxes.shift), (v[:, None] - some[None]).max(2).min(1), atol=0, rtol=0)
    assert np.allclose(boxes.least(v, some, boxes.distance_bound, boxes.distance), np.sqrt(((v[:, None] - some[None]) ** 2).sum(2)).min(1))
    assert (pareto._peeled(v) == peeled(v)).all()


def test_boxes_are_in_order():
    b = boxes.Boxes.of(cloud(7, 2000, 3, 15))
    assert sorted(b.order.tolist()) == list(range(2000))
    for i in range(len(b)):
        later = np.arange(i + 1, len(b))
        assert not dominated_by_boxes(b, later, i)
    assert len(boxes.Boxes.of(np.empty((0, 3)))) == 0


def dominated_by_boxes(b, later, i):
    rows = b.gathered(later)
    return bool(len(rows)) and boxes.beats(b.v[rows], b.v[b.rows(i)]).any()


@pytest.fixture
def small_cells(monkeypatch):
    """Cells of some dozen rows, so that many of them meet."""
    monkeypatch.setattr(boxes, "CELL", 60)
    monkeypatch.setattr(boxes, "LEAST_CELL", 30)
    monkeypatch.setattr(boxes, "HELD", 150)


@pytest.mark.parametrize("at", [0, 1, 2, 4, 5, 6, 8])
def test_tables(spark, small_cells, at):
    v = CLOUDS[at][:420]
    df, by = frame(spark, v), dominated(v)
    got = {r.id: (r.dominators, r.dominated) for r in pareto.dominance_counts(df, "id").collect()}
    assert got == {i: (int(by[:, i].sum()), int(by[i].sum())) for i in range(len(v))}
    got = {r.id: r["rank"] for r in pareto.ranks(df, "id").collect()}
    assert got == dict(enumerate(peeled(v).tolist()))
    a, r = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    x, y = v[::3], np.array([u for i, u in enumerate(v) if i % 3])
    if len(y):
        assert pareto.coverage(a, r).first()[0] == pytest.approx((x[:, None] >= y[None]).all(2).any(0).mean())
        assert pareto.epsilon(a, r).first()[0] == (y[:, None] - x[None]).max(2).min(1).max()
        assert pareto.inverted_distance(a, r).first()[0] == pytest.approx(np.sqrt(((y[:, None] - x[None]) ** 2).sum(2)).min(1).mean())


def test_no_pairs_in_plans(spark):
    df = frame(spark, cloud(8, 300, 3))
    for out in (pareto.dominance_counts(df, "id"), pareto.coverage(df, df), pareto.epsilon(df, df), pareto.inverted_distance(df, df), pareto.ranks(df, "id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert plan.count("BroadcastNestedLoopJoin") <= (out.columns == ["coverage"])  # two tables of one row each


def test_empty_tables(spark):
    df = frame(spark, cloud(9, 5, 2))
    none = df.where("id < 0")
    assert pareto.coverage(none, df).first()[0] == 0 and pareto.coverage(df, none).first()[0] == 0
    assert pareto.epsilon(none, df).first()[0] is None and pareto.inverted_distance(df, none).first()[0] is None
    assert pareto.dominance_counts(none, "id").count() == 0 and pareto.ranks(none, "id").count() == 0


def test_large_front(spark, small_cells, monkeypatch):
    monkeypatch.setattr(pareto, "MEET", 50)
    for v in (cloud(10, 600, 4), np.stack([np.arange(500.0), -np.arange(500.0)], 1), np.repeat(cloud(11, 150, 4), 3, 0)):
        got = sorted(r.id for r in pareto.strict_front(frame(spark, v).repartition(6)).collect())
        assert got == np.flatnonzero(~dominated(v).any(0)).tolist()


def test_large_group(spark, small_cells):
    v = cloud(12, 400, 3, 9)
    df = frame(spark, v).selectExpr("*", "case when id < 300 then 1 when id < 330 then 2 end as run")
    got = {r.id: r["rank"] for r in pareto.ranks(df, "id", ["run"]).collect()}
    want = [*peeled(v[:300]), *peeled(v[300:330]), *peeled(v[330:])]
    assert got == dict(enumerate(int(x) for x in want))


@pytest.mark.parametrize("d,n,steps", [(1, 30, 9), (2, 60, None), (2, 60, 8), (3, 90, None), (3, 80, 5), (4, 60, None), (4, 70, 4), (5, 25, None)])
def test_volumes(d, n, steps):
    v = cloud(d * n, n, d, steps)
    ref = np.full(d, 0.2)
    whole = pareto.volume(v, ref)
    assert pareto.measure(v, ref) == pytest.approx(whole, abs=1e-12)
    for i in range(0, n, 7):
        rest = np.delete(v, i, 0)
        assert pareto.exclusive(v[i], rest, ref) == pytest.approx(whole - pareto.volume(rest, ref), abs=1e-12)


def test_volume_of_many_in_three_dimensions():
    v = cloud(77, 900, 3)
    v /= np.sqrt((v**2).sum(1))[:, None]  # a front longer than the sweep takes at once
    assert pareto.measure(v, np.zeros(3)) == pytest.approx(pareto.volume(v, np.zeros(3)))


def test_contributions_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pareto, "SLICE", 7)
    v = np.vstack([cloud(13, 40, 3), cloud(13, 5, 3), cloud(14, 50, 3, 5)])  # some rows twice
    df = frame(spark, v).selectExpr("*", "if(id < 45, 'a', null) as run")
    ref = [0.1, 0.1, 0.1]
    got = {r.id: r.contribution for r in pareto.contributions(df, "id", ref, ["run"]).collect()}
    for at in (range(45), range(45, 95)):
        rows = v[list(at)]
        whole = pareto.volume(rows, np.array(ref))
        for k, i in enumerate(at):
            assert got[i] == pytest.approx(max(0.0, whole - pareto.volume(np.delete(rows, k, 0), np.array(ref))), abs=1e-12)
        run = "run is null" if at[0] else "run = 'a'"
        assert pareto.hypervolume(df.where(run), ref, ["run"]).first().hypervolume == pytest.approx(whole)
    assert math.isclose(sum(r.hypervolume for r in pareto.hypervolume(df, [2.0, 2.0, 2.0], ["run"]).collect()), 0.0)


def test_order_does_not_matter(spark, small_cells):
    v = cloud(15, 200, 3, 7)
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    df = frame(spark, v)
    again = df.repartition(7, "v2").orderBy("v1")
    one, two = ({r.id: r["rank"] for r in pareto.ranks(x, "id").collect()} for x in (df, again))
    assert one == two
