"""Queries over whole tables: no row is left out."""

import pandas as pd

from evalforge.operators import search
from evalforge.plans import evaluation, searching


def suppliers(spark, path, n=90):
    rows = [(i, (i * 7) % 25, float((i * 997) % 9000 - 500)) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")


def test_split_overlap_all(spark, tmp_path):
    rows = [(o, p) for p in range(1, 130) for o in range(p % 5, p % 5 + 1 + p % 3)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    split = {(("a", "b", "c")[o % 3], str(p)) for o, p in rows}
    want = sorted((x, y, p) for x, p in split for y in "bc" if x < y and (y, p) in split)
    got = evaluation.split_overlap_all(spark, str(tmp_path)).select("split_id", "other_id", "task_id").collect()
    assert sorted(map(tuple, got)) == want


def test_nsga_survivors_all(spark, tmp_path):
    suppliers(spark, tmp_path)
    pool = [(f"c{r.id}", (r.v1, r.v2, r.v3)) for r in evaluation._pool(spark, str(tmp_path)).collect()]
    assert len(pool) == 90
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    left, rank, want = dict(pool), 0, []
    while left:
        front = {k: v for k, v in left.items() if not any(beats(w, v) for w in left.values())}
        crowd = pd.Series(0.0, index=sorted(front))
        for d in range(3):
            order = sorted(front, key=lambda k: (front[k][d], k))
            span = front[order[-1]][d] - front[order[0]][d]
            if span:
                crowd[order[0]] = crowd[order[-1]] = float("inf")
                for a, k, b in zip(order, order[1:], order[2:]):
                    crowd[k] += (front[b][d] - front[a][d]) / span
        want += sorted(((k, rank) for k in front), key=lambda x: (-crowd[x[0]], x[0]))
        left = {k: v for k, v in left.items() if k not in front}
        rank += 1
    got = evaluation.nsga_survivors_all(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want[:9])


def test_genetic_offspring_takes_whole_pool(spark, tmp_path, monkeypatch):
    suppliers(spark, tmp_path)
    seen = []
    real = search.offspring
    monkeypatch.setattr(search, "offspring", lambda pop, *a: seen.append(pop.count()) or real(pop, *a))
    assert searching.genetic_offspring(spark, str(tmp_path)).count()
    assert seen == [90]
