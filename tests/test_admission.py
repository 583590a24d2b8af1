"""Keyed admission: batch, snapshots and stream agree, and a run goes on after a restart."""

import random

import pytest

from evalforge.operators import archive
from evalforge.streaming import admission

SCHEMA = "run_id string, pos long, candidate_id string, content_hash string, cost long, reasons array<string>, v1 double, v2 double, v3 double"


def arrivals(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        for run in ("a", "b", "c"):
            if rnd.random() < 0.7:
                rows.append((run, pos, f"k{rnd.randrange(90)}", f"h{rnd.randrange(100)}", rnd.randrange(1, 6), ["token_budget"] if rnd.random() < 0.15 else [], *[rnd.randrange(9) / 8 for _ in range(3)]))
    return rows


def key(rows):
    return sorted((r.run_id, r.pos, r.candidate_id, r.accepted, r.reason, r.removed_ids, r.spent) for r in rows)


@pytest.fixture(scope="module")
def wanted(spark):
    rows = arrivals(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = key(archive.decisions(df, 6, 150).collect())
    assert {r[4].split(":")[0] for r in got} >= {"accepted", "duplicate_candidate_id", "duplicate_content_hash", "evaluation_budget_exceeded", "infeasible", "dominated_by"}
    return rows, got


def test_snapshots_follow_one_another(spark, wanted):
    rows, want = wanted
    states, done = None, []
    for low, high in ((0, 13), (13, 14), (14, 70), (70, 71), (71, 200)):
        part = spark.createDataFrame([r for r in rows if low <= r[1] < high and not (r[0] == "c" and low == 13)], SCHEMA)
        if low == 14:  # what a run missed comes with its next arrivals
            part = part.union(spark.createDataFrame([r for r in rows if r[1] == 13 and r[0] == "c"], SCHEMA))
        decided, states = admission.advance(states, part, 6, 150)
        done += decided.collect()
    assert key(done) == want
    assert sorted(r.run_id for r in states.collect()) == ["a", "b", "c"]
    none, same = admission.advance(states, spark.createDataFrame([], SCHEMA), 6, 150)
    assert none.count() == 0 and sorted(map(tuple, same.collect())) == sorted(map(tuple, states.collect()))


def test_late_arrivals_change_nothing(spark, wanted):
    rows, _ = wanted
    _, states = admission.advance(None, spark.createDataFrame([r for r in rows if r[1] < 40], SCHEMA), 6, 150)
    again, after = admission.advance(states, spark.createDataFrame([r for r in rows if 20 <= r[1] < 40], SCHEMA), 6, 150)
    assert {(r.accepted, r.reason) for r in again.collect()} == {(False, admission.LATE)}
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, states.collect()))


def test_states_of_other_vectors(spark, wanted):
    with pytest.raises(ValueError, match="length"):
        admission.restored('{"spent": 0, "held": [], "rivals": [[1.0]], "members": {}, "last": 1}', 6, 260, 3)


def test_stream_with_a_restart(spark, wanted, tmp_path):
    rows, want = wanted
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    admission.use_store(spark)
    try:
        source, out = f"{tmp_path}/in", f"{tmp_path}/out"
        for turn, (low, high) in enumerate(((0, 30), (30, 64), (64, 200))):
            spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = admission.admissions(spark.readStream.schema(SCHEMA).parquet(source), 6, 150)
            # a new query each turn: what it knows of the runs is the state of the last one
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            assert key(spark.read.parquet(out).collect()) == [w for w in want if w[1] < high]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
