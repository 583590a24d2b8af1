"""Product codes against a plain Lloyd iteration on whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v int"


def slow(rows, parts, entries, rounds):
    """rows: (id, vector, label) that can be coded; floors in Python's whole numbers."""
    v = {i: [math.floor(256 * float(np.float32(x))) for x in vec] for i, (_, vec, _) in enumerate(rows)}
    width = len(v[0]) // parts
    part = lambda i, p: v[i][p * width : (p + 1) * width]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))[:entries]
    books = [[part(i, p) for i in first] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(part(i, p), books[p][e])), e)) for p in range(parts)] for i in v]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(i, p) for i in v if at[i][p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    err = [sum(sum((a - b) ** 2 for a, b in zip(part(i, p), books[p][at[i][p]])) for p in range(parts)) for i in v]
    sums = {}
    for (_, _, label), e in zip(rows, err):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((rows[i][0] if rows[i][0] is not None else -1, "".join(f"{x:02x}" for x in at[i]), err[i], sums[rows[i][2]]) for i in v), digest


def table(spark, rows):
    return spark.createDataFrame([(i, vec, label, "x", 1, 2) for i, vec, label in rows], SCHEMA)


def found(out, books):
    return sorted((-1 if r.id is None else r.id, r.code, r.error, r.label_error) for r in out.collect()), books.digest()


def some(seed, n, dims, scale=1.0, grain=None):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims)) * scale
    v = np.round(v * grain) / grain if grain else v
    return [(int(i), [float(x) for x in v[k]], int(r.integers(3)) if r.random() < 0.8 else None) for k, i in enumerate(r.permutation(n) * 3 - 20)]


@pytest.mark.parametrize("n,dims,parts,entries,rounds,grain", [(150, 32, 16, 64, 2, None), (40, 32, 16, 64, 2, 2), (90, 8, 4, 5, 4, 1), (60, 6, 2, 7, 1, None), (30, 16, 16, 8, 0, 4)])
def test_brute_force(spark, n, dims, parts, entries, rounds, grain):
    rows = some(n, n, dims, grain=grain)
    got = found(*codes.compress(table(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds))
    assert got == slow(rows, parts, entries, rounds)


def test_values_beyond_floats(spark):
    """Distances that doubles don't hold exactly."""
    rows = some(7, 50, 16, scale=5e4)
    got = found(*codes.compress(table(spark, rows), parts=4, entries=9))
    assert got == slow(rows, 4, 9, 2)
    v = np.array([[[2**26, 1]], [[2**26, 2]]], np.int64)
    assert codes.nearest(v, np.array([[[-(2**26), 2], [-(2**26), 1]]], np.int64))[0].tolist() == [[1], [0]]


def test_what_goes_and_what_stays(spark):
    ok = some(3, 30, 16)
    rows = [*ok, (None, ok[0][1], 1), (ok[1][0], ok[1][1], 2), (ok[1][0], ok[2][1], None)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [None], 1), (903, [1.0] * 15 + [math.nan], 1), (904, [1.0] * 15 + [math.inf], 1), (905, [-math.inf] * 16, None), (906, [1.0] * 5, 1), (907, [3e38] + [0.0] * 15, 1)]
    got = found(*codes.compress(table(spark, rows + bad), parts=8, entries=6))
    assert got == slow(rows, 8, 6, 2)
    none, books = codes.compress(table(spark, bad[:3]))
    assert none.count() == 0 and none.columns == ["id", "label", "code", "error", "label_error"] and not books.entries.size
    assert codes.compress(table(spark, []))[0].count() == 0


def test_filled_with_zeros(spark):
    rows = some(5, 25, 10)
    out, books = codes.compress(table(spark, rows), parts=4, entries=5)
    longer = [(i, [*v, 0.0, 0.0], label) for i, v, label in rows]
    assert found(out, books) == slow(longer, 4, 5, 2)
    assert all(len(codes.decode(r.code, books)) == 10 for r in out.collect())


def test_only_changes_are_sent(spark):
    """Rounds send the parts that moved alone, and the running sums stay those of all parts."""
    rows = some(11, 200, 32)
    kept, dims = codes.whole(table(spark, rows), "vec_id", "embedding", "label")
    _, last, sent = codes.fit(kept, dims, rounds=3)
    assert sent[0] == 200 * 16 and 0 < sent[2] < sent[1] < sent[0]
    changed = last.select("old", "code").collect()
    assert sent[2] == sum(a != b for r in changed for a, b in zip(r.old, r.code))
    per_task = codes.changes(last, (16, 64, 2)).agg(F.sum("moved"), F.sum("n")).first()
    assert per_task[0] == sent[2] and per_task[1] == 0


def test_codes_stand_for_vectors(spark):
    rows = some(13, 120, 16)
    out, books = codes.compress(table(spark, rows), parts=8, entries=64)
    by = {i: v for i, v, _ in rows}
    for r in out.collect():
        whole = [math.floor(256 * float(np.float32(x))) for x in by[r.id]]
        assert sum((a - 256 * b) ** 2 for a, b in zip(whole, codes.decode(r.code, books))) == r.error


def test_one_label_and_many(spark):
    rows = [(i, v, 5 if i % 3 else i) for i, (_, v, _) in enumerate(some(17, 90, 16))]
    assert found(*codes.compress(table(spark, rows), parts=2, entries=4)) == slow(rows, 2, 4, 2)
