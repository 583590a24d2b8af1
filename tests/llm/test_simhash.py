import random

import pytest
import xxhash

from evalforge.llm import simhash


def slow_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """rows: (id, fp); smallest id reachable."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [low.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "One tWo", "a b c", "É a b\x0bc\rd É", "x y z " * 500, "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fp(text)


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = []
    for b in base:
        f = b
        for _ in range(rnd.randrange(6)):  # chains
            f ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4))) & (2**64 - 1)
            fps.append(f)
        fps.append(b)
    centre = rnd.getrandbits(64)  # a group in few cells, far over the pairwise limit
    fps += [centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 4) for j in range(i + 1, i + 4)] + [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i) if rnd.random() < 0.3]
    fps += [0, 1 << 63, 2**64 - 1]
    fps = sorted(set(fps))
    rnd.shuffle(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    comp = {r.node: r.root for r in simhash.components(edges).collect()}
    rows = list(zip(range(len(fps)), fps))
    want = slow_components(rows)
    got = {}
    for i, s in enumerate(signed):
        got.setdefault(comp.get(s, s), []).append(i)
    low = {k: min(v) for k, v in got.items()}
    assert [low[comp.get(s, s)] for s in signed] == want


def test_near_dedup_rows(spark):
    texts = [(5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, None), (8, ""), (8, ""), (7, "q w e r t y u"), (6, "word " * 3000), (2, "one")]
    docs = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_dedup(docs).collect())
    rows = [(d, slow_fp(t)) for d, t in texts]
    assert got == sorted((d is None, d, f, c) for (d, f), c in zip(rows, slow_components(rows)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7, 8]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_long_runs_over_batches():
    """A cell's run that goes on over many batches is passed on as it comes; short runs are compared pair by pair."""
    import numpy as np
    import pyarrow as pa

    cells = np.sort(np.r_[np.full(500, 5), np.full(3, 7), np.full(300, 9), [11, 11]]).astype(np.int64)
    fps = np.r_[np.arange(500), [1, 2, 7 << 40], np.arange(300), [4, 7]].astype(np.int64)
    batches = [pa.record_batch({"cell": cells[i : i + 64], "fp": fps[i : i + 64]}) for i in range(0, len(cells), 64)]
    got = [r for b in simhash._links(batches) for r in b.to_pylist()]
    assert {r["a"] for r in got if r["hot"]} == set(range(500))
    assert {(r["a"], r["b"]) for r in got if not r["hot"]} == {(1, 2), (4, 7)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert simhash.near_dedup(docs).count() == 0 and simhash.keep_one(docs).count() == 0
