import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evalforge.llm import _base, lm


def toks(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x20\x09-\x0D]+", t) + ["\n"]


def token_hash(w):
    raw = np.frombuffer(w.encode(), np.uint8)
    return int(lm.END) if w == "\n" else int(lm.word_hashes(raw, np.zeros(0, np.int64))[1][0])


def test_hashes_of_whole_texts(monkeypatch):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "　", "\x85", "漢", "z" * 9, "Q" * 70, "w" * 64, "12345678"]
    texts = ["".join(rnd.choice(alphabet + [" ", "\n", "\t", "\x0b"]) for _ in range(rnd.randrange(0, 60))) for _ in range(300)] + [None, "", " ", "x", " x ", "a b"]
    texts.append(" ".join("word%d" % (i % 9) for i in range(4000)))
    for step in (1 << 20, 500):  # the second cuts long texts into pieces
        monkeypatch.setattr(lm, "STEP_BYTES", step)
        batch = pa.record_batch({"text": pa.array(["skipped", *texts], pa.string())}).slice(1)
        got = [h for _, sizes, all_ in lm.token_rows([batch]) for h in np.split(all_, np.cumsum(sizes)[:-1])]
        assert len(got) == len(texts)
        for t, h in zip(texts, got):
            assert [int(x) for x in h] == [token_hash(w) for w in toks(t)]
    words = sorted({w for t in texts for w in toks(t)})
    assert len({token_hash(w) for w in words}) == len(words)


def test_filter_gives_levels_back():
    rnd = np.random.default_rng(1)
    key = np.unique(rnd.integers(0, 1 << 63, 60000).astype(np.uint64) << np.uint64(1))
    counts = rnd.zipf(1.7, len(key)) + 1
    level = lm.levels(counts)
    parts = [lm._part(b, key[lm._bucket(key, 3) == b], level[lm._bucket(key, 3) == b]) for b in range(3)]
    found = lm.Filter(np.frombuffer(b"".join(p.column(1)[0].as_py() for p in parts), np.uint8), np.cumsum([0, *(p.column(2)[0].as_py() for p in parts)]))
    got = found.level(key)
    assert (got >= level).all() and (got == level).mean() > 0.95
    assert (found.level(key | np.uint64(1)) > 0).mean() < 0.005
    assert (np.abs(np.log(lm.VALUES[level] / counts)) <= math.log(lm.BASE) + 1e-9).all()


def corpus(spark):
    rnd = random.Random(3)
    words = ["The", "of", "é", "cat", "dog", "ran"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(words, [60, 50, 20, 20, 10, 10] + [1] * 60, k=rnd.randrange(0, 40))) for _ in range(200)] + [None, "", "new unseen the cat", "THE cat\x0bof"]
    return texts, spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "the cat", 0.0), (0, texts[0], 2.0)], "doc_id long, text string, score double")


@pytest.mark.parametrize("vocabulary,most_bits", [(5, 1 << 30), (1000, 1 << 30), (5, 2000), (1000, 2000)])
def test_scores(spark, vocabulary, most_bits):
    """Against counts by hand; bigrams' levels are read from the filter where it has them, for it may overstate some."""
    texts, docs = corpus(spark)
    model = lm.fit(docs.where("doc_id < 150"), vocabulary, most_bits)
    assert model.beyond == (most_bits == 2000)
    train = [*texts[:150], texts[0]]
    counts, pairs = Counter(), Counter()
    for t in train:
        w = toks(t)
        counts.update(w)
        pairs.update(zip(["^", *w], w))
    n, v = sum(counts.values()), len(counts)
    total = dict(counts) | {"^": len(train)}
    taken = defaultdict(float)
    for (p, _), k in pairs.items():
        if k >= lm.LEAST:
            taken[p] += lm.VALUES[lm.levels(np.array([k]))[0]] - lm.DISCOUNT
    names, *_, parts, rare = model.shared.value
    assert len(names) <= vocabulary and 8 * (len(parts[0]) + len(rare[0])) <= most_bits
    found, rare = (lm._assembled(p, model.buckets, model.buckets) for p in model.parts)
    hashes = {w: token_hash(w) for t in texts for w in toks(t)} | {"^": int(lm.START)}

    def level(p, w):
        return int(found.level(lm.bigrams(np.array([hashes[p], hashes[w]], np.uint64), np.array([2]))[1:])[0])

    truth = [(level(p, w), int(lm.levels(np.array([k]))[0]) if k >= lm.LEAST else 0) for (p, w), k in pairs.items()]
    assert all(a >= b for a, b in truth) and sum(a == b for a, b in truth) > 0.9 * len(truth)

    def context(p):
        size, used, _ = lm.masses(rare, lm._mix(np.array([hashes[p] >> 32], np.uint64) + lm._M2))
        return float(size[0]), float(used[0])

    up = lambda x: lm._FINE ** max(math.ceil(math.log(max(x, 1)) / math.log(lm._FINE) - 1e-9), 0)
    truth = [(context(p), (max(up(max(total[p], taken[p])), up(taken[p])), up(taken[p])) if taken[p] else (1.0, 0.0)) for p in total]
    assert all(a[1] >= b[1] - 1e-9 for a, b in truth) and sum(a == pytest.approx(b) for a, b in truth) > 0.85 * len(truth)

    want = {}
    for i, t in enumerate([*texts, "the cat"]):
        w = toks(t)
        uni = lambda x: (counts[x] + 0.1) / (n + 0.1 * (v + 1))
        s = 0.0
        for p, x in zip(["^", *w], w):
            q, (size, used) = level(p, x), context(p)
            a = max(lm.VALUES[q] - lm.DISCOUNT, 0) / size if q and used else 0.0
            s += math.log10(min(a + max(1 - used / size, 1e-3) * uni(x), 1.0))
        want[i] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10(uni(x)) for x in w), s)
    got = lm.score(docs, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        x = want[len(texts) if r.doc_id is None else r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == x[:3]
        assert abs(r.base_score - x[3]) < 1e-6 * (1 + abs(x[3]))
        assert abs(r.score - x[4]) < 1e-6 * (1 + abs(x[4]))
    if vocabulary == 1000:  # probabilities of all next tokens sum to one or less, and nearly to one
        for p in ["the", "of", "cat", "^"]:
            size, used = context(p)
            sum_ = sum(max(lm.VALUES[level(p, x)] - lm.DISCOUNT, 0) / size + (1 - used / size) * (counts[x] + 0.1) / (n + 0.1 * (v + 1)) for x in counts)
            assert 0.95 < sum_ < 1.05
    assert lm.score(docs.limit(0), model).count() == 0


def test_bigrams_help(spark):
    rnd = random.Random(4)
    texts = [" ".join(x for _ in range(15) for x in rnd.choice([("a", "b"), ("c", "d"), ("e", "f")])) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm.score(docs.where("doc_id >= 200"), lm.fit(docs.where("doc_id < 200"))).collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(docs, lm.fit(docs.limit(0))).collect()[0]
    assert r.n_known == 0 and abs(r.base_score - 3 * math.log10(0.1 / 0.1)) < 1e-9


def test_query(spark, tmp_path):
    """The contract's columns and the training share, null ids among it."""
    import zlib

    texts, docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op8(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out) for r in got) == sorted((i is None, i or 0, held(i)) for i, _ in rows)
    assert {r.train_tokens for r in got} == {sum(len(toks(t)) for i, t in rows if not held(i))}
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_bounds_change_nothing(spark, monkeypatch):
    """Scores are the same whatever is broadcast: nothing, some parts, all; few tokens or many."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 11)
    _, docs = corpus(spark)
    train = docs.where("doc_id < 150")
    key = lambda m: {(r.doc_id, r.n_tokens, r.n_known): (r.base_score, r.score) for r in lm.score(docs, m).collect()}
    want, seen = key(lm.fit(train)), set()
    for vocabulary, most_bits in [(1 << 18, 0), (1 << 18, 9000), (1, 9000), (1, 1 << 30), (7, 0), (30, 20000)]:
        model = lm.fit(train, vocabulary, most_bits)
        seen.add((model.here, model.buckets))
        got = key(model)
        assert got.keys() == want.keys()
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(want[k], got[k]))
    assert len(seen) >= 3 and min(seen)[0] == 0


def test_little_is_written_beyond_the_broadcast(spark, monkeypatch):
    """Where no part of the filter is broadcast, what scoring writes is less than the text, not a record for each token."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 18)
    rnd = random.Random(6)
    texts = [" ".join(f"word{rnd.randrange(3000)}" for _ in range(250)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    model = lm.fit(docs, 1000, 0)
    before = _base.staged_now()
    got = lm.score(docs, model)
    assert got.count() == len(texts) and model.beyond
    files = [f for path in _base._staged[before:] for f in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet")]
    assert 0 < sum(f.stat().st_size for f in files) < sum(map(len, texts))
    shuffles = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert shuffles == "false"  # set within writes only


def test_fine_levels_come_back():
    r = np.random.default_rng(2)
    context = np.unique(r.integers(0, 1 << 63, 20000).astype(np.uint64))
    q = np.minimum(r.geometric(0.03, len(context)), lm._FINE_LEVELS)
    key, level = lm._digits(context, q)
    part = lm._part(0, key, level)
    f = lm.Filter(np.frombuffer(part.column(1)[0].as_py(), np.uint8), np.array([0, part.column(2)[0].as_py()]))
    got = lm._fine_of(f, context)
    assert (got >= q).all() and (got == q).mean() > 0.93 and (lm._fine_of(f, context ^ lm.U(1 << 62)) > 0).mean() < 0.005


def python_steps(plan) -> list[int]:
    """How many Python steps each stage of a physical plan has."""
    stages = []

    def below(node) -> int:
        name = node.nodeName()
        inner = [node.initialPlan()] if name == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
        n = sum(map(below, inner))
        if "Exchange" in name:
            stages.append(n)
            return 0
        return n + ("Arrow" in name or "Pandas" in name or "Python" in name)

    stages.append(below(plan))
    return stages


@pytest.mark.parametrize("most_bits", [1 << 30, 2000])
def test_one_python_step_a_stage(spark, monkeypatch, most_bits):
    """Each Python step of a stage has processes of its own, and executors keep all of them: two steps take twice the memory."""
    seen, write = [], lm.staged

    def staged(df):
        seen.extend(python_steps(df._jdf.queryExecution().executedPlan()))
        return write(df)

    monkeypatch.setattr(lm, "staged", staged)
    _, docs = corpus(spark)
    docs = docs.repartition(3).localCheckpoint()  # one partition alone needs no exchange
    got = lm.score(docs, lm.fit(docs.where("doc_id < 150"), 5, most_bits))
    seen.extend(python_steps(got._jdf.queryExecution().executedPlan()))
    assert sum(seen) >= 6 and max(seen) == 1


def test_memory_goes_with_the_broadcast(spark):
    """A worker that Spark has told to let go of a broadcast holds nothing of it."""
    import gc
    import weakref

    class Shared:
        def __init__(self, value):
            self.value = value

    _, docs = corpus(spark)
    shared = Shared(lm.fit(docs.where("doc_id < 150")).shared.value)
    known = weakref.ref(lm._known(shared))
    assert lm._known(shared) is known()
    del shared
    gc.collect()
    assert known() is None


def test_lookups_take_little_memory():
    """What a lookup needs beside its answer doesn't grow with the number of keys."""
    import tracemalloc

    key = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 1 << 20).astype(np.uint64) << np.uint64(1))
    part = lm._part(0, key[::2], np.full(len(key[::2]), 3))
    found = lm.Filter(np.frombuffer(part.column(1)[0].as_py(), np.uint8), np.array([0, part.column(2)[0].as_py()]))
    tracemalloc.start()
    got = found.level(key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[::2] >= 3).all() and len(got) == len(key) and len(found.level(key[:0])) == 0
    assert peak < 40 * len(key)
