"""Collocations by brute force; sketches of any size give the same result."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evalforge.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, score long"


def slow_counts(rows, most):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def slow(rows, least, most=4, cover=80, top=2000):
    f, n = slow_counts(rows, most)
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        inside = any(l2 == lang and len(w2) > len(w) and 100 * a2 >= cover * a and any(w2[i : i + len(w)] == w for i in range(len(w2))) for (l2, w2), a2 in cand.items())
        if inside:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        out[lang].append((-score, -a, " ".join(w).encode(), a, l, r, n[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocab = ["a", "The", "of", "É", "long" * 20, "ab" * 9, "x\x0by", "z z", "naïve", "q", "quick", "brown", "fox"]
    fixed = ["quick brown fox A", "the of a", "naïve  É\tq", "z z É"]
    rows = []
    for i in range(n):
        w = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\n", "!?"]) for _ in range(rnd.randrange(0, 25))]
        rows.append((rnd.choice(["en", "en", "en", "fr", None, ""]), rnd.choice([" ", "  ", " \t"]).join(w)))
    return [*rows, ("en", None), ("en", ""), (None, " . , \r\n"), ("und", "quick brown fox a " * 40), ("en", rows[3][1]), ("en", rows[3][1])]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1) for i, (lang, t) in enumerate(rows)], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,cover,top", [(5, 80, 2000), (3, 50, 4), (30, 80, 2000)])
def test_brute_force(spark, least, cover, top):
    rows = corpus(least)
    got = found(phrases.collocations(table(spark, rows).repartition(5), least=least, cover=cover, top=top))
    want = slow(rows, least, cover=cover, top=top)
    assert got == want and want


@pytest.mark.parametrize("most,cells", [(2, 1), (3, 1 << 14), (4, 1 << 18)])
def test_any_sketch_gives_the_same(spark, most, cells):
    rows = corpus(8)
    f, n = slow_counts(rows, most)
    want = {(lang, " ".join(w), len(w), c) for (lang, w), c in f.items() if c >= 6} | {(lang, "", 0, c) for lang, c in n.items()}
    got = {tuple(r) for r in phrases.frequent(table(spark, rows), 6, most, load=0.001, most_cells=cells).collect()}
    assert got == want


def test_sketch_never_understates(spark):
    rows = corpus(9)
    f, _ = slow_counts(rows, 3)
    src = table(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "text")
    flags = phrases.sketch(src, 9, 3, 18)
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" if x is None else x for x, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["lang", "text"])
    for langs, row, raw, got in phrases._steps([batch]):
        low = bytes(phrases._LOWER[raw])
        for at, lengths in phrases._phrases(langs, row, got, 3):
            for m, (whole, key, _) in enumerate(lengths, 1):
                place = np.flatnonzero(whole)
                alive = set(place[phrases._alive(flags, 18, key[place])].tolist())
                for i in place.tolist():
                    w = tuple(low[got[0][at + i] : got[0][at + i + m - 1] + got[1][at + i + m - 1]].decode().split())
                    if f[langs[row[at + i]], tuple(x for x in w)] >= 9:
                        assert i in alive


def test_blocks_of_words(spark, monkeypatch):
    """Phrases over the edges of steps, slices and blocks, and tasks that count often."""
    rows = [*corpus(4), ("en", "quick brown fox a, " * 400), ("en", "b" * 3000 + " the of a" * 200)]
    want = slow(rows, 6)
    monkeypatch.setattr(phrases, "AT_ONCE", 7)
    monkeypatch.setattr(phrases, "STEP_BYTES", 64)
    flags, bits = phrases.sketch(table(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "text"), 6, 4, 16), 16
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if x is None else x for x, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])

    class Held:
        value = flags

    total = collections.Counter()
    monkeypatch.setattr(phrases, "HOLD", 50)
    for b in phrases._counter(Held, bits, 4)([batch]):
        for r in b.to_pylist():
            total[r["lang"], r["phrase"].decode(), r["m"]] += r["f"]
    f, n = slow_counts(rows, 4)
    assert {k: v for k, v in total.items() if v >= 6 and k[2]} == {(lang, " ".join(w), len(w)): c for (lang, w), c in f.items() if c >= 6}
    assert {k[0]: v for k, v in total.items() if not k[2]} == dict(n)
    assert want


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint32), r.integers(0, 2**32, 1000, dtype=np.uint32), np.arange(5, dtype=np.uint32)):
        assert (phrases._unpacked(phrases._packed(a), len(a)) == a).all()


def test_long_products(spark):
    """Counts whose products pass 64 bits."""
    big = 6 * 10**12
    freq = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1), ("en", "a b c", 3, big - 5), ("en", "b c", 2, big - 5), ("en", "c", 1, big - 5), ("en", "", 0, 3 * big)], "lang string, phrase string, m int, f long")
    got = [tuple(r) for r in phrases.scored(freq).collect()]
    cuts = [(2000000 * (big - 5) // (big + big - 5), 1), (2000000 * (big - 5) // (big - 1 + big - 5), 2)]
    assert got == [("en", "a b c", big - 5, big, big - 5, min(cuts)[0])]


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(table(spark, [("en", None), (None, ""), ("en", "one two")])).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(none, most=1)
    whole = "word " * 200_000  # one very long text without any end
    got = found(phrases.collocations(table(spark, [("en", whole)])))
    assert got == slow([("en", "word " * 200)], 30) or [r[2:4] for r in got] == [("word word word word", 199_997)]
