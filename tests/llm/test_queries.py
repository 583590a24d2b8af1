"""The registered queries on a small folder of tables: the contracts' columns, and values by brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from evalforge.llm import chat, extract, packing, quality, rules, simhash, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(260):
        junk = i % 4 == 0
        words = [word() + ("###" if junk else "") for _ in range(rnd.randrange(5, 90))]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", f"s{i % 3}", 7))
        labels.append((i, int(not junk), int(i % 9 == 0)))
    rows += [(None, rows[1][1], None, None, None), (300, None, "en", "s1", 0), (301, "", "en", "s1", 0), (302, "same line of eight words here for all\n" * 6, "en", "s1", 0), (1, rows[1][1], "en", "s1", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h{i % 4}.example/{i}", f"<html><body><nav><ul><li>Menu</li></ul></nav><article><h1>T{i}</h1><p>{' '.join(word() for _ in range(15))}</p></article><footer>f</footer></body></html>") for i in range(40)] + [(None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    talk = [(c, t, rnd.choice(["user", "assistant", "Ann"]), word()) for c in range(5) for t in range(4)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rules(spark, folder):
    path, rows = folder
    got = rules.op4(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, text, *_ in rows:
        w = words_of(text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        for r in by[d]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == failed and r.kept == (not failed and r.rule == 0)
    kept = {r.doc_id for r in got if r.kept}
    assert not any(i % 4 == 0 for i in kept if i is not None and i < 260) and len(kept) > 100


def test_rules_verdict_is_the_list(spark):
    """The first rule that covers a row, evaluated by hand."""
    rnd = random.Random(3)
    some = [rules.Rule((("symbol_share", ">=", 0.1), ("words", "<=", 50.0))), rules.Rule((("upper_share", ">=", 0.4),))]
    rows = [(rnd.randrange(200), rnd.randrange(200), rnd.randrange(40), rnd.randrange(100), rnd.randrange(1, 100)) for _ in range(200)]
    zeros = {"n_exclaim": 0, "n_digits": 0, "n_dup_lines": 0, "n_lines": 1, "n_repeat_words": 0, "n_distinct_words": 1}
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n_words long, n_chars long, n_symbols long, n_upper long, word_chars long").withColumns({k: F.lit(v) for k, v in zeros.items()})
    got = {r.i: r.v for r in d.select("i", rules.verdict(some).alias("v")).collect()}
    for i, (words, chars, symbols, upper, letters) in enumerate(rows):
        first = 1 if symbols / max(chars, 1) >= 0.1 and words <= 50 else 2 if upper / max(letters, 1) >= 0.4 else 0
        assert got[i] == first


def test_packing(spark, folder):
    path, rows = folder
    got = packing.op5(spark, path).collect()
    known = packing.words(packing.default_tokenizer())
    ids = {d: np.r_[known.ids(t or ""), 2] for d, t, *_ in rows}
    assert sum(r.length for r in got) == sum(len(ids[d]) for d, *_ in rows)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(piece.astype("<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_extract(spark, folder):
    path, _ = folder
    got = {r.page_id: r for r in extract.op6(spark, path).collect()}
    assert len(got) == 41 and got[None].text == "" and got[None].n_chars == 0
    assert all(got[i].text.startswith(f"T{i}\n") and "Menu" not in got[i].text and got[i].n_chars == len(got[i].text) for i in range(40))


def test_near_dedup(spark, folder):
    path, rows = folder
    got = simhash.op9(spark, path).collect()
    fp = [(d, simhash.fingerprint(t)) for d, t, *_ in rows]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((str(d), f"{f:016x}", str(low.get(find(i)))) for i, (d, f) in enumerate(fp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_chat(spark, folder):
    got = chat.op10(spark, folder[0])
    assert {"conv_id", "speaker", "segment", "start", "train"} <= set(got.columns) and got.count() >= 20


def test_handed_sums(spark, folder):
    """What a view is handed, summed over the cluster, against the sums of all rows at once."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    feats = quality.features(docs).collect()
    x = {v: np.array([r[v] for r in feats], float) for v in "cm"}
    y = np.array([float(i % 2) for i in range(len(feats))])
    learners = {v: quality.Learner.start(x[v], y) for v in "cm"}
    rnd = np.random.default_rng(1)
    givers = {v: quality.View(v, tuple(rnd.normal(size=x[v].shape[1]) * 3), 0.3) for v in "cm"}
    got = quality._handed(quality.features(docs).repartition(3), givers, learners, 0.4)
    edge = math.log(quality.SURE / (1 - quality.SURE))
    for v, o in (("c", "m"), ("m", "c")):
        sure = givers[o].of(x[o])
        use = (sure >= 0.4 + edge) | (sure <= -edge)
        grad, curve = quality._sums(learners[v].standard(x[v][use]), (sure[use] > 0).astype(float), learners[v].beta)
        assert got[v][2] == use.sum() > 0
        assert np.allclose(got[v][0], grad, rtol=1e-5, atol=1e-5) and np.allclose(got[v][1], curve, rtol=1e-5, atol=1e-5)


def test_toxicity_scores(spark, folder):
    """Scores of texts by the definition: words' tokens, all maximal segments, the law, the curve."""
    path, rows = folder
    labels = spark.read.parquet(f"{path}/labels.parquet")
    marked = spark.createDataFrame([(d, t if d is None or d % 9 or d >= 260 else f"{t} zounds zounds") for d, t, *_ in rows], "doc_id long, text string")
    texts = {(d, t if d is None or d % 9 or d >= 260 else f"{t} zounds zounds") for d, t, *_ in rows}
    model = toxicity.fit(marked, labels)

    def word(w):
        found = [model.lexicon[t] for t in toxicity.tokens_of(w) if t in model.lexicon]
        full = [toxicity.telling_odds(c, t, model.clean, model.toxic) for c, t, telling in found if telling]
        if full and max(full) > 0:
            return max(full)
        bare = [x for x in toxicity.tokens_of(w) if x[0] == "=" and x in model.lexicon]
        weak = toxicity.other_odds(*model.lexicon[bare[0]][:2], model.clean, model.toxic) if bare and not model.lexicon[bare[0]][2] else 0.0
        return math.log(0.9 + 0.1 * math.exp(weak)) + math.log(0.9)  # and what a word pays that tells nothing

    assert model.lexicon["=zounds"][2]
    of = {d: t or "" for d, t in texts}
    for r in toxicity.score(marked, model).collect():
        s = np.array([word(w) for w in of[r.doc_id].lower().split()])
        found = toxicity.segments(s, toxicity.REST) if len(s) else []
        e = toxicity.evidence([v for _, _, v in found], len(s), model.lam, model.k)
        want = 1 / (1 + math.exp(-min(max(model.a + model.b * math.log1p(e), -30), 30)))
        assert abs(r.score - want) < 1e-9 and len(r.passages) == len(found)
