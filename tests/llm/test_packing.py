import random
import zlib

import numpy as np
import pytest

from evalforge.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


TEXTS = [None, "", " ", "Hello, World!! it's 42 DON'T", "Équeêment mentan İstanbul ΣΑΣ", "á é ½ ª º ß ŉ", "x" * 300, "<|endoftext|> über\x0b\x1cstraße\tñandú", "日本語 text 🙂", "won't 'tis they'll I'd we've ''s 'S", "1234 5.6%%% foo### $$$"]


def test_ids(tokenizer):
    known = packing.words(packing.default_tokenizer())
    rnd = random.Random(4)
    more = ["".join(rnd.choice("abcdéñöüß's '.,!?-–12%$#\n\tABCÉÑ") for _ in range(rnd.randrange(200))) for _ in range(300)]
    for t in TEXTS + more:
        assert known.ids(t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def whole(lengths):
    got = packing.pack(np.array(lengths, np.int64))
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in got:
        assert n > 0
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(by_doc.get(d, [])):
            assert s == at
            at += k
        assert at == n
    padding = 0
    for q in by_seq.values():
        at = 0
        for o, k in sorted(q):
            assert o == at
            at += k
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding, sum(len(v) for v in by_doc.values())


@pytest.mark.parametrize("seed", range(8))
def test_pack(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 64, 65, 4095, 4096, 4097, 9000, rnd.randrange(1, 20000), rnd.randrange(1, 800)]) for _ in range([0, 1, 2, 5, 50, 700, 700, 2500][seed])]
    padding, _ = whole(lengths)
    assert padding == 0


def test_few_cuts():
    rnd = random.Random(9)
    lengths = [rnd.randrange(40, 1500) for _ in range(3000)]
    _, n = whole(lengths)
    assert n < 1.35 * len(lengths)


def test_patterns_reach_the_bound():
    demand = np.zeros(64, int)
    demand[[20, 22, 30, 12, 6]] = [97, 120, 50, 211, 395]
    form, amount = packing.patterns(demand)
    assert ((form * np.arange(1, 65)[:, None]).sum(0) <= 64).all()
    assert (form @ amount >= demand - 1e-6).all()
    assert amount.sum() < (demand * np.arange(1, 65)).sum() / 64 * 1.03


def test_packed(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, TEXTS[3], "z"), (50, "long words here " * 5000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.packed(docs, ids=True).collect()
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(d == r.doc_id and x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for d, x in ids)
    assert packing.packed(docs.limit(0)).count() == 0


def test_frequent_words_stay_remembered(monkeypatch):
    """Words that come again and again aren't tokenised anew when a worker's memory is full; ids stay the tokenizer's."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    known = packing.Words(packing.default_tokenizer())
    asked = []
    inner = known.model
    known.model = type("Counting", (), {"tokenize": lambda self, p: asked.append(p) or inner.tokenize(p)})()
    texts = [f"often again, too x{i}y rare{i} équeê" for i in range(300)]
    for t in texts:
        assert (known.ids(t) == known._whole(t)).all()
    assert known.plain and asked.count("often") == asked.count("again") == 1
