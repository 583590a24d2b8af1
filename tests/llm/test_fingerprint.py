import hashlib
import random

import pytest

from evalforge.llm import fingerprint as fp


def test_homomorphic():
    a = ["one two", "three four five", "", "one two"]
    v = fp.vector(a)
    assert fp.encoded(v) == fp.encoded(fp.vector(a[::-1])) != fp.encoded(fp.vector(a[:3]))
    assert fp.encoded(fp.add(fp.vector(a[:2]), fp.vector(a[2:]))) == fp.encoded(v)
    assert fp.encoded(fp.subtract(v, fp.vector(["one two"]))) == fp.encoded(fp.vector(a[1:]))
    assert fp.likeness(fp.decoded(fp.encoded(v)), v) == 1.0


def table(rows):
    """What the contract says, row by row; rows: (id, text), ids distinct."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        out[d] = (len(t), t[: len(t) - n] + nxt[:n], t, nxt)
    return out


@pytest.mark.parametrize("n", [1, 2, 60])
def test_edits(spark, n):
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdeé🙂") for _ in range(rnd.randrange(1, 7)))
    rows = [(i * 7, rnd.choice(["\n", " "]).join(" ".join(word() for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(12)))) for i in range(n - 1)]
    rows += [(-5, None)] if n == 2 else [(None, "null id here")] if n > 2 else [(1, "lone text\nhere")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fp.edits(docs).collect()}
    want = table(rows)
    assert set(got) == set(want)
    for d, (chars, edited, text, nxt) in want.items():
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (chars, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fp.encoded(fp.text_vector(text)) and r.edited_fingerprint == fp.encoded(fp.text_vector(edited))
        assert r.near_next == fp.likeness(fp.text_vector(text), fp.text_vector(nxt))
    assert fp.edits(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs).count() == n


def test_edits_are_nearer_than_others():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(rnd.randrange(5, 300))) for _ in range(60)]
    for t, nxt in zip(texts, texts[1:]):
        _, ev = fp.replaced(t, nxt, fp.text_vector(t))
        assert fp.likeness(fp.text_vector(t), ev) > fp.likeness(fp.text_vector(t), fp.text_vector(nxt)) + 0.1


def test_repeated_and_null_ids(spark):
    """Rows that share an id, or have none, follow each other by their texts' hashes; a third of all rows may do so."""
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(rnd.randrange(1, 30)))
    rows = [(rnd.choice([None, 7, 7, i, i - 2**63 + 1]), text()) for i in range(400)] + [(2**63 - 1, text()), (-(2**63), text()), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        n = len(r.text) // 3
        want.append((str(r.doc_id), len(r.text), hashlib.sha256((r.text[: len(r.text) - n] + nxt.text[:n]).encode()).hexdigest()))
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in fp.edits(docs).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sorted(got) == sorted(want)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fp.op3(spark, str(tmp_path)).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[2].near_next == 1.0
    assert fp.op3(spark, str(tmp_path)).columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
