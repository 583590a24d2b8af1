import random
import re

import numpy as np

from evalforge.llm import rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def test_statistics(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["a", "bé", "c#", "🙂x", "D|", "e"])
    texts = [None, "", " \n ", "a", "x\n\nx\n x\nx", "one two three four five six seven eight " * 2, " ".join("ab" for _ in range(9)), "\x0bq r s\r\nq"]
    texts += ["".join(word() + rnd.choice([" ", " ", "\n", "\t\x0c"]) for _ in range(rnd.randrange(200))) for _ in range(60)]
    texts += [" ".join(f"w{i % 37 if i > 400 else i}" for i in range(6000))]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "n n", 1), (0, None, 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == slow(t), (i, t)
    assert rules.statistics(docs).count() == len(texts) + 2
    assert rules.statistics(docs.limit(0)).count() == 0


def test_learned_list(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(30, 90))]
        kind = i % 6
        if kind == 0:
            words = [w + rnd.choice(["###", "%%"]) for w in words]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        if i % 3 != 2:
            labels.append((i, int(kind > 1), 0))
    rows += [(9000, None), (9001, "too short")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judged(docs, lab).collect()}
    assert all(got[i].kept == (i % 6 > 1) for i in range(900))
    assert got[9000].base_failed and not got[9000].kept and not got[9001].kept
    none = rules.judged(docs, lab.limit(0)).where("kept = base_failed").count()
    assert none == 0


def test_rules_are_interpretable():
    x = np.array([[float(i), float(i % 7)] for i in range(300)])
    got = rules.learn(x, x[:, 0] >= 200, ["words", "word_length"])
    assert len(got) == 1 and got[0].tests[0][:2] == ("words", ">=") and 199 <= got[0].tests[0][2] <= 200


def test_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
