"""Quality rules as learned decision lists, with DataFrame functions only.

Statistics of whole texts are built-in expressions within one stage, without a
shuffle.  Sequential covering (in the manner of RIPPER, Cohen 1995) grows
conjunctions of thresholds on the statistics of a bounded number of labelled rows,
prunes each on rows it wasn't grown on, removes what it covers, and goes on.  The
ordered rules are one Spark conditional expression, applied to every row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bounded, staged, table

_SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Bound of the fit: labelled rows, those with the smallest hash of their id.
FIT_ROWS = 40_000
#: Statistics that rules may set thresholds on.
RATIOS = {
    "symbol_share": "n_symbols / greatest(n_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaim / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text; null text has no words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as in the contract of the query; n_chars, n_lines (with
    a word), n_upper, n_exclaim, n_digits, n_distinct_words beside them.  Repeated rows and null ids stay; other columns
    are ignored, whatever their names.
    """
    # Each step's column is used at least twice by the next one, so that Catalyst keeps the steps apart and nothing that
    # a lambda refers to is computed anew for each element.
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.withColumn("bare", F.btrim("text", F.lit(_SPACE)))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    d = d.select(
        "doc_id",
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
        F.length("text").alias("n_chars"),
        without(r"[^\x20\x09-\x0D]+").alias("word_chars"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        without("[A-Z]+").alias("n_upper"),
        without("!+").alias("n_exclaim"),
        without("[0-9]+").alias("n_digits"),
    )
    d = d.select(
        "doc_id", "n_chars", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_digits",
        F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct_words"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    keep = [c for c in d.columns if c != "hashes"]
    starts = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    d = d.select(*keep, F.when(F.size("hashes") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).alias("windows"))
    # most texts repeat no window; only for the others are windows sorted with their places
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.select(*keep, F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"))
    h = lambda i: F.get("sorted", i)["h"]
    twice = F.filter("sorted", lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
    d = d.select(*keep, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("places"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("places", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in keep if c != "doc_id"], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """The base rules over ``statistics``."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, ">=" or "<=", threshold) that rejects a text."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        return F.expr(" and ".join(f"({RATIOS[s]}) {op} {v!r}D" for s, op, v in self.tests))

    def __str__(self) -> str:
        return " and ".join(f"{s} {op} {v:.6g}" for s, op, v in self.tests)


def _covers(rule: list, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, op, v in rule:
        c = x[:, names.index(s)]
        out &= c >= v if op == ">=" else c <= v
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, depth: int) -> list:
    """Adds the test of the largest FOIL gain until only bad rows are covered."""
    rule: list = []
    inside = np.ones(len(x), bool)
    while len(rule) < depth and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for j, name in enumerate(names):
            c = x[:, j]
            values = np.unique(np.quantile(c[inside & bad], np.linspace(0, 1, cuts)))
            for op in (">=", "<="):
                got = (c[None, :] >= values[:, None]) if op == ">=" else (c[None, :] <= values[:, None])
                got &= inside
                p, n = (got & bad).sum(1), (got & ~bad).sum(1)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float(values[k])), got[k])
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], least: float = 0.95, cuts: int = 24, depth: int = 4, most: int = 12) -> list[Rule]:
    """Ordered rules for ``bad`` rows by sequential covering; each is at least ``least`` precise on what it was pruned on.

    A threshold lies halfway to the nearest covered good row's value if there is one beyond it.
    """
    prune = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most and (left & bad & ~prune).sum() >= 2:
        g, v = left & ~prune, left & prune
        rule = _grow(x[g], bad[g], names, cuts, depth)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):  # prune: the beginning that does best on the other rows
            got = _covers(rule[:k], x[v], names)
            p, n = (got & bad[v]).sum(), (got & ~bad[v]).sum()
            worth.append(((p - n) / (p + n) if p + n else -1.0, k))
        k = max(worth, key=lambda w: (w[0], -w[1]))[1]
        rule = rule[:k]
        if rule:
            rule = _widened(rule, x[left], bad[left], names)
        got = _covers(rule, x, names) & left
        p, n = (got & bad).sum(), (got & ~bad).sum()
        if not p or p / (p + n) < least:
            break
        rules.append(Rule(tuple(rule)))
        left &= ~got
    return rules


def _widened(rule: list, x: np.ndarray, bad: np.ndarray, names: list[str]) -> list:
    """Moves each threshold halfway towards the nearest good row that the rest of the rule covers."""
    out = list(rule)
    for i, (s, op, v) in enumerate(rule):
        c = x[_covers(out[:i] + out[i + 1 :], x, names) & ~bad][:, names.index(s)]
        c = c[c < v] if op == ">=" else c[c > v]
        if len(c):
            out[i] = (s, op, float((v + (c.max() if op == ">=" else c.min())) / 2))
    return out


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled rows that pass the base rules; ids that carry both labels are left out."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    one = one.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")
    named = stats.where(~base_failed()).join(one, "doc_id").select("doc_id", "y", *[F.expr(e).cast("double").alias(c) for c, e in RATIOS.items()])
    got = [list(r) for r in bounded(named, F.xxhash64("doc_id"), rows).collect()]
    if not got:
        return []
    got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))  # the order decides what a rule is pruned on
    x = np.array([r[2:] for r in got], float)
    return learn(x, np.array([r[1] == 0 for r in got]), list(RATIOS))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row, 0 if none does: one ordered conditional expression."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """statistics of each row with base_failed, rule (0: none) and kept; an empty table gives no row."""
    stats = staged(statistics(docs))
    rule = verdict(fit(stats, labels))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule.cast("int")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``."""
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op4_rules_decision_list": op4}
SQL: dict[str, str] = {}
