"""Toxicity by maximum-scoring segments.

Tokens are words and word beginnings.  Each token that labelled documents have is scored
by its log-odds of toxic against clean documents under Dirichlet priors.  Tokens whose
likelihood ratio stands out among all that were tried are telling: they count in full,
with a flat prior.  All others count for what a passage of which a tenth is telling
would owe them, either way, with a prior that is worth ``PRIOR`` documents and follows
the token's share of all labelled text, so that few documents say little.  A linear-time scan (Ruzzo and Tompa, 1999) finds every maximal segment of
a text.  Segment scores are turned into significance by the extreme-value law of such
scores (Karlin and Altschul, 1990 and 1993: best sum of the r best segments in a text of
n tokens), and a logistic curve turns significance into a probability.  Its constants
come from labelled documents, each scored as if it had not been counted itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, bounded, crc_bucket, cut, pieces, table

#: Beginnings of a word that count as tokens beside the word itself.
PREFIXES = (3, 4, 5)
#: Bound of the fit: labelled rows of each class, those with the smallest hash.
FIT_ROWS = 20_000
#: Bound of the scored tokens, which workers get as a whole: those with the largest scores either way.
LEXICON = 100_000
#: Flat prior of a telling token, its least log-odds, and the tokens that would be telling by chance.
FLAT, TELLING, CHANCE = 0.5, 3.0, 0.5
#: Documents that the prior of the other tokens is worth; standard errors that their log-odds must exceed, so that of millions hardly one does by chance.
PRIOR, SURE = 200.0, 6.0
#: Share of a toxic passage's words that tell.
DENSITY = 0.1
REST = math.log1p(-DENSITY)
#: Segments from this score on fit the extreme-value law's constant.
FLOOR = 3.0
#: Words that a worker remembers before it starts anew.
REMEMBERED = 200_000
_STRIP = re.compile(r"[\W_]+")


def tokens_of(word: str) -> list[str]:
    """Features of one whitespace-separated word: the bare word after "=", its beginnings after their length."""
    w = _STRIP.sub("", word)
    if not w:
        return []
    return ["=" + w] + [f"{n}{w[:n]}" for n in PREFIXES if len(w) >= n]


@dataclass(frozen=True)
class Model:
    """Everything a worker needs; its size is bounded by LEXICON."""

    #: Clean and toxic documents that have each token, whether it is telling, and the numbers of documents.
    lexicon: dict[str, tuple[float, float, bool]]
    clean: float
    toxic: float
    lam: float
    k: float
    a: float
    b: float


def telling_odds(clean: float, toxic: float, all_clean: float, all_toxic: float) -> float:
    """Log-odds of having a token, under the flat prior."""
    rate = lambda n, of: math.log((n + FLAT) / (of + FLAT - n))
    return min(rate(toxic, all_toxic) - rate(clean, all_clean), 8.0)


def other_odds(clean: float, toxic: float, all_clean: float, all_toxic: float) -> float:
    """Log-odds under the prior that follows the token's share of all text; 0 where its standard errors could explain it."""
    if clean + toxic <= 0:
        return 0.0
    prior = PRIOR * (clean + toxic + 0.5) / (all_clean + all_toxic + 1)
    d = math.log((toxic + prior) / (all_toxic + PRIOR)) - math.log((clean + prior) / (all_clean + PRIOR))
    return d if abs(d) >= SURE * math.sqrt(1 / (toxic + prior) + 1 / (clean + prior)) else 0.0


class _Weights(dict):
    """Score of a word as it stands in the text, remembered: its most telling token, else the one that says most.

    ``own``: the class of the document at hand if it is one of those that were counted; it is taken out then.
    """

    def __init__(self, lexicon, clean, toxic, own=None):
        self.lexicon, self.own = lexicon, own
        self.totals = clean - (own == 0), toxic - (own == 1)

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        best, weak = -math.inf, 0.0
        for t in tokens_of(word):
            if (n := self.lexicon.get(t)) is not None:
                c, y, telling = n[0] - (self.own == 0), n[1] - (self.own == 1), n[2]
                if telling:
                    best = max(best, telling_odds(c, y, *self.totals))
                elif t[0] == "=":  # beginnings are shared by too many words
                    weak = other_odds(c, y, *self.totals)
        out = self[word] = best if best > 0 else math.log1p(DENSITY * math.expm1(weak)) + REST
        return out


def segments(scores: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence; ``rest`` < 0 is what an item scores that tells nothing."""
    where = np.flatnonzero(scores > 0)
    if not len(where):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    best_before: list[int] = []  # for each, the nearest earlier one with a smaller sum before
    for i in where.tolist():
        right = float(total[i])
        cur = (i, i + 1, right - float(scores[i]), right)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = best_before[j]
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                best_before.append(j)
                break
            cur = (found[j][0], cur[1], found[j][2], cur[3])
            del found[j:], best_before[j:]
    return [(s, e, r - l) for s, e, l, r in found]


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """-ln of the smallest chance, over r, that random text of n tokens holds r segments of this sum."""
    best, total, base = 0.0, 0.0, math.log(k * max(n, 1))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += lam * s - base
        t = max(total + math.lgamma(r + 1), 1e-9)
        best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) if r > 1 else t)
        if lam * s < base:
            break
    return best


def _scores(weights: _Weights, text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(weights.__getitem__, words), np.float64, len(words))


def _scan(lexicon, clean: float, toxic: float, own: int | None = None):
    weights = _Weights(lexicon, clean, toxic, own)
    return lambda text: ((s := _scores(weights, text)), segments(s, REST))


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): at most ``rows`` labelled documents of each class, near copies counted once.  Ids that carry both labels are left out."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    one = one.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").select("doc_id", "toxic")
    one = cut(one)
    kept = [bounded(one.where(F.col("toxic") == y), F.xxhash64("doc_id"), rows) for y in (0, 1)]
    ids = cut(kept[0].unionByName(kept[1]))  # 2 x rows at most, so it may be broadcast
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    keyed = named.mapInArrow(_keys, "doc_id long, text string, toxic int, key long")
    return keyed.groupBy("toxic", "key").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "toxic")


def _keys(batches):
    """Adds the smallest hash of the text's five-word shingles, which nearly all near copies share."""
    for part, texts in pieces(batches):
        keys = []
        for text in texts:
            w = text.lower().split()
            keys.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass"), 7) for i in range(max(len(w) - 4, 1))), default=0) >> 1)
        yield arrow(doc_id=part.column(0), text=part.column(1), toxic=part.column(2), key=keys)


def _counts(batches):
    """Documents of each class that have a token; the token "" has all documents."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    docs = [0, 0]

    def flush():
        out = arrow(token=list(counts), clean=[c[0] for c in counts.values()], toxic=[c[1] for c in counts.values()])
        counts.clear()
        return out

    for part, texts in pieces(batches):
        for text, y in zip(texts, part.column(part.schema.get_field_index("toxic")).to_pylist(), strict=True):
            for t in {t for w in set(text.lower().split()) for t in tokens_of(w)}:
                counts[t][y] += 1
            docs[y] += 1
        if len(counts) > 300_000:
            yield flush()
    counts[""] = docs
    yield flush()


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted fit of sigmoid(a + b x) with a weak pull to (-2, 1)."""
    beta, prior, pull = np.array([-2.0, 1.0]), np.array([-2.0, 1.0]), 0.5
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - pull * (beta - prior)
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + pull * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(lambda score) = 1, for scores with a negative mean of which some are positive."""
    f = lambda v: float((share * np.exp(np.minimum(v * scores, 50.0))).sum() - 1)
    if not len(scores) or scores.max() <= 0 or f(1e-6) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _lexicon(counts: DataFrame, nc: float, nt: float, size: int) -> dict[str, tuple[float, float, bool]]:
    """(clean, toxic, telling) of all telling tokens and of those whose other log-odds stand out, the largest first if there are too many."""
    c, t = F.col("clean").cast("double"), F.col("toxic").cast("double")
    flat = F.log((t + FLAT) / (nt + FLAT - t)) - F.log((c + FLAT) / (nc + FLAT - c))
    seen, n = c + t, nc + nt
    part = lambda got, hoped: F.when(got > 0, got * F.log(got / hoped)).otherwise(0.0)
    g2 = 2 * (part(t, seen * (nt / n)) + part(c, seen * (nc / n)) + part(nt - t, (n - seen) * (nt / n)) + part(nc - c, (n - seen) * (nc / n)))
    edge = 2 * math.log(max(counts.where("toxic >= 3").count() / CHANCE, 2.0))
    prior = (c + t + 0.5) * (PRIOR / (n + 1))
    odds = F.log((t + prior) / (nt + PRIOR)) - F.log((c + prior) / (nc + PRIOR))
    sure = F.abs(odds) >= SURE * F.sqrt(1 / (t + prior) + 1 / (c + prior))
    told = counts.withColumns({"telling": (flat >= TELLING) & (g2 >= edge), "flat": flat, "odds": odds}).where(F.col("telling") | sure & F.startswith("token", F.lit("=")))
    value = F.when(F.col("telling"), 8 + F.least("flat", F.lit(7.99))).otherwise(F.least(F.abs("odds"), F.lit(7.99)))
    key = F.shiftleft(F.floor((16 - value) * 4095).cast("long"), 48)
    return {r.token: (float(r.clean), float(r.toxic), r.telling) for r in bounded(told, key, size).collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, lexicon_size: int = LEXICON) -> Model:
    """Token counts, extreme-value constants and calibration from at most ``rows`` labelled documents of each class.

    Without toxic or clean rows no token tells anything and all texts score alike.
    """
    train = cut(_training(docs, labels, rows))
    counts = cut(train.mapInArrow(_counts, "token string, clean long, toxic long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic")]))
    sums = counts.where("token = ''").first()
    nc, nt = (float(sums.clean), float(sums.toxic)) if sums else (0.0, 0.0)
    lexicon: dict[str, tuple[float, float]] = {}
    if nc and nt:
        lexicon = _lexicon(counts.where("token <> ''"), nc, nt, lexicon_size)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON entries at most

    def stats(batches):
        scans = [_scan(shared.value, nc, nt, y) for y in (0, 1)]
        for part, texts in pieces(batches):
            y = part.column(part.schema.get_field_index("toxic")).to_pylist()
            got = [scans[c](x) for x, c in zip(texts, y, strict=True)]
            clean = [a for (a, _), c in zip(got, y, strict=True) if not c]
            kind, n = np.unique(np.round(np.concatenate(clean) * 50).astype(np.int64), return_counts=True) if clean else (np.zeros(0, np.int64),) * 2
            yield arrow(toxic=pa.array([*y, *[-1] * len(kind)], pa.int32()), n=pa.array([*(len(a) for a, _ in got), *n.tolist()], pa.int64()), s=pa.array([*([x[2] for x in b] for _, b in got), *([k / 50] for k in kind.tolist())], pa.list_(pa.float64())))

    every = cut(train.mapInArrow(stats, "toxic int, n long, s array<double>"))
    words = every.where("toxic = -1").groupBy(F.col("s")[0].alias("s")).agg(F.sum("n").alias("n")).collect()  # a few thousand scores
    got = every.where("toxic >= 0").collect()
    n = np.array([float(r.n) for r in words])
    lam = _lambda(np.array([r.s for r in words]), n / max(n.sum(), 1.0))
    clean = [r for r in got if not r.toxic]
    k = (sum(sum(x >= FLOOR for x in r.s) for r in clean) + 0.5) / max(sum(r.n for r in clean) * math.exp(-lam * FLOOR), 1.0)
    k = min(max(k, 1e-9), 1.0)
    if clean and len(clean) < len(got):
        sizes = labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()
        share = {r.toxic: r["count"] for r in sizes}
        y = np.array([float(r.toxic) for r in got])
        weight = np.where(y > 0, share.get(1, 1) / y.sum(), share.get(0, 1) / (len(y) - y.sum()))
        a, b = _logistic(np.log1p([evidence(r.s, r.n, lam, k) for r in got]), y, weight / weight.mean())
    else:
        a, b = -2.0, 1.0
    return Model(lexicon, nc, nt, lam, k, a, max(b, 0.0))


def _probability(s, found, lam: float, k: float, a: float, b: float) -> float:
    """Score of a text from its tokens' scores and its segments."""
    return 1 / (1 + math.exp(-min(max(a + b * math.log1p(evidence([x[2] for x in found], len(s), lam, k)), -30), 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score in (0, 1), passages (array of start, end in code points, score).

    Null and empty texts have no passage and the score of an innocent text; repeated rows and null ids stay;
    other columns of ``docs`` are ignored, whatever their names; an empty table gives no row.
    """
    lam, k, a, b = model.lam, model.k, model.a, model.b
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.clean, model.toxic))  # LEXICON entries at most

    def step(batches):
        scan = _scan(*shared.value)
        for part, texts in pieces(batches):
            scores, spans = [], []
            for text in texts:
                text = text or ""
                s, found = scan(text)
                scores.append(_probability(s, found, lam, k, a, b))
                if found:
                    at = [m.span() for m in re.finditer(r"\S+", text)]
                    spans.append([{"start": at[i][0], "end": at[j - 1][1], "score": v} for i, j, v in found])
                else:
                    spans.append([])
            yield _with_spans(part.column(0), scores, spans)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(step, "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")


def _with_spans(ids, scores, spans):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return arrow(doc_id=ids, score=scores, passages=pa.array(spans, kind))


#: From this score on a document is toxic.
THRESHOLD = 0.3


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored toxic; each is judged by its own text, whatever its id."""
    model = fit(docs, labels)
    lam, k, a, b = model.lam, model.k, model.a, model.b
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.clean, model.toxic))  # LEXICON entries at most
    column = next(c for c in docs.columns if c.lower() == "text")

    def step(batches):
        scan = _scan(*shared.value)
        for part, texts in pieces(batches, column):
            yield part.filter(pa.array([_probability(*scan(x or ""), lam, k, a, b) < THRESHOLD for x in texts], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``; labels of held-out rows are never read by the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(crc_bucket("doc_id", 4) != 2)))
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op7_toxicity_segments": op7}
SQL: dict[str, str] = {}
