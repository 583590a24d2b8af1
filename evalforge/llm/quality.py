"""Quality classifier by co-training.

Two logistic models see two views of a document: what its words are (content: counts
of hashed words, and the make-up of its characters and words) and how it comes
(metadata: language, source, stated length, layout of lines).  In each round, each
view labels the unlabelled documents of which it is sure, and hands *all* of them to
the other (Blum and Mitchell, 1998), copies of a text once.  They reach the other view
as sums: each step adds the gradient and the curvature of all rows, summed over
the cluster, to those of the labelled rows, weighted so that in all they count a quarter of
what the labelled rows do.  A view keeps what a round taught it only if labelled rows that
neither was fitted on are told apart better with it; when neither gains, the exchange ends.
Both views are then calibrated on those rows and combined into one probability for every
document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import arrow, bounded, pieces, staged, table

#: Bound of the fit: labelled rows, those with the smallest hash of their id.
FIT_ROWS = 40_000
#: Rounds of the exchange, and steps (passes over the unlabelled rows) of each.
ROUNDS, STEPS = 3, 4
#: A view hands over the documents to which it gives a class with this probability, and with as much beyond the class's share.
SURE = 0.95
#: All rows handed over count at most so much as the labelled ones.
HANDED = 0.25
#: Sums of the unlabelled rows are added up in so many groups before the driver adds those.
GROUPS = 64
#: Documents with at least this probability of good quality are kept.
THRESHOLD = 0.5
CONTENT = ("log_words", "word_length", "symbols", "upper", "exclaims", "pipes", "digits", "stops", "other_ascii", "high_bytes", "distinct_words", "top_word", "same_as_last", "distinct_triples", "shouted", "decorated")
#: Columns that words are hashed to, each with the share of the text's words.
WORDS = 64
LANGS, SOURCES = 8, 16
METADATA = ("log_chars", "stated_off", "log_lines", "line_length", "repeated_lines", "blank_lines", "short_lines", "no_lang", "no_source") + tuple(f"lang{i}" for i in range(LANGS)) + tuple(f"source{i}" for i in range(SOURCES))
#: Words that a worker remembers before it starts anew.
REMEMBERED = 100_000
_SYMBOLS = [ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]


class _Slots(dict):
    """Word to its column, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass"), 3) % WORDS
        return out


_slots = _Slots()


def content_view(text: str) -> list[float]:
    """CONTENT of a whole text, and then the share of its words in each of WORDS columns."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, m = max(int(raw.sum()), 1), max(len(words), 1)
    letters = max(int(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()), 1)
    top = Counter(words).most_common(1)[0][1] if words else 0
    triples = max(len(words) - 2, 1)
    shouted = sum(map(str.isupper, words))
    decorated = sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words if len(w) > 1)
    return [
        math.log1p(len(words)), min((n - m) / m, 50.0), raw[_SYMBOLS].sum() / n, raw[65:91].sum() / letters, raw[33] / n, raw[124] / n, raw[48:58].sum() / n, raw[46] / m,
        (raw[33:48].sum() + raw[58:65].sum()) / n, raw[128:].sum() / n, len(set(words)) / m, top / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(zip(words, words[1:], words[2:]))) / triples, shouted / m, decorated / m,
        *(np.bincount(list(map(_slots.__getitem__, words)), minlength=WORDS) / m if words else np.zeros(WORDS)),
    ]


def metadata_view(text: str, lang: str | None, source: str | None, stated: int | None) -> list[float]:
    """METADATA: columns beside the text, and the layout of its lines."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    n, k = len(text), max(len(full), 1)
    hot = [0.0] * (LANGS + SOURCES)
    if lang is not None:
        hot[zlib.crc32(lang.encode("utf-8", "surrogatepass")) % LANGS] = 1.0
    if source is not None:
        hot[LANGS + zlib.crc32(source.encode("utf-8", "surrogatepass")) % SOURCES] = 1.0
    return [math.log1p(n), float(stated is None or stated != n), math.log1p(len(lines)), math.log1p(n / k), 1 - len(set(full)) / k, 1 - len(full) / len(lines), sum(len(x) < 20 for x in full) / k, float(lang is None), float(source is None), *hot]


_LISTS = {"c": len(CONTENT) + WORDS, "m": len(METADATA)}


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text_hash, c (content) and m (metadata) of each row; null text counts as empty, other nulls as a value of their own.

    With ``carry``, the columns of ``docs`` follow as d0.. in their order.
    """
    names = [c.lower() for c in docs.columns]
    own = {f"d{i}": "text" if c == "text" else f"d{i}" for i, c in enumerate(names)} if carry else {}  # the text is sent once

    def step(batches):
        for part, texts in pieces(batches):
            col = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
            texts = [x or "" for x in texts]
            views = {"c": [content_view(x) for x in texts], "m": [metadata_view(*x) for x in zip(texts, col("lang"), col("source"), col("n_chars"), strict=True)]}
            key = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in texts]
            lists = {v: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * _LISTS[v], np.array(x, np.float32).reshape(-1)) for v, x in views.items()}
            yield arrow(doc_id=part.column(0), text_hash=key, **lists, **{k: part.column(part.schema.get_field_index(v)) for k, v in own.items()})

    other = lambda c, kind: (F.col(c) if c in names else F.lit(None)).cast(kind).alias(c)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), other("lang", "string"), other("source", "string"), other("n_chars", "long"), *[F.col(f"`{docs.columns[int(k[1:])]}`").alias(k) for k, v in own.items() if v != "text"])
    schema = T.StructType.fromDDL("doc_id long, text_hash long, c array<float>, m array<float>")
    for k, f in zip(own, docs.schema.fields):
        schema.add(k, f.dataType)
    return src.mapInArrow(step, schema)


@dataclass(frozen=True)
class View:
    """A logistic model over the list in this column."""

    column: str
    weights: tuple[float, ...]
    bias: float

    def logit(self):
        """As a Spark expression."""
        weights = F.array(*map(F.lit, self.weights))
        return F.aggregate(F.zip_with(self.column, weights, lambda x, w: x.cast("double") * w), F.lit(self.bias), lambda a, x: a + x)

    def of(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.bias


def _gradient(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return z.T @ (y - 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))))


def _sums(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of rows ``z``, and a bound of its curvature (Boehning, 1992), so that no step overshoots."""
    return _gradient(z, y, beta), z.T @ z / 4


@dataclass
class Learner:
    """One view while it learns: standardised labelled rows, weights, and the sums of what it was handed."""

    z: np.ndarray
    y: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    curve: np.ndarray | None = None  # bound of the labelled rows' curvature

    @classmethod
    def start(cls, x: np.ndarray, y: np.ndarray) -> "Learner":
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = np.inf  # a constant column counts for nothing
        out = cls(np.empty(0), y, mean, scale, np.zeros(x.shape[1] + 1))
        out.z = out.standard(x)
        out.curve = out.z.T @ out.z / 4
        for _ in range(2000):
            if out.step() < 1e-4:
                break
        return out

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def step(self, grad=0.0, hess=0.0, share: float = 0.0) -> float:
        """One step with a ridge; ``grad`` and ``hess`` are of the rows handed over, weighted by ``share``."""
        own_grad, own_hess = _gradient(self.z, self.y, self.beta), self.curve
        ridge = np.r_[np.full(len(self.beta) - 1, PULL), 1e-3]
        move = np.linalg.solve(own_hess + share * hess + np.diag(ridge + 1e-6), own_grad + share * grad - ridge * self.beta)
        self.beta = self.beta + np.clip(move, -5, 5)
        return float(np.abs(move).max())

    def view(self, column: str) -> View:
        w = self.beta[:-1] / self.scale
        return View(column, tuple(map(float, w)), float(self.beta[-1] - w @ self.mean))


#: Ridge of the views.
PULL = 3.0


def _lists(batch: pa.RecordBatch, column: str) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index(column))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)


def _handed(free: DataFrame, givers: dict[str, View], learners: dict[str, Learner], prior: float) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """By view: gradient, curvature and number of the unlabelled rows that the other view is sure of."""
    edge = math.log(SURE / (1 - SURE))
    other = {"c": "m", "m": "c"}
    plain = {v: (x.mean, x.scale, x.beta) for v, x in learners.items()}

    def step(batches):
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {v: _lists(batch, v) for v in "cm"}
            for v in "cm":
                sure = givers[other[v]].of(x[other[v]])
                use = (sure >= max(0.0, prior) + edge) | (sure <= min(0.0, prior) - edge)
                mean, scale, beta = plain[v]
                z = np.column_stack([(x[v][use] - mean) / scale, np.ones(int(use.sum()))])
                grad, hess = _sums(z, (sure[use] > 0).astype(float), beta)
                old = total.get(v, (0.0, 0.0, 0))
                total[v] = (old[0] + grad, old[1] + hess, old[2] + len(z))
        for v, (grad, hess, n) in total.items():
            yield arrow(view=[v], sums=pa.array([np.r_[grad, hess.ravel()].tobytes()], pa.binary()), n=[n])

    def add(t: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("sums"))
        return pa.table({"view": [t.column("view")[0].as_py()], "sums": pa.array([sums.tobytes()], pa.binary()), "n": [sum(t.column("n").to_pylist())]})

    kind = "view string, sums binary, n long"
    rows = free.select("c", "m").mapInArrow(step, kind).withColumn("at", F.pmod(F.monotonically_increasing_id() / F.lit(1 << 33), F.lit(GROUPS)).cast("int"))
    got = rows.groupBy("view", "at").applyInArrow(lambda t: add(t.select(["view", "sums", "n"])), kind).collect()  # 2 x GROUPS rows at most
    out = {}
    for v, x in learners.items():
        mine = [r for r in got if r.view == v]
        d = len(x.beta)
        sums = sum((np.frombuffer(r.sums, np.float64) for r in sorted(mine, key=lambda r: bytes(r.sums))), np.zeros(d + d * d))
        out[v] = (sums[:d], sums[d:].reshape(d, d), sum(r.n for r in mine))
    return out


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on standardised columns, by Newton steps; weights for the raw columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(z.shape[1], pull)
    ridge[-1] = 1e-3
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w = beta[:-1] / scale
    return w, float(beta[-1] - w @ mean)


@dataclass(frozen=True)
class Model:
    """Both views and the weights that combine their calibrated log-odds."""

    content: View
    metadata: View
    mix: tuple[float, float, float]

    def probability(self):
        """Spark expression over the columns of ``features``."""
        clip = lambda v: F.least(F.greatest(v, F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-clip(F.lit(self.mix[0]) + clip(self.content.logit()) * self.mix[1] + clip(self.metadata.logit()) * self.mix[2])))


def _loss(views: dict[str, View], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    """Mean log loss of the calibrated combination of both views."""
    z = np.stack([np.clip(views[v].of(x[v]), -30, 30) for v in "cm"], 1)
    w, b = _fit(z, y, pull=0.1)
    return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w + b)).mean())


def _gained(learners: dict[str, Learner], before: dict[str, np.ndarray], x: dict[str, np.ndarray], y: np.ndarray) -> bool:
    """Of a round's weights and those before it, keeps for each view those with which labelled rows are told apart best; whether any are new."""
    after = {v: x_.beta for v, x_ in learners.items()}
    best, least = frozenset(), None
    for new in (frozenset(), frozenset("c"), frozenset("m"), frozenset("cm")):
        for v, x_ in learners.items():
            x_.beta = after[v] if v in new else before[v]
        loss = _loss({v: x_.view(v) for v, x_ in learners.items()}, x, y)
        if least is None or loss < least - 1e-9:
            best, least = new, loss
    for v, x_ in learners.items():
        x_.beta = after[v] if v in best else before[v]
    return bool(best)


def _one_label(labels: DataFrame) -> DataFrame:
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return one.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")


def fit(feats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Co-train over ``features`` of all documents; at most ``rows`` labelled rows, copies once, are read by the driver.

    Ids and texts that carry both labels are left out.  With one class of labels or none, every document scores that
    class's smoothed share.
    """
    feats = feats.select("doc_id", "text_hash", "c", "m")
    named = _one_label(labels)
    # copies count once, and texts that carry both labels not at all
    known = feats.join(named, "doc_id").groupBy("text_hash").agg(F.min("y").alias("y"), F.max("y").alias("top"), F.min(F.struct("doc_id", "c", "m")).alias("first")).where("y = top")
    train = bounded(known.select("first.*", "text_hash", "y"), F.xxhash64("text_hash"), rows).toArrow()
    order = np.lexsort((train.column("text_hash").to_numpy(), train.column("doc_id").to_numpy()))
    train = train.take(order).combine_chunks()
    y = train.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        empty = {v: View(v, (0.0,) * n, 0.0) for v, n in _LISTS.items()}
        return Model(empty["c"], empty["m"], (math.log(share / (1 - share)), 0.0, 0.0))
    batch = train.to_batches()[0]
    x = {v: _lists(batch, v) for v in "cm"}
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 3 for d in train.column("doc_id").to_pylist()])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    learners = {v: Learner.start(x[v][~held], y[~held]) for v in "cm"}
    if rounds:
        free = staged(feats.join(named.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["text_hash"]).select("c", "m"))
    prior = math.log(y[~held].sum() / (1 - y[~held]).sum())
    for _ in range(rounds):
        givers = {v: x_.view(v) for v, x_ in learners.items()}
        before = {v: x_.beta for v, x_ in learners.items()}
        for _ in range(STEPS):
            handed = _handed(free, givers, learners, prior)
            for v, (grad, hess, n) in handed.items():
                learners[v].step(grad, hess, min(1.0, HANDED * len(learners[v].y) / max(n, 1)))
        if held.any() and not _gained(learners, before, {v: x[v][held] for v in "cm"}, y[held]):
            break
    made = {v: x_.view(v) for v, x_ in learners.items()}
    train = x
    cal = held if held.any() else np.ones(len(y), bool)
    z = np.stack([np.clip(made[v].of(train[v][cal]), -30, 30) for v in "cm"], 1)
    w, b = _fit(z, y[cal], pull=0.1)
    if (w < 0).any():  # a view that only misleads counts for nothing
        good = w >= 0
        w = np.where(good, w, 0.0)
        if good.any():
            part, b = _fit(z[:, good], y[cal], pull=0.1)
            w[good] = np.maximum(part, 0)
    return Model(made["c"], made["m"], (b, float(w[0]), float(w[1])))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, score (probability of good quality), content_score, metadata_score, kept.

    Null and empty texts, null metadata and null ids are scored like any other row; repeated rows stay; columns
    other than doc_id, text, lang, source, n_chars are ignored; an empty table gives no row.
    """
    feats = staged(features(docs))
    model = fit(feats, labels)
    one = lambda v: 1 / (1 + F.exp(-F.least(F.greatest(v.logit(), F.lit(-30.0)), F.lit(30.0))))
    out = feats.select("doc_id", model.probability().alias("score"), one(model.content).alias("content_score"), one(model.metadata).alias("metadata_score"))
    return out.withColumn("kept", F.col("score") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected; each row is judged by itself, whatever its id."""
    feats = staged(features(docs, carry=True))
    model = fit(feats, labels)
    good = feats.where(model.probability() >= THRESHOLD)
    return good.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdicts for all ``documents``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_cotraining": op2}
SQL: dict[str, str] = {}
