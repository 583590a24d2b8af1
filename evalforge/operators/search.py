"""Search over subsets of patches: proposals, incumbents, acceptance and budgets.

Randomness is a hash of (seed, draw, name), so proposals are relational: a draw is a
group of rows, a stream's whole state is the number of its next draw, and any
engine gives the same proposals.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import checks, pareto, selection


def uniform(*key: str | Column) -> Column:
    """In [0, 1): the first 8 hex digits of the md5 of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def patches(spark: SparkSession, ids: list[str]) -> DataFrame:
    """(patch_id) of a universe; ids must be unique."""
    if len(set(ids)) != len(ids) or not all(ids):
        raise ValueError("patch ids must be unique and not empty")
    return spark.createDataFrame([(i,) for i in sorted(ids)], "patch_id string")


def canonical_subsets(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds ``problem`` to (subset array): unknown or repeated ids; ``subset`` is put in the universe's order."""
    all_ids = universe.agg(F.array_sort(F.collect_list("patch_id")).alias("all_ids"))  # one row
    odd = F.when(F.size(F.array_except("subset", "all_ids")) > 0, "unknown_patch").when(F.size(F.array_distinct("subset")) < F.size("subset"), "repeated_patch").when(F.size("subset") == 0, "empty")
    return df.join(F.broadcast(all_ids)).withColumn("problem", odd).withColumn("subset", F.array_intersect("all_ids", "subset")).drop("all_ids")


def bernoulli(universe: DataFrame, first: int, draws: int, inclusion: float, seed: int) -> DataFrame:
    """(draw, subset) of draws first..first+draws-1: each patch is in with this chance; empty draws are left out."""
    spark = universe.sparkSession
    grid = spark.range(first, first + draws).select(F.col("id").alias("draw")).join(universe)
    kept = grid.where(uniform(F.lit(str(seed)), F.col("draw").cast("string"), "patch_id") < inclusion)
    return kept.groupBy("draw").agg(F.array_sort(F.collect_list("patch_id")).alias("subset"))


def unique(proposals: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first draw of each subset that isn't in ``seen`` (subset)."""
    w = Window.partitionBy("subset").orderBy("draw")
    out = proposals.withColumn("turn_", F.row_number().over(w)).where("turn_ = 1").drop("turn_")
    return out if seen is None else out.join(seen.select("subset").distinct(), "subset", "left_anti")


@dataclass
class SubsetStream:
    """A resumable stream of unique non-empty subsets; its state is the seed, the next draw and what it has proposed."""

    ids: list[str]
    inclusion: float
    seed: int
    patience: int = 10_000
    next_draw: int = 0
    seen: set[tuple[str, ...]] = field(default_factory=set)

    def remaining(self) -> int:
        """Subsets that haven't been proposed."""
        return (1 << len(self.ids)) - 1 - len(self.seen)

    def _chance(self, draw: int, patch: str) -> float:
        return int(hashlib.md5(f"{self.seed}|{draw}|{patch}".encode()).hexdigest()[:8], 16) / float(1 << 32)

    def ask(self, count: int) -> list[tuple[str, ...]]:
        """The next subsets; if ``patience`` draws in a row bring nothing new, an error that leaves the stream as it was."""
        if count > self.remaining():
            raise ValueError(f"{self.remaining()} subsets are left, {count} asked for")
        out: list[tuple[str, ...]] = []
        draw, known, idle = self.next_draw, set(self.seen), 0
        while len(out) < count:
            s = tuple(p for p in sorted(self.ids) if self._chance(draw, p) < self.inclusion)
            draw += 1
            if s and s not in known:
                known.add(s)
                out.append(s)
                idle = 0
            else:
                idle += 1
                if idle >= self.patience:
                    raise ValueError("too many draws without a new subset")
        self.next_draw, self.seen = draw, known
        return out

    def state(self) -> str:
        """JSON from which ``restore`` goes on."""
        return json.dumps(asdict(self) | {"seen": sorted(map(list, self.seen))}, sort_keys=True)

    @classmethod
    def restore(cls, state: str) -> SubsetStream:
        """The stream of a state."""
        s = json.loads(state)
        return cls(**(s | {"seen": set(map(tuple, s["seen"]))}))

    def fork(self) -> SubsetStream:
        """An independent copy that goes on from here."""
        return self.restore(self.state())


def diverse(ids: list[str], most: int, seed: int) -> list[tuple[str, ...]]:
    """The whole set, the single patches, then subsets of hash-drawn sizes, by size with the whole set first.

    Draw i has the size that the hash of (seed, i) says, and the patches with the least hashes of (seed, i, patch).
    """
    names = tuple(sorted(set(ids)))
    room = min(most, (1 << len(names)) - 1)
    if room <= 0:
        return []
    key = lambda *x: hashlib.md5("|".join(map(str, (seed, *x))).encode()).hexdigest()
    found = dict.fromkeys([names, *((n,) for n in names)])
    for draw in itertools.count():
        if len(found) >= room:
            break
        size = 1 + int(key(draw)[:8], 16) % len(names)
        found.setdefault(tuple(sorted(sorted(names, key=lambda n: key(draw, n))[:size])))
    fixed, drawn = names, sorted((s for s in found if s != names), key=lambda s: (len(s), s))
    return [fixed, *drawn][:room]


def incumbents(old: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """The ``k`` most accurate of old and new, ties by content and id."""
    pool = batch if old is None else old.select(batch.columns).unionByName(batch)
    return pool.orderBy(F.desc("accuracy"), F.coalesce("content_hash", "candidate_id"), "candidate_id").limit(k)


def offspring(population: DataFrame, universe: DataFrame, generation: int, draws: int, seed: int, crossover: float = 0.9, locus: float = 0.5, mutation: float = 0.1) -> DataFrame:
    """(draw, subset) of ``draws`` children: two binary tournaments each, uniform crossover, bit flips.

    ``population``: (candidate_id, content_hash, subset, v1..).  A tournament compares rank, crowding (boundaries
    first), then content.  Children are rows of (draw, patch), so a generation is a few joins of small tables.
    """
    spark = population.sparkSession
    ranked = pareto.crowding(pareto.ranks(population, "candidate_id"), "candidate_id", ["rank"])
    order = [F.asc("rank"), F.desc("boundary"), F.desc("crowding"), F.asc(F.coalesce("content_hash", "candidate_id"))]
    placed = ranked.select("subset", F.row_number().over(Window.orderBy(*order)).alias("fitness"), (F.row_number().over(Window.orderBy("candidate_id")) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("n"))  # a population is small
    n = placed.select(F.max("n").alias("n"))
    g = [F.lit(str(seed)), F.lit(str(generation)), F.col("draw").cast("string")]
    picks = spark.range(draws).select(F.col("id").alias("draw")).join(n).select("draw", *[F.floor(uniform(*g, F.lit(f"pick{i}")) * F.col("n")).alias(f"p{i}") for i in range(4)])
    sides = picks.select("draw", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.array("p0", "p1").alias("p")), F.struct(F.lit(1).alias("side"), F.array("p2", "p3").alias("p")))).alias("x")).select("draw", "x.side", F.explode("x.p").alias("place"))
    won = sides.join(placed, "place").groupBy("draw", "side").agg(F.min_by("subset", "fitness").alias("parent"))
    two = won.groupBy("draw").agg(F.max(F.when(F.col("side") == 0, F.col("parent"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("parent"))).alias("b"))
    cell = two.join(universe).withColumn("in_a", F.array_contains("a", F.col("patch_id"))).withColumn("in_b", F.array_contains("b", F.col("patch_id")))
    crossed = F.when((uniform(*g, F.lit("cross")) < crossover) & (uniform(*g, F.lit("locus"), "patch_id") >= locus), F.col("in_b")).otherwise(F.col("in_a"))
    flip = uniform(*g, F.lit("flip"), "patch_id") < mutation
    kept = cell.withColumn("has", crossed != flip)
    fallback = F.min_by("patch_id", uniform(*g, F.lit("any"), "patch_id"))
    out = kept.groupBy("draw").agg(F.array_sort(F.collect_list(F.when(F.col("has"), F.col("patch_id")))).alias("s"), fallback.alias("any_"))
    return out.select("draw", F.when(F.size("s") > 0, F.col("s")).otherwise(F.array("any_")).alias("subset"))


def feedback_problems(pending: DataFrame, scored: DataFrame) -> DataFrame:
    """(subset, problem) where the scores aren't exactly the pending batch, each subset once."""
    text = lambda d: d.select(F.array_join("subset", ",").alias("subset"))
    again = checks.duplicates(text(scored), ["subset"]).select("subset", F.lit("repeated").alias("problem"))
    return checks.difference(text(pending), text(scored), ["subset"]).unionByName(again)


def accept(proposal: list[float], held: list[list[float]], spent: int, budget: int, seed: int, reference: list[float], rate: float = 3.0) -> bool:
    """Annealed gate: early on a proposal passes that adds volume, later one that is as near to the ideal as the best held.

    Vectors are normalised to [0, 1], more is better.  The share of volume tests falls as exp(-rate x progress).
    """
    if budget <= 0 or not 0 <= spent <= budget:
        raise ValueError("spent must lie within the budget")
    if not held:
        return True
    pts, ref = np.array([*held, proposal]), np.array(reference)
    gain = pareto.volume(pts, ref) - pareto.volume(pts[:-1], ref)
    w = np.array(selection.dirichlet(len(proposal), seed))
    far = (w * (1 - pts)).max(1)
    gate = random.Random(seed + 1).random()
    return bool(gain > 0 if gate < math.exp(-rate * spent / budget) else far[-1] <= far[:-1].min())


#: Names that route evidence to an objective, compared without case (fixed values).
ALIASES = {"accuracy": ["id_accuracy", "accuracy"], "transfer": ["worst_target_transfer", "transfer"], "cost": ["token_cost", "cost", "compress"], "regression": ["paired_regression", "regression"]}


def routed(evidence: DataFrame) -> DataFrame:
    """Evidence with ``direction``, once for each objective that its tags name."""
    spark = evidence.sparkSession
    names = spark.createDataFrame([(d, a) for d, names in ALIASES.items() for a in names], "direction string, alias string")
    tags = evidence.select("evidence_id", F.explode(F.transform("tags", F.lower)).alias("alias"))
    hit = tags.join(F.broadcast(names), "alias").select("evidence_id", "direction").distinct()
    return evidence.join(hit, "evidence_id")


def condition(entries: DataFrame, directions: list[str], seed: int) -> tuple[str, str]:
    """(candidate_id, direction): a least crowded entry, ties by a seeded pick, and its weakest objective with evidence.

    ``entries``: (candidate_id, v1..v4) of an archive, which is small.
    """
    cols = pareto.dims(entries)
    rows = pareto.crowding(entries, "candidate_id").orderBy(F.desc("boundary"), F.desc("crowding"), "candidate_id").collect()
    if not rows or not directions:
        raise ValueError("an archive entry and evidence are needed")
    best = [r for r in rows if (r.boundary, r.crowding) == (rows[0].boundary, rows[0].crowding)]
    parent = best[random.Random(seed).randrange(len(best))]
    level = {}
    for c, d in zip(cols, ALIASES, strict=False):
        low, high = min(r[c] for r in rows), max(r[c] for r in rows)
        level[d] = 1.0 if high <= low else (parent[c] - low) / (high - low)
    return parent.candidate_id, min(directions, key=lambda d: (level[d], d))


@dataclass
class Budget:
    """Executions that may be spent."""

    limit: int
    spent: int = 0

    def consume(self, n: int) -> None:
        """Spends ``n``, or nothing if they don't fit."""
        if n < 0 or self.spent + n > self.limit:
            raise ValueError(f"{n} executions don't fit: {self.limit - self.spent} are left")
        self.spent += n


def synthetic(requests: DataFrame, key: str = "cache_key", threshold: int = 166) -> DataFrame:
    """Requests with a made-up stable outcome from the key's digest: correct, input_tokens, output_tokens, latency_ms."""
    h = F.sha2(key, 256)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    return requests.withColumns({"correct": byte(0) < threshold, "input_tokens": 24 + byte(1) % 9, "output_tokens": 8 + byte(2) % 13, "latency_ms": (1 + byte(3) % 5).cast("double")})
