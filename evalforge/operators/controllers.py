"""Search controllers and the loop that drives them.

A controller asks for subsets of patches and is told their scores; its whole state is a
small JSON value.  Proposals come from hashed draws (``search``), ranks and crowding from
the skyline operators.  The loop writes each batch's feedback as a table and then the
controller's state as the batch's commit marker, so a run goes on from its last whole
batch after any failure.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..functions.durable import cut
from . import dedup, pareto, search, selection

Subset = tuple[str, ...]


class SearchError(ValueError):
    """A controller or its run was used against the rules."""


@dataclass(frozen=True)
class Scored:
    """Feedback on one subset; ``vector`` is turned so that more is better."""

    subset: Subset
    candidate_id: str
    content_hash: str
    vector: tuple[float, ...]
    cost: int = 1
    valid: bool = True


class Controller(Protocol):
    """What a search needs of a strategy."""

    def ask(self, count: int) -> list[Subset]: ...

    def tell(self, scored: Iterable[Scored]) -> None: ...

    def state(self) -> dict: ...


class Adapter(Protocol):
    """An optimiser from outside: proposes subsets from what was observed."""

    def propose(self, observed: list[Scored], count: int) -> list[Subset]: ...


def matched(pending: list[Subset], scored: Iterable[Scored]) -> list[Scored]:
    """Scores in the order in which they were asked for; anything but exactly the pending batch is an error."""
    by: dict[Subset, Scored] = {}
    for s in scored:
        if s.subset in by or s.candidate_id in {x.candidate_id for x in by.values()}:
            raise SearchError(f"{s.subset} or {s.candidate_id} is scored twice")
        by[s.subset] = s
    if set(by) != set(pending):
        raise SearchError("the scores aren't those of the pending batch")
    return [by[p] for p in pending]


@dataclass
class CommonOrder:
    """A frozen order of subsets that several strategies measure; each reads it at its own cursor."""

    subsets: list[Subset]
    cursor: int = 0

    @classmethod
    def drawn(cls, ids: list[str], count: int, inclusion: float, seed: int) -> CommonOrder:
        """The first ``count`` unique draws of a stream."""
        return cls(search.SubsetStream(ids, inclusion, seed).ask(count))

    def ask(self, count: int) -> list[Subset]:
        """The next subsets; fewer are an error."""
        if count > len(self.subsets) - self.cursor:
            raise SearchError(f"{len(self.subsets) - self.cursor} subsets are left, {count} asked for")
        self.cursor += count
        return self.subsets[self.cursor - count : self.cursor]

    def fork(self, keep_cursor: bool = False) -> CommonOrder:
        """The same order for another strategy."""
        return CommonOrder(self.subsets, self.cursor if keep_cursor else 0)


@dataclass
class _Asked:
    """What all strategies share: one batch at a time, and what has been observed."""

    pending: list[Subset] = field(default_factory=list)
    observed: list[Scored] = field(default_factory=list)

    def ask(self, count: int) -> list[Subset]:
        """The next batch, which ``tell`` must settle first."""
        if self.pending:
            raise SearchError("the pending batch has no scores yet")
        self.pending = self._next(count)
        return self.pending

    def tell(self, scored: Iterable[Scored]) -> None:
        """Takes the scores of the pending batch in."""
        batch = matched(self.pending, scored)
        known = {s.candidate_id for s in self.observed}
        if again := [s.candidate_id for s in batch if s.candidate_id in known]:
            raise SearchError(f"{again} were observed before")
        self._learn(batch)
        self.observed += batch
        self.pending = []

    def _next(self, count: int) -> list[Subset]:
        raise NotImplementedError

    def _learn(self, batch: list[Scored]) -> None:
        pass

    def state(self) -> dict:
        """JSON from which ``restore`` goes on."""
        return {"type": type(self).__name__, **json.loads(json.dumps(asdict(self)))}


def _scored(rows: list[dict]) -> list[Scored]:
    return [Scored(tuple(r["subset"]), r["candidate_id"], r["content_hash"], tuple(r["vector"]), r["cost"], r["valid"]) for r in rows]


@dataclass
class InitialDesign(_Asked):
    """A seeded design of random subsets and nothing after it."""

    order: CommonOrder = field(default_factory=lambda: CommonOrder([]))

    def _next(self, count: int) -> list[Subset]:
        return self.order.ask(count)


@dataclass
class Adapted(_Asked):
    """Proposals of an outside optimiser, held to unseen subsets of the universe."""

    ids: list[str] = field(default_factory=list)
    adapter: Adapter | None = None

    def _next(self, count: int) -> list[Subset]:
        if self.adapter is None:
            raise SearchError("no optimiser is given")
        got = [tuple(sorted(s)) for s in self.adapter.propose(list(self.observed), count)]
        seen = {s.subset for s in self.observed}
        if len(got) != count or len(set(got)) != count or any(not s or set(s) - set(self.ids) or s in seen for s in got):
            raise SearchError("the optimiser must propose new, different, known subsets")
        return got

    def state(self) -> dict:
        return {"type": "Adapted", "ids": self.ids, "pending": [list(s) for s in self.pending], "observed": json.loads(json.dumps([asdict(s) for s in self.observed]))}


@dataclass
class TopK(_Asked):
    """Keeps the most accurate: the first value, ties by content and id."""

    order: CommonOrder = field(default_factory=lambda: CommonOrder([]))
    k: int = 8
    incumbents: list[Scored] = field(default_factory=list)

    def _next(self, count: int) -> list[Subset]:
        return self.order.ask(count)

    def _learn(self, batch: list[Scored]) -> None:
        self.incumbents = sorted([*self.incumbents, *batch], key=lambda s: (-s.vector[0], s.content_hash, s.candidate_id))[: self.k]


@dataclass
class Annealed(_Asked):
    """Annealed acceptance over a common order within a budget of executions, with a ledger of its decisions.

    An invalid proposal costs what it says, else nothing, and is never accepted.
    """

    order: CommonOrder = field(default_factory=lambda: CommonOrder([]))
    seed: int = 0
    budget: int = 0
    cost: int = 1
    reference: tuple[float, ...] = ()
    spent: int = 0
    held: list[Scored] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)

    def _next(self, count: int) -> list[Subset]:
        if count * self.cost > self.budget - self.spent:
            raise SearchError(f"the budget has room for {(self.budget - self.spent) // self.cost} proposals")
        return self.order.ask(count)

    def parent(self, turn: int) -> str | None:
        """The accepted candidate nearest to the ideal under the turn's random weights."""
        if not self.held:
            return None
        w = selection.dirichlet(len(self.reference), self.seed * 1_000_003 + turn)
        far = lambda s: max(a * (1 - v) for a, v in zip(w, s.vector, strict=True))
        return min(self.held, key=lambda s: (far(s), s.candidate_id)).candidate_id

    def _learn(self, batch: list[Scored]) -> None:
        spent, held, log = self.spent, list(self.held), list(self.decisions)
        for s in batch:
            turn = len(log)
            cost = s.cost if s.valid else min(s.cost, self.cost)
            if spent + cost > self.budget:
                raise SearchError("a score costs more than the budget has left")
            parent = self.parent(turn)
            ok = s.valid and search.accept(list(s.vector), [list(x.vector) for x in held], spent, self.budget, self.seed * 1_000_003 + turn, list(self.reference))
            spent += cost
            held += [s] * ok
            log.append({"turn": turn, "candidate_id": s.candidate_id, "parent_id": parent, "accepted": ok, "spent": spent})
        self.spent, self.held, self.decisions = spent, held, log


@dataclass
class Genetic(_Asked):
    """NSGA-II: an initial design, then children of binary tournaments; the best of parents and children survive.

    Children and survivors are found by Spark over the population, which has ``size`` rows.
    """

    ids: list[str] = field(default_factory=list)
    seed: int = 0
    size: int = 20
    generation: int = 0
    population: list[Scored] = field(default_factory=list)
    order: CommonOrder = field(default_factory=lambda: CommonOrder([]))

    def _spark(self) -> SparkSession:
        found = SparkSession.getActiveSession()
        if found is None:
            raise SearchError("no session")
        return found

    def _table(self, rows: list[Scored]) -> DataFrame:
        d = len(rows[0].vector)
        return self._spark().createDataFrame([(s.candidate_id, s.content_hash, list(s.subset), *s.vector) for s in rows], "candidate_id string, content_hash string, subset array<string>, " + ", ".join(f"v{i + 1} double" for i in range(d)))

    def _next(self, count: int) -> list[Subset]:
        if not self.population:
            self.order = CommonOrder.drawn(self.ids, count, 0.5, self.seed)
            return self.order.ask(count)
        seen = {s.subset for s in self.observed}
        out: dict[Subset, None] = {}
        space = (1 << len(self.ids)) - 1 - len(seen)
        if count > space:
            raise SearchError(f"{space} subsets are left, {count} asked for")
        for turn in range(64):
            kids = search.offspring(self._table(self.population), search.patches(self._spark(), self.ids), self.generation * 64 + turn, 4 * count, self.seed)
            for r in kids.orderBy("draw").collect():
                if (s := tuple(r.subset)) not in seen:
                    out.setdefault(s)
            if len(out) >= count:
                return list(out)[:count]
        fill = search.SubsetStream(self.ids, 0.5, self.seed + self.generation + 1, seen=seen | set(out))
        return [*out, *fill.ask(count - len(out))]

    def _learn(self, batch: list[Scored]) -> None:
        pool = {s.candidate_id: s for s in [*self.population, *batch]}
        best = selection.survivors(self._table(list(pool.values())).drop("subset", "content_hash"), self.size).orderBy("place").collect()
        self.population = [pool[r.candidate_id] for r in best]
        self.generation += 1


KINDS = {k.__name__: k for k in (InitialDesign, TopK, Annealed, Genetic, Adapted)}


def restore(state: dict, adapter: Adapter | None = None) -> _Asked:
    """The controller that a state was taken of."""
    s = dict(state)
    kind = KINDS.get(s.pop("type", None))
    if kind is None:
        raise SearchError("no such controller")
    for name in ("observed", "incumbents", "held", "population"):
        if name in s:
            s[name] = _scored(s[name])
    s["pending"] = [tuple(x) for x in s["pending"]]
    if "order" in s:
        s["order"] = CommonOrder([tuple(x) for x in s["order"]["subsets"]], s["order"]["cursor"])
    if "reference" in s:
        s["reference"] = tuple(s["reference"])
    return kind(**s, **({"adapter": adapter} if kind is Adapted else {}))


#: Methods that measure one shared order, so that they can be compared on the same candidates.
SHARED = ("fixed_scalarization", "hard_easy_product", "annealed", "passive_archive", "conditioned_archive")


def static_subsets(method: str, ids: list[str], most: int, seed: int, inclusion: float = 0.5) -> list[Subset]:
    """The proposals of a method that doesn't search: none, all patches, a shared or own random order, or diverse ones."""
    room = min(most, (1 << len(set(ids))) - 1)
    if method in ("no_skill", "base"):
        return []
    if method == "full_merge":
        return [tuple(sorted(set(ids)))]
    if method == "random_composition":
        return search.SubsetStream(sorted(set(ids)), inclusion, seed).ask(room)
    if method in SHARED:
        return CommonOrder.drawn(sorted(set(ids)), room, 0.5, seed).ask(room)
    return search.diverse(ids, room, seed)


def controller(method: str, ids: list[str], seed: int, count: int, budget: int = 0, cost: int = 1, reference: tuple[float, ...] = (), adapter: Adapter | None = None) -> _Asked:
    """The controller of a method that searches."""
    ids = sorted(set(ids))
    if method == "genetic":
        return Genetic(ids=ids, seed=seed, size=count)
    if method == "adapted":
        return Adapted(ids=ids, adapter=adapter)
    order = CommonOrder.drawn(ids, count, 0.5, seed)
    made = {"top_k": lambda: TopK(order=order), "annealed": lambda: Annealed(order=order, seed=seed, budget=budget, cost=cost, reference=reference), "initial_design": lambda: InitialDesign(order=order)}
    if method not in made:
        raise SearchError(f"no controller for {method!r}")
    return made[method]()


def rejected(subset: Subset, reason: str, token_budget: float) -> dict:
    """What stands for a proposal that couldn't be made: the worst values, at no cost, under an id that its cause gives."""
    h = digest({"patch_ids": list(subset), "reason": reason})
    return {"subset": list(subset), "candidate_id": f"invalid-{h[:24]}", "content_hash": h, "accuracy": 0.0, "transfer": 0.0, "token_cost": token_budget + 1.0, "regression": 1.0, "cost": 0, "valid": False, "reason": reason}


def promoted(scored: DataFrame, survivors: DataFrame) -> DataFrame:
    """Scored candidates that the controller kept."""
    return scored.join(survivors.select("candidate_id").distinct(), "candidate_id", "left_semi")


def attempts(requests: DataFrame) -> DataFrame:
    """One failure event for each attempt that fails: (request_fingerprint, attempt_number, retry_limit, will_retry).

    ``requests``: (request_fingerprint, fails, retry_limit): the first ``fails`` attempts fail; there are
    retry_limit + 1 at most.
    """
    n = F.least(F.col("fails"), F.col("retry_limit") + 1)
    rows = requests.where(n > 0).select("request_fingerprint", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("attempt_number"), "retry_limit")
    return rows.withColumn("will_retry", F.col("attempt_number") <= F.col("retry_limit"))


def executed(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """The evaluation matrix with its recorded results, in the order in which it is run; ``problem`` marks what has none."""
    keys = ["candidate_id", "target_id", "task_id", "seed"]
    j = matrix.select(*keys).join(results, keys, "left").withColumn("problem", F.when(F.col("correct").isNull(), "not_run"))
    return j.orderBy("target_id", "task_id", "seed", "candidate_id")


#: Columns of a batch's feedback table.
FEEDBACK = "subset array<string>, candidate_id string, content_hash string, vector array<double>, cost long, valid boolean, reason string"


@dataclass
class SearchRun:
    """Ask, materialise, evaluate, score and tell, with a checkpoint after each batch under ``path``.

    ``materialise``: subset -> (content_hash, reason of a rejection or None); ``score``: (candidate_id, content_hash,
    subset array) -> (candidate_id, v1.., cost).  Contents that were seen before are rejected as repeats.  A run belongs
    to an identity; another one's folder is an error.
    """

    spark: SparkSession
    path: str
    identity: str
    strategy: _Asked
    materialise: Callable[[Subset], tuple[str, str | None]]
    score: Callable[[DataFrame], DataFrame]
    worst: tuple[float, ...]
    token_budget: float = 0.0
    batch: int = 0
    contents: set[str] = field(default_factory=set)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def step(self, count: int) -> DataFrame:
        """One batch; its feedback is written before the state that counts it."""
        asked = self.strategy.ask(count)
        made = [(s, *self.materialise(s)) for s in asked]
        rows = self.spark.createDataFrame([(i, list(s), h, why) for i, (s, h, why) in enumerate(made)], "pos long, subset array<string>, content_hash string, why string")
        known = self.spark.createDataFrame([(h,) for h in sorted(self.contents)] or [("",)], "content_hash string")
        rows = rows.withColumn("candidate_id", F.concat(F.lit("c-"), F.substring(F.sha2(F.concat_ws(",", "subset"), 256), 1, 24)))
        fresh = dedup.content_dedup(rows.where("why is null")).join(known.withColumn("old", F.lit(True)), "content_hash", "left")
        good = fresh.where("accepted and old is null").select("candidate_id", "content_hash", "subset")
        got = self.score(good)
        vector = F.array(*[F.col(c) for c in pareto.dims(got)])
        scored = good.join(got.select("candidate_id", vector.alias("vector"), F.col("cost").cast("long").alias("cost")), "candidate_id").select("subset", "candidate_id", "content_hash", "vector", "cost", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"))
        scored = cut(scored)
        have = {tuple(r.subset) for r in scored.select("subset").collect()}  # a batch
        bad = []
        for s, _, why in made:
            if s not in have:
                x = rejected(s, why or "repeated_content", self.token_budget)
                bad.append((x["subset"], x["candidate_id"], x["content_hash"], list(self.worst), 0, False, x["reason"]))
        feedback = scored.unionByName(self.spark.createDataFrame(bad, FEEDBACK)) if bad else scored
        feedback.write.mode("overwrite").parquet(self._at(f"feedback/batch={self.batch}"))
        feedback = self.spark.read.parquet(self._at(f"feedback/batch={self.batch}"))
        batch = [Scored(tuple(r.subset), r.candidate_id, r.content_hash, tuple(r.vector), r.cost, r.valid) for r in feedback.collect()]
        self.strategy.tell(batch)
        self.contents |= {s.content_hash for s in batch if s.valid}
        self._commit(False)
        return feedback

    def _commit(self, complete: bool) -> None:
        state = json.dumps(self.strategy.state(), sort_keys=True)
        row = (self.identity, self.batch, state, hashlib.sha256(state.encode()).hexdigest(), complete)
        self.spark.createDataFrame([row], "identity string, batch long, state string, sha256 string, complete boolean").coalesce(1).write.mode("overwrite").parquet(self._at(f"state/number={self.batch}"))
        self.batch += 1

    def finish(self) -> None:
        """Marks the run as complete."""
        self._commit(True)

    def _last(self):
        try:
            rows = self.spark.read.parquet(self._at("state"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows.orderBy(F.desc("batch")).first()

    def complete(self) -> bool:
        """Whether a finished run of this identity is stored."""
        last = self._last()
        return bool(last and last.complete and last.identity == self.identity)

    def resume(self, adapter: Adapter | None = None) -> int:
        """Goes on after the last committed batch; returns the next batch's number.

        The stored feedback must be what the controller has observed, in whole: else the folder is damaged.
        """
        last = self._last()
        if last is None:
            return 0
        if last.identity != self.identity or hashlib.sha256(last.state.encode()).hexdigest() != last.sha256:
            raise SearchError("the stored state is of another run, or damaged")
        self.strategy = restore(json.loads(last.state), adapter)
        self.batch = last.batch + 1
        rows = self.feedback().where(F.col("batch") <= last.batch).collect()  # bounded by the budget of a search
        stored = {(tuple(r.subset), r.candidate_id, r.content_hash) for r in rows}
        seen = {(s.subset, s.candidate_id, s.content_hash) for s in self.strategy.observed}
        if stored != seen or len(rows) != len(seen):
            raise SearchError("the stored feedback isn't what the controller has observed")
        self.contents = {r.content_hash for r in rows if r.valid}
        return self.batch

    def feedback(self) -> DataFrame:
        """All batches' feedback."""
        return self.spark.read.parquet(self._at("feedback"))

    def consumed(self) -> DataFrame:
        """(batch, subset) of everything that was asked for."""
        return self.feedback().select("batch", "subset")


def expand(entries: DataFrame, evidence: DataFrame, propose: Callable[[str, str, int], DataFrame], score: Callable[[DataFrame], DataFrame], rounds: int, count: int, seed: int, capacity: int) -> DataFrame:
    """Archive-conditioned search: entries after ``rounds`` of proposals for a parent's weakest objective.

    ``entries``: (run_id, candidate_id, reasons, v1..); ``propose``: (parent, direction, turn) -> proposals;
    ``score``: proposals -> rows like ``entries``.  Each round looks at the bounded archive of all entries so far.
    ``campaign.Campaign`` does the same through the admission fold, with a budget and a journal to resume from.
    """
    from . import archive

    directions = sorted({r.direction for r in search.routed(evidence).select("direction").distinct().collect()})  # four at most
    for turn in range(rounds):
        working = archive.working_entries(entries, capacity)
        parent, direction = search.condition(working.select("candidate_id", *pareto.dims(entries)), directions, seed + turn)
        asked = propose(parent, direction, turn)
        new = score(asked.orderBy(*asked.columns).limit(count))  # the same rows whenever it is run
        entries = cut(entries.unionByName(new.select(*entries.columns)))
    return entries
