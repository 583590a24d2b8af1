"""Archive-conditioned search with a journal: whatever kills it, it resumes to the same tables.

A batch is a chain of tables under ``path``, each written once: proposals, evaluations,
then decisions and archive states of the admission fold.  What a later step needs is read
from what the step before wrote, so a step that is there is never done again, and one
that was cut short is.  A batch counts once its entry in the journal is written, which
names every table's rows and digest.  Resuming joins all ledgers of all batches and refuses
a folder in which they don't fit together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ledger
from ..streaming import admission
from . import checks, pareto, search

TABLES = ("proposals", "evaluations", "decisions", "states")
#: The run id of a campaign's archive.
RUN = "campaign"


class CampaignError(ledger.LedgerError):
    """The tables of a campaign don't fit together, or are another one's."""


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows: sums of two hashes of each row's JSON."""
    row = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if t in ("bigint", "int") else F.col(c) for c, t in sorted(df.dtypes)]), {"ignoreNullFields": "false"})
    h = F.xxhash64(row).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(h).alias("a"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
    return r.n, hashlib.sha256(f"{r.n}|{r.a}|{r.b}".encode()).hexdigest()


@dataclass
class Campaign:
    """Rounds of proposals for the weakest objective of a least crowded archive entry, within a budget.

    ``propose``: (parent or None, direction, batch) -> (draw long, candidate_id, content_hash, ..); of its rows the
    first ``count`` by draw are taken.  ``score``: proposals -> (candidate_id, cost, reasons array, v1..), one row for
    each.  The archive is ``operators.archive.Archive`` with ``capacity`` and ``budget``; an evaluation that the budget
    doesn't allow is refused there.  ``identity`` names what the campaign is; another one's folder is an error.
    """

    spark: SparkSession
    path: str
    identity: str
    propose: Callable[[str | None, str, int], DataFrame]
    score: Callable[[DataFrame], DataFrame]
    directions: list[str]
    capacity: int
    budget: int
    count: int
    seed: int = 0
    batch: int = 0

    def __post_init__(self):
        self.resume()

    def _at(self, name: str, batch: int | None = None) -> str:
        return f"{self.path}/{name}" if batch is None else f"{self.path}/{name}/batch={batch}"

    def _done(self, name: str, batch: int) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(name, batch)}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this batch; made and written only if it isn't there in whole."""
        if not self._done(name, self.batch):
            make().write.mode("overwrite").parquet(self._at(name, self.batch))
        return self.spark.read.parquet(self._at(name, self.batch))

    def table(self, name: str) -> DataFrame:
        """A ledger of all committed batches, with ``batch``."""
        own = [self.spark.read.parquet(self._at(name, b)).withColumn("batch", F.lit(b).cast("long")) for b in range(self.batch)]
        if not own:
            raise CampaignError("no batch is committed")
        out = own[0]
        for t in own[1:]:
            out = out.unionByName(t)
        return out

    def _state(self) -> dict | None:
        """The archive's state after the last batch; one row."""
        if not self.batch:
            return None
        return json.loads(self.spark.read.parquet(self._at("states", self.batch - 1)).first().state)

    def spent(self) -> int:
        """What the archive has recorded as spent."""
        s = self._state()
        return s["spent"] if s else 0

    def aim(self) -> tuple[str | None, str]:
        """(parent, direction) of the next batch: of the entries that the archive holds; the first direction before there are any."""
        s = self._state()
        held = {k: v for k, v in s["members"].items() if k in s["held"]} if s else {}
        if not held:
            return None, self.directions[0]
        dims = len(next(iter(held.values())))
        entries = self.spark.createDataFrame([(k, *v) for k, v in sorted(held.items())], ", ".join(["candidate_id string", *[f"v{i + 1} double" for i in range(dims)]]))  # ``capacity`` rows at most
        return search.condition(entries, self.directions, self.seed + self.batch)

    def step(self) -> DataFrame:
        """One batch; returns its decisions."""
        parent, direction = self.aim()
        aimed = lambda df: df.withColumns({"parent": F.lit(parent).cast("string"), "direction": F.lit(direction)})
        asked = self._once("proposals", lambda: aimed(self.propose(parent, direction, self.batch).orderBy("draw", "candidate_id").limit(self.count)))
        got = self._once("evaluations", lambda: asked.select("draw", "candidate_id", "content_hash").join(self.score(asked).drop("draw", "content_hash"), "candidate_id"))
        before = self.spark.read.parquet(self._at("states", self.batch - 1)) if self.batch else None

        def decided() -> tuple[DataFrame, DataFrame]:
            pos = F.col("draw") + self.batch * (1 << 32)  # draws of a batch come after those of the batches before
            return admission.advance(before, got.select(F.lit(RUN).alias("run_id"), pos.alias("pos"), "candidate_id", "content_hash", "cost", "reasons", *pareto.dims(got)), self.capacity, self.budget)

        out = self._once("decisions", lambda: decided()[0])
        self._once("states", lambda: decided()[1])  # the fold gives the same again
        self._commit()
        return out

    def _commit(self) -> None:
        found = {n: table_digest(self.spark.read.parquet(self._at(n, self.batch))) for n in TABLES}
        problem = self._misfit(self.batch)
        if problem:
            raise CampaignError(f"batch {self.batch}: {problem}")
        entry = {"identity": self.identity, "batch": self.batch, "tables": {n: list(v) for n, v in found.items()}}
        ledger.write_json(self.spark, entry, f"{self._at('journal')}/{self.batch}.json")
        self.batch += 1

    def run(self, batches: int) -> None:
        """Goes on until so many batches are committed, or nothing is left of the budget."""
        while self.batch < batches and self.spent() < self.budget:
            self.step()

    def _journal(self) -> dict[int, dict]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._at("journal"))
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return {int(n.removesuffix(".json")): json.loads(self.spark.read.text(f"{self._at('journal')}/{n}", wholetext=True).first()[0]) for n in names if n.removesuffix(".json").isdigit()}

    def _misfit(self, batch: int) -> str | None:
        """What doesn't fit together in a batch's tables, if anything: evaluations are those of the proposals, decisions those of the evaluations."""
        p, e, d = (self.spark.read.parquet(self._at(n, batch)) for n in TABLES[:3])
        for name, a, b in (("evaluations", p, e), ("decisions", e, d)):
            if not checks.difference(a, b, ["candidate_id"]).isEmpty() or not checks.duplicates(b, ["candidate_id"]).isEmpty():
                return f"the {name} aren't those that were asked for"
        return None

    def resume(self) -> int:
        """Checks all committed batches and goes on after the last; returns the next batch's number.

        Refused: a gap in the journal, another identity, tables that lack rows or differ from their digest, ledgers
        that don't join, a candidate in two batches, costs that aren't what the archive has spent, and tables of
        batches beyond the next one.
        """
        journal = self._journal()
        if sorted(journal) != list(range(len(journal))):
            raise CampaignError("the journal has a gap")
        for b, entry in sorted(journal.items()):
            if entry["identity"] != self.identity or entry["batch"] != b:
                raise CampaignError("the journal is another campaign's")
            for n in TABLES:
                if not self._done(n, b) or list(table_digest(self.spark.read.parquet(self._at(n, b)))) != entry["tables"][n]:
                    raise CampaignError(f"batch {b}: {n} aren't what the journal says")
            if problem := self._misfit(b):
                raise CampaignError(f"batch {b}: {problem}")
        self.batch = len(journal)
        if any(self._done(n, self.batch + 1) for n in TABLES):
            raise CampaignError("there are tables of batches that the journal doesn't know")
        if self.batch:
            ledger.require_none(checks.duplicates(self.table("evaluations").join(self.table("decisions").where("reason not in ('duplicate_candidate_id', 'evaluation_budget_exceeded', 'duplicate_content_hash')").select("candidate_id", "batch"), ["candidate_id", "batch"], "left_semi"), ["candidate_id"]), "candidates were recorded twice")
            paid = self.table("decisions").where("reason not in ('duplicate_candidate_id', 'duplicate_content_hash', 'evaluation_budget_exceeded', 'out_of_order')").join(self.table("evaluations").select("batch", "candidate_id", "cost"), ["batch", "candidate_id"]).agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
            if paid != self.spent():
                raise CampaignError(f"recorded evaluations cost {paid}, the archive has spent {self.spent()}")
        return self.batch
