"""Ordered admission as keyed state: a run's archive goes on where it stopped, without a fold over its history.

Two forms of the same fold (``operators.archive.Archive``).  ``admissions`` is a stream:
``transformWithState`` keeps each run's front, members and spending as one value, and the ids
and contents that it has seen as maps, so an arrival reads what it needs and no more.
``advance`` is a batch: it takes the states after some arrivals and the arrivals since, and
gives the decisions and the states after them, one snapshot following another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.durable import cut
from ..operators import pareto
from ..operators.archive import Archive

DECISION = "run_id string, pos long, candidate_id string, accepted boolean, reason string, removed_ids string, spent long"
#: State store that keeps keyed state out of the heap; what ``transformWithState`` needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Why an arrival that isn't after the last one of its run has no part in it.
LATE = "out_of_order"


def dump(a: Archive, last: int | None, seen: bool = True) -> str:
    """An archive's state as JSON; with ``seen``, the ids and contents as well.  Numbers come back as they were."""
    out = {"spent": a.spent, "held": sorted(a.held), "rivals": a.front.rivals.tolist(), "members": {k: v.tolist() for k, v in sorted(a.front.members.items())}, "last": last}
    return json.dumps(out | ({"ids": sorted(a.ids), "contents": sorted(a.contents)} if seen else {}))


def restored(text: str | None, capacity: int, budget: int, dims: int) -> tuple[Archive, int | None]:
    """The archive of a state, and the place of its last arrival; a new archive without one."""
    a = Archive(capacity, budget, dims)
    if text is None:
        return a, None
    s = json.loads(text)
    if any(len(v) != dims for v in [*s["rivals"], *s["members"].values()]):
        raise ValueError("the state has vectors of another length")
    a.spent, a.held = s["spent"], set(s["held"])
    a.front.rivals = np.array(s["rivals"], float).reshape(-1, dims)
    a.front.members = {k: np.array(v, float) for k, v in s["members"].items()}
    a.ids, a.contents = set(s.get("ids", ())), set(s.get("contents", ()))
    return a, s["last"]


def _fold(a: Archive, last: int | None, rows: pd.DataFrame, cols: list[str]) -> tuple[list[tuple], int | None]:
    """Decisions of arrivals in the order of their places, and the last place; one at or before the last is late."""
    out = []
    for r in rows.sort_values(["pos", "candidate_id"], kind="stable").to_dict("records"):
        if last is not None and r["pos"] <= last:
            ok, reason, gone = False, LATE, []
        else:
            ok, reason, gone = a.arrive(r["candidate_id"], r["content_hash"], int(r["cost"]), tuple(r[c] for c in cols), tuple(r["reasons"]))
            last = int(r["pos"])
        out.append((r["run_id"], int(r["pos"]), r["candidate_id"], ok, reason, ",".join(gone), a.spent))
    return out, last


def _entries(df: DataFrame) -> DataFrame:
    return df.select(F.col("run_id").cast("string").alias("run_id"), F.col("pos").cast("long").alias("pos"), "candidate_id", "content_hash", "cost", "reasons", *pareto.dims(df))


_NAMES = [x.split()[0] for x in DECISION.split(", ")]


class _Seen:
    """A set over keyed state: membership reads one key, and nothing is listed."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, key: str) -> bool:
        return self.state.containsKey((key,))

    def add(self, key: str) -> None:
        self.state.updateValue((key,), (True,))


class Admission(StatefulProcessor):
    """Folds a run's arrivals into its state."""

    def __init__(self, capacity: int, budget: int, cols: list[str]):
        self.capacity, self.budget, self.cols = capacity, budget, cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.archive = handle.getValueState("archive", "state string")
        self.ids = handle.getMapState("ids", "key string", "seen boolean")
        self.contents = handle.getMapState("contents", "key string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        held = list(rows)
        if not held:
            return
        a, last = restored(self.archive.get()[0] if self.archive.exists() else None, self.capacity, self.budget, len(self.cols))
        a.ids, a.contents = _Seen(self.ids), _Seen(self.contents)
        out, last = _fold(a, last, pd.concat(held), self.cols)
        self.archive.update((dump(a, last, seen=False),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def admissions(entries: DataFrame, capacity: int, budget: int) -> DataFrame:
    """A stream of decisions on a stream of (run_id, pos, candidate_id, content_hash, cost, reasons array, v1..).

    A run's arrivals in one batch go by place; those of a later batch with a place at or before one that is decided
    are late, not admitted, and change nothing.  The session must use ``STORE`` as its state store.
    """
    return _entries(entries).groupBy("run_id").transformWithStateInPandas(statefulProcessor=Admission(capacity, budget, pareto.dims(entries)), outputStructType=DECISION, outputMode="Append", timeMode="None")


def use_store(spark: SparkSession) -> None:
    """Sets the state store that ``admissions`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def advance(states: DataFrame | None, entries: DataFrame, capacity: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, states) after ``entries`` on top of ``states`` (run_id, state), or of nothing.

    Runs without new arrivals keep their state.  A run is one task, over its new arrivals alone; both results come from
    one checkpoint, so they belong together whatever is lost.
    """
    cols = pareto.dims(entries)
    before = entries.sparkSession.createDataFrame([], "run_id string, state string") if states is None else states.select("run_id", "state")

    def fold(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        text = old["state"].iloc[0] if len(old) else None
        a, last = restored(text, capacity, budget, len(cols))
        out, last = _fold(a, last, new, cols) if len(new) else ([], last)
        run = (old if len(old) else new)["run_id"].iloc[0]
        done = pd.DataFrame(out, columns=_NAMES).assign(state=None)
        return pd.concat([done, pd.DataFrame([(run, dump(a, last))], columns=["run_id", "state"])])[[*_NAMES, "state"]].astype(object).replace({np.nan: None})

    both = cut(before.groupBy("run_id").cogroup(_entries(entries).groupBy("run_id")).applyInPandas(fold, f"{DECISION}, state string"))
    return both.where("state is null").drop("state"), both.where("state is not null").select("run_id", "state")
