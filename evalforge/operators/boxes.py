"""k-d boxes over vectors in which more is better: which parts of two tables have to meet, and what they do then.

A table of distinct vectors is cut into cells by a k-d tree whose splits come from a
bounded sample by hash (they decide how even the cells are, never a result).  The driver
sees a box, a count and a number or two for each cell, tells from the boxes which pairs of
cells can matter, and only these meet, in tasks of bounded size.  Within a task the same
is done again with boxes of ``LEAF`` rows.

Of the two sides of a split, the upper one comes first, and values differ strictly; so no
vector is dominated by one of a later cell, and cells in order can be ranked one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut

#: Rows of the smallest boxes within a task, of a cell at most and at least, and of the sample that splits are taken from.
LEAF, CELL, LEAST_CELL, SAMPLE = 64, 50_000, 2_000, 100_000
#: Rows of the points that one task meets at a time.
HELD = 500_000


def _halves(v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float] | None:
    """Rows at or above a middle value of the widest dimension that has two values, and those below; None if all are equal."""
    x = v[rows]
    low, high = x.min(0), x.max(0)
    for c in np.argsort(-(high - low), kind="stable").tolist():
        if not high[c] > low[c]:
            return None
        y = x[:, c]
        edge = np.partition(y, len(y) // 2)[len(y) // 2]
        if edge == low[c]:
            edge = y[y > edge].min()
        up = y >= edge
        return rows[up], rows[~up], c, float(edge)
    return None


@dataclass(frozen=True)
class Boxes:
    """Rows of ``v`` in the order of their boxes; box i has rows order[start[i]:start[i + 1]] and lies between low[i] and high[i]."""

    v: np.ndarray
    order: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, leaf: int = LEAF) -> Boxes:
        order, start, stack = [], [0], [np.arange(len(v))] if len(v) else []
        while stack:
            rows = stack.pop()
            halves = _halves(v, rows) if len(rows) > leaf else None
            if halves:
                stack += [halves[1], halves[0]]  # the upper half comes first
            else:
                order.append(rows)
                start.append(start[-1] + len(rows))
        every = np.concatenate(order) if order else np.zeros(0, np.int64)
        edges = np.array(start[:-1], np.int64)
        x = v[every]
        none = np.empty((0, v.shape[1]))
        return cls(v, every, np.array(start, np.int64), np.minimum.reduceat(x, edges) if len(x) else none, np.maximum.reduceat(x, edges) if len(x) else none)

    def rows(self, i: int) -> np.ndarray:
        return self.order[self.start[i] : self.start[i + 1]]

    def gathered(self, boxes: np.ndarray) -> np.ndarray:
        """Rows of several boxes."""
        return np.concatenate([self.rows(i) for i in boxes.tolist()]) if len(boxes) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start) - 1


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: whether row i of ``a`` is at least as good as row j of ``b`` in all columns."""
    out = np.ones((len(a), len(b)), bool)
    for c in range(a.shape[1]):
        out &= a[:, c, None] >= b[None, :, c]
    return out


def beats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: whether row i of ``a`` dominates row j of ``b``."""
    more = np.zeros((len(a), len(b)), bool)
    for c in range(a.shape[1]):
        more |= a[:, c, None] > b[None, :, c]
    return over(a, b) & more


def counted(q: np.ndarray, p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q``, the weight of the rows of ``p`` that dominate it, and of those that it dominates."""
    above, below = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    a, b = Boxes.of(q), Boxes.of(p)
    total = np.array([weight[b.rows(i)].sum() for i in range(len(b))], np.int64)
    for i in range(len(a)):
        rows, low, high = a.rows(i), a.low[i], a.high[i]
        all_up = (b.low >= high).all(1) & (b.low > high).any(1)
        all_down = (low >= b.high).all(1) & (low > b.high).any(1)
        above[rows] += total[all_up].sum()
        below[rows] += total[all_down].sum()
        some = b.gathered(np.flatnonzero(((b.high >= low).all(1) & ~all_up) | ((high >= b.low).all(1) & ~all_down)))
        some_up = some[(p[some] >= low).all(1) & ~_of(b, all_up)[some]]
        some_down = some[(high >= p[some]).all(1) & ~_of(b, all_down)[some]]
        above[rows] += weight[some_up] @ beats(p[some_up], q[rows]) if len(some_up) else 0
        below[rows] += beats(q[rows], p[some_down]) @ weight[some_down] if len(some_down) else 0
    return above, below


def _of(b: Boxes, boxes: np.ndarray) -> np.ndarray:
    """For each row whether its box is one of those flagged."""
    out = np.zeros(len(b.order), bool)
    out[b.order] = np.repeat(boxes, np.diff(b.start))
    return out


def beaten(q: np.ndarray, p: np.ndarray, strictly: bool) -> np.ndarray:
    """For each row of ``q``, whether a row of ``p`` dominates it, or weakly does."""
    out = np.zeros(len(q), bool)
    a, b = Boxes.of(q), Boxes.of(p)
    for i in range(len(a)):
        rows, low, high = a.rows(i), a.low[i], a.high[i]
        sure = (b.low >= high).all(1)
        if (sure & (b.low > high).any(1)).any() or (not strictly and sure.any()):
            out[rows] = True
            continue
        near = np.flatnonzero((b.high >= low).all(1))
        for at in range(0, len(near), 32):
            some = b.gathered(near[at : at + 32])
            some = some[(p[some] >= low).all(1)]
            left = rows[~out[rows]]
            out[left] = (beats if strictly else over)(p[some], q[left]).any(0)
            if out[rows].all():
                break
    return out


def least(q: np.ndarray, p: np.ndarray, bound: Callable, exact: Callable) -> np.ndarray:
    """For each row of ``q`` the least ``exact`` value over the rows of ``p``; ``bound`` never exceeds it between two boxes."""
    out = np.full(len(q), np.inf)
    a, b = Boxes.of(q), Boxes.of(p)
    for i in range(len(a)):
        rows = a.rows(i)
        floor = bound(a.low[i], a.high[i], b.low, b.high)
        order = np.argsort(floor, kind="stable")
        for at in range(0, len(order), 4):
            near = order[at : at + 4]
            if floor[near[0]] >= out[rows].max():
                break
            out[rows] = np.minimum(out[rows], exact(q[rows], p[b.gathered(near)]).min(1))
    return out


def shift(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrix: by how much row j of ``p`` must be raised to dominate row i of ``q`` weakly."""
    out = np.full((len(q), len(p)), -np.inf)
    for c in range(q.shape[1]):
        np.maximum(out, q[:, c, None] - p[None, :, c], out=out)
    return out


def shift_bound(low, high, p_low, p_high) -> np.ndarray:
    """Least shift between boxes."""
    return (low - p_high).max(-1)


def distance(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrix of Euclidean distances."""
    out = np.zeros((len(q), len(p)))
    for c in range(q.shape[1]):
        out += (q[:, c, None] - p[None, :, c]) ** 2
    return np.sqrt(out)


def distance_bound(low, high, p_low, p_high) -> np.ndarray:
    """Least distance between boxes, a little less for rounding."""
    gap = np.maximum(np.maximum(p_low - high, low - p_high), 0.0)
    return np.sqrt((gap**2).sum(-1)) * (1 - 1e-12)


def floors(q: np.ndarray, p: np.ndarray, rank: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """``floor`` raised to one more than the rank of every row of ``p`` that dominates the row of ``q``."""
    out, a, b = floor.copy(), Boxes.of(q), Boxes.of(p)
    top = np.array([rank[b.rows(i)].max() for i in range(len(b))], np.int64)
    for i in range(len(a)):
        _raise(out, q, a.rows(i), a.low[i], a.high[i], b, top, rank, len(b))
    return out


def _raise(out, q, rows, low, high, b: Boxes, top, rank, n: int) -> None:
    """Raises ``out`` of ``rows`` by the first ``n`` boxes, those of the highest ranks first."""
    if not n:
        return
    all_ = (b.low[:n] >= high).all(1) & (b.low[:n] > high).any(1)
    if all_.any():
        out[rows] = np.maximum(out[rows], top[:n][all_].max() + 1)
    near = np.flatnonzero((b.high[:n] >= low).all(1) & ~all_ & (top[:n] + 1 > out[rows].min()))
    near = near[np.argsort(-top[near], kind="stable")]
    for at in range(0, len(near), 8):
        some = near[at : at + 8]
        if top[some[0]] + 1 <= out[rows].min():
            break
        r = b.gathered(some)
        r = r[(b.v[r] >= low).all(1)]
        if len(r):
            out[rows] = np.maximum(out[rows], np.where(beats(b.v[r], q[rows]), rank[r, None] + 1, 0).max(0))


def ranked(v: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
    """Ranks of distinct vectors: one more than the highest rank that dominates a row, ``floor`` or 0 at least.

    Boxes come one after the other, so what dominates a row is ranked before it.
    """
    rank = np.zeros(len(v), np.int64) if floor is None else floor.astype(np.int64).copy()
    b = Boxes.of(v)
    top = np.zeros(len(b), np.int64)
    for i in range(len(b)):
        rows = b.rows(i)
        _raise(rank, v, rows, b.low[i], b.high[i], b, top, rank, i)
        rows = rows[np.lexsort(tuple(-v[rows, c] for c in range(v.shape[1] - 1, -1, -1)))]
        over_ = beats(v[rows], v[rows])
        r = rank[rows]
        for j in range(1, len(rows)):
            by = r[:j][over_[:j, j]]
            if len(by):
                r[j] = max(r[j], by.max() + 1)
        rank[rows] = r
        top[i] = r.max()
    return rank


@dataclass
class Cells:
    """A table with ``vid`` and ``cell``, and the boxes of its cells in order: counts, lower and upper corners."""

    rows: DataFrame
    cols: list[str]
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Splits: dimension (-1: a leaf), value, and the places of the upper and the lower side; leaves have their cell as upper.
    tree: list[tuple[int, float, int, int]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.n)


def _tree(v: np.ndarray, rows: int) -> list[tuple[int, float, int, int]]:
    """Splits of a sample down to ``rows`` rows or fewer; cells are numbered from the upper side on."""
    out: list[tuple[int, float, int, int]] = []
    cells = 0

    def grow(part: np.ndarray) -> int:
        nonlocal cells
        me = len(out)
        out.append((-1, 0.0, 0, 0))
        halves = _halves(v, part) if len(part) > rows else None
        if halves:
            up = grow(halves[0])
            out[me] = (halves[2], halves[3], up, grow(halves[1]))
        else:
            out[me] = (-1, 0.0, cells, 0)
            cells += 1
        return me

    grow(np.arange(len(v)))
    return out


def _placed(v: np.ndarray, tree) -> np.ndarray:
    dim, edge, up, down = (np.array(x) for x in zip(*tree, strict=True))
    at = np.zeros(len(v), np.int64)
    while True:
        inner = np.flatnonzero(dim[at] >= 0)
        if not len(inner):
            return up[at]
        here = at[inner]
        at[inner] = np.where(v[inner, dim[here]] >= edge[here], up[here], down[here])


def matrix(t: pa.Table | pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """The rows' vectors."""
    return np.stack([t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in cols], 1).astype(float) if t.num_rows else np.empty((0, len(cols)))


def cells(distinct: DataFrame, cols: list[str], rows: int | None = None) -> Cells:
    """Cells of a table whose rows have distinct vectors without nulls; other columns go along.  The table is written once."""
    kept = cut(distinct.withColumn("vid", F.monotonically_increasing_id()))
    n = kept.count()
    wanted = rows or min(CELL, max(LEAST_CELL, -(-n // (4 * kept.sparkSession.sparkContext.defaultParallelism))))
    tree = [(-1, 0.0, 0, 0)]
    if n > wanted:
        some = kept if n <= SAMPLE else kept.where(F.pmod(F.xxhash64(*cols), F.lit(n)) < SAMPLE)
        sample = matrix(some.select(*[F.col(c).cast("double").alias(c) for c in cols]).toArrow(), cols)  # SAMPLE rows or so
        tree = _tree(sample, max(int(wanted * len(sample) / n), 1))

    def step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_placed(matrix(b, cols), tree).astype(np.int32))], [*b.schema.names, "cell"])

    placed = cut(kept.mapInArrow(step, T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType())])))
    got = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{s}{i}") for i, c in enumerate(cols) for s, f in (("l", F.min), ("h", F.max))]).collect()}
    many = max(got, default=-1) + 1
    size = np.array([got[i].n if i in got else 0 for i in range(many)], np.int64)
    corner = lambda s, empty: np.array([[got[i][f"{s}{j}"] if i in got else empty for j in range(len(cols))] for i in range(many)], float).reshape(many, len(cols))
    return Cells(placed, cols, size, corner("l", np.inf), corner("h", -np.inf), tree)


def meet(queries: DataFrame, points: DataFrame, pairs: Iterable[tuple[int, int]], sizes: np.ndarray, step: Callable, schema: str) -> DataFrame:
    """``step`` (query rows, point rows) for the pairs (cell of queries, cell of points), as Arrow tables.

    A cell of queries meets its cells of points in slots of HELD rows or so, each a task's group; ``sizes`` has the
    rows of the cells of points.
    """
    spark, placed, used = queries.sparkSession, [], {}
    for q, p in sorted(pairs):
        slot, held = used.get(q, (0, 0))
        if held and held + sizes[p] > HELD:
            slot, held = slot + 1, 0
        used[q] = slot, held + int(sizes[p])
        placed.append((int(q), int(p), slot))
    if not placed:
        return spark.createDataFrame([], schema)
    q = spark.createDataFrame(sorted({(a, s) for a, _, s in placed}), "cell int, slot int")
    p = spark.createDataFrame(placed, "to int, cell int, slot int")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both may be the same table
    left = fresh(queries).join(q, "cell")
    right = fresh(points).join(p, "cell").drop("cell").withColumnRenamed("to", "cell")
    return left.groupBy("cell", "slot").cogroup(right.groupBy("cell", "slot")).applyInArrow(step, schema)
