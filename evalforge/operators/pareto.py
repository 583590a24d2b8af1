"""Skyline operators and frontier indicators over vectors in which more is better.

Vectors are ``DOUBLE`` columns v1..vd without nulls.  Each partition reduces its rows to
its own skyline (a vectorised block nested loop); the survivors of a group then meet in
one task, those of a table without groups as well if they are few, and else only the
cells of a k-d tree (``boxes``) that can hold rivals of each other.  With a tolerance,
dominance isn't transitive, but a row that another strictly dominates dominates nothing
that the other doesn't, so all rows are compared with the strict skyline alone.

Ranks, dominance counts, coverage, epsilon and the inverted distance work on cells as
well: which cells have to meet follows from their boxes, and ranks go from cell to cell in
waves.  Volumes are sums of exclusive volumes by limit sets, dealt over tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from ..functions.lookup import lookup
from . import boxes

#: Rows that one task merges, or that are broadcast at a time.
MEET = 50_000
#: Points whose exclusive volumes one task computes.
SLICE = 64
#: Rows that are compared at once.
BLOCK = 512


def dims(df: DataFrame) -> list[str]:
    """v1, v2, .. as far as the table has them."""
    out = []
    while f"v{len(out) + 1}" in df.columns:
        out.append(f"v{len(out) + 1}")
    return out


def dominates(a: str, b: str, cols: list[str], tolerance: float = 0.0) -> Column:
    """Whether alias ``a`` is at least as good in all columns and better in one."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    weak = reduce(lambda p, q: p & q, [x(c) + tolerance >= y(c) for c in cols])
    return weak & reduce(lambda p, q: p | q, [x(c) > y(c) + tolerance for c in cols])


def weakly(a: str, b: str, cols: list[str]) -> Column:
    """Whether alias ``a`` is at least as good in all columns."""
    return reduce(lambda p, q: p & q, [F.col(f"{a}.{c}") >= F.col(f"{b}.{c}") for c in cols])


def _beaten(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each row of ``v`` whether a row of ``by`` strictly dominates it."""
    out = np.zeros(len(v), bool)
    for i in range(0, len(v), BLOCK):
        x = v[i : i + BLOCK, None, :]
        left = np.arange(i, min(i + BLOCK, len(v)))
        for j in range(0, len(by), 4 * BLOCK):
            y = by[None, j : j + 4 * BLOCK, :]
            hit = ((y >= x).all(2) & (y > x).any(2)).any(1)
            out[left[hit]] = True
            left, x = left[~hit], x[~hit]
            if not len(left):
                break
    return out


def skyline(v: np.ndarray) -> np.ndarray:
    """Indices of rows that no row strictly dominates; the better come first, so no row that is kept has to go again."""
    order = np.argsort(-v.sum(1), kind="stable")
    kept = np.empty(0, np.int64)
    for i in range(0, len(order), BLOCK):
        part = order[i : i + BLOCK]
        part = part[~_beaten(v[part], v[kept])]
        part = part[~_beaten(v[part], v[part])]
        kept = np.concatenate([kept, part])
    return np.sort(kept)


def local_skyline(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows of each partition that no row of the partition strictly dominates within its group."""
    cols, group = dims(df), group or []

    def step(batches):
        held: dict[tuple, tuple[np.ndarray, pa.Table]] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            v = np.stack([t.column(c).to_numpy() for c in cols], 1)
            of: dict[tuple, list[int]] = {}
            keys = zip(*[t.column(g).to_pylist() for g in group], strict=True) if group else ((),) * len(v)
            for i, k in enumerate(keys):
                of.setdefault(k, []).append(i)
            for k, places in of.items():
                at = np.array(places)
                at = at[skyline(v[at])]
                if k not in held:
                    held[k] = v[at], t.take(at)
                    continue
                old, rows = held[k]
                at = at[~_beaten(v[at], old)]
                stay = np.flatnonzero(~_beaten(old, v[at]))
                held[k] = np.vstack([old[stay], v[at]]), pa.concat_tables([rows.take(stay), t.take(at)])
        for _, rows in held.values():
            yield from rows.combine_chunks().to_batches()

    return df.mapInArrow(step, df.schema)


def strict_front(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows that no row of their group strictly dominates; rows that share a vector all stay."""
    pool = local_skyline(df, group)
    if group:
        return local_skyline(pool.repartition(*group), group)
    pool = cut(pool)
    n = pool.count()
    if n <= MEET:
        return local_skyline(pool.coalesce(1))
    return _apart(pool, dims(df))


def _apart(pool: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of a large table that no row strictly dominates: cells meet those that may hold rivals."""
    c = boxes.cells(pool.select(*cols).distinct(), cols)
    full = np.flatnonzero(c.n > 0)
    gone, pairs = [], []
    for i in full.tolist():
        may = full[(c.high[full] >= c.low[i]).all(1)]
        if ((c.low[may] >= c.high[i]).all(1) & (c.low[may] > c.high[i]).any(1)).any():
            gone.append(i)
        else:
            pairs += [(i, j) for j in may.tolist()]

    def step(q: pa.Table, p: pa.Table) -> pa.Table:
        return pa.table({"vid": q.column("vid").filter(pa.array(boxes.beaten(boxes.matrix(q, cols), boxes.matrix(p, cols), True)))})

    rows = c.rows.where(~F.col("cell").isin(gone)) if gone else c.rows
    out = rows.join(boxes.meet(rows, rows, pairs, c.n, step, "vid long").distinct(), "vid", "left_anti")
    return pool.join(out.select(*cols), cols, "left_semi").select(*pool.columns)


def _undominated(df: DataFrame, by: DataFrame, cols: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows that no row of ``by`` dominates; ``by`` has MEET rows or so, hence the broadcast."""
    return df.alias("own").join(F.broadcast(by.select(*cols)).alias("other"), dominates("other", "own", cols, tolerance), "left_anti")


def front(df: DataFrame, group: list[str] | None = None, tolerance: float = 0.0) -> DataFrame:
    """Rows that no row of their group dominates; rows that share a vector all stay."""
    group, cols = group or [], dims(df)
    strict = strict_front(df, group)
    if tolerance == 0:
        return strict
    if group:
        a, b = strict.select(*group, *cols).distinct().alias("other"), df.alias("own")
        same = [F.col(f"other.{g}").eqNullSafe(F.col(f"own.{g}")) for g in group]
        return b.join(a, reduce(lambda p, q: p & q, [*same, dominates("other", "own", cols, tolerance)]), "left_anti")
    rivals = cut(strict.select(*cols).distinct())
    blocks = max(-(-rivals.count() // MEET), 1)
    for i in range(blocks):
        part = rivals if blocks == 1 else rivals.where(F.pmod(F.xxhash64(*cols), F.lit(blocks)) == i)
        df = _undominated(df, part, cols, tolerance)
    return df


def vectors(df: DataFrame) -> DataFrame:
    """Distinct vectors of the front."""
    return front(df.select(*dims(df)).distinct())


def dominance_counts(df: DataFrame, id_col: str) -> DataFrame:
    """id, dominators, dominated of each row, by counts over the cells of a k-d tree.

    Cells that lie wholly above or below one another add their size; only the others meet.
    """
    cols = dims(df)
    c = boxes.cells(df.groupBy(*cols).agg(F.count("*").alias("n")), cols)
    weight = {r.cell: int(r.w) for r in c.rows.groupBy("cell").agg(F.sum("n").alias("w")).collect()}
    full = np.flatnonzero(c.n > 0)
    w = np.array([weight[i] for i in full.tolist()], np.int64)
    pairs, sums = [], []
    for i in full.tolist():
        low, high = c.low[full], c.high[full]
        up = (low >= c.high[i]).all(1) & (low > c.high[i]).any(1)
        down = (c.low[i] >= high).all(1) & (c.low[i] > high).any(1)
        sums.append((i, int(w[up].sum()), int(w[down].sum())))
        pairs += [(i, j) for j in full[((high >= c.low[i]).all(1) & ~up) | ((c.high[i] >= low).all(1) & ~down)].tolist()]

    def step(q: pa.Table, p: pa.Table) -> pa.Table:
        above, below = boxes.counted(boxes.matrix(q, cols), boxes.matrix(p, cols), p.column("n").to_numpy())
        return pa.table({"vid": q.column("vid"), "dominators": above, "dominated": below})

    met = boxes.meet(c.rows, c.rows, pairs, c.n, step, "vid long, dominators long, dominated long")
    whole = F.broadcast(df.sparkSession.createDataFrame(sums, "cell int, dominators long, dominated long"))  # one row a cell
    far = c.rows.join(whole, "cell").select("vid", "dominators", "dominated")
    total = met.unionByName(far).groupBy("vid").agg(F.sum("dominators").alias("dominators"), F.sum("dominated").alias("dominated"))
    one = c.rows.join(total, "vid").select(*cols, "dominated", "dominators")
    return lookup(df.select(id_col, *cols), one, cols).select(id_col, "dominated", "dominators")


def _peeled(v: np.ndarray) -> np.ndarray:
    """Ranks of vectors that may repeat."""
    one, back = np.unique(v, axis=0, return_inverse=True)
    return boxes.ranked(one)[back.reshape(-1)].astype(np.int32)


def ranks(df: DataFrame, id_col: str, group: list[str] | None = None) -> DataFrame:
    """Adds ``rank``: the front a row belongs to when fronts are peeled off one by one, from 0.

    That is the length of the longest chain of rows that dominate one another and it.  Groups of ``boxes.CELL`` rows
    or fewer are a task each; a larger one, and a larger table without groups, is ranked in waves of cells.
    """
    cols, group = dims(df), group or []
    schema = T.StructType([*df.schema.fields, T.StructField("rank", T.IntegerType())])

    def peel(t: pa.Table) -> pa.Table:
        return t.append_column("rank", pa.array(_peeled(boxes.matrix(t, cols))))

    if not group:
        if df.limit(boxes.LEAST_CELL + 1).count() <= boxes.LEAST_CELL:
            return df.withColumn("pool_", F.lit(0)).groupBy("pool_").applyInArrow(lambda t: peel(t.drop_columns(["pool_"])), schema)
        return lookup(df, _waves(df.select(*cols).distinct(), cols), cols).select(*df.columns, "rank")
    large = df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > boxes.CELL).select(*group).collect()  # rows / CELL at most
    keys = lambda r: reduce(lambda p, q: p & q, [F.col(g).eqNullSafe(F.lit(r[g])) for g in group])
    rest = df.where(reduce(lambda p, q: p & q, [~keys(r) for r in large])) if large else df
    out = rest.groupBy(*group).applyInArrow(peel, schema)
    for r in large:
        out = out.unionByName(ranks(df.where(keys(r)), id_col))
    return out


def _waves(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """(v.., rank) of distinct vectors.

    A cell follows those that may hold a row above one of its own, which all come before it; cells that don't
    follow one another are ranked in one wave.  A cell that lies wholly above another one counts with its highest rank.
    """
    spark, c = distinct.sparkSession, boxes.cells(distinct, cols, boxes.CELL)  # a wave costs more than large cells do
    full = np.flatnonzero(c.n > 0).tolist()
    above, wholly, wave = {}, {}, {}
    for i in full:
        before = np.array([j for j in full if j < i], np.int64)
        may = before[(c.high[before] >= c.low[i]).all(1)]
        sure = (c.low[may] >= c.high[i]).all(1) & (c.low[may] > c.high[i]).any(1)
        above[i], wholly[i] = may[~sure].tolist(), may[sure].tolist()
        wave[i] = max((wave[j] + 1 for j in may.tolist()), default=0)
    top, done = {}, []
    for turn in range(max(wave.values(), default=-1) + 1):
        now = [i for i in full if wave[i] == turn]
        floor = {i: max((top[j] + 1 for j in wholly[i]), default=0) for i in now}
        pairs = [(i, j) for i in now for j in above[i] if top[j] + 1 > floor[i]]
        own = c.rows.where(F.col("cell").isin(now))

        def raised(q: pa.Table, p: pa.Table) -> pa.Table:
            got = boxes.floors(boxes.matrix(q, cols), boxes.matrix(p, cols), p.column("rank").to_numpy(), np.zeros(q.num_rows, np.int64))
            return pa.table({"vid": q.column("vid"), "least": got})

        def ranked(t: pa.Table) -> pa.Table:
            least = np.maximum(t.column("least").to_numpy(), floor[t.column("cell")[0].as_py()])
            return t.drop_columns(["least"]).append_column("rank", pa.array(boxes.ranked(boxes.matrix(t, cols), least)))

        if pairs:
            known = reduce(DataFrame.unionByName, done).where(F.col("cell").isin(sorted({j for _, j in pairs})))
            raised_ = boxes.meet(own, known, pairs, c.n, raised, "vid long, least long").groupBy("vid").agg(F.max("least").alias("least"))
            own = own.join(raised_, "vid", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
        else:
            own = own.withColumn("least", F.lit(0).cast("long"))
        schema = T.StructType([f for f in own.schema.fields if f.name != "least"] + [T.StructField("rank", T.LongType())])
        done.append(cut(own.groupBy("cell").applyInArrow(ranked, schema)))
        top |= {r.cell: r.top for r in done[-1].groupBy("cell").agg(F.max("rank").alias("top")).collect()}
    if not done:
        return spark.createDataFrame([], T.StructType([*distinct.schema.fields, T.StructField("rank", T.IntegerType())]))
    return reduce(DataFrame.unionByName, done).select(*cols, F.col("rank").cast("int").alias("rank"))


def crowding(df: DataFrame, id_col: str, group: list[str] | None = None) -> DataFrame:
    """Adds ``boundary`` and ``crowding`` (finite sum of relative gaps) within each group.

    First and last row by (value, id) of each dimension are boundaries; a dimension without span counts for nothing.
    """
    group = group or []
    cols = dims(df)
    gaps, edges = F.lit(0.0), F.lit(False)
    for c in cols:
        w = Window.partitionBy(*group)
        o = w.orderBy(c, id_col)
        span = F.max(c).over(w) - F.min(c).over(w)
        before, after = F.lag(c).over(o), F.lead(c).over(o)
        gaps = gaps + F.when((span > 0) & before.isNotNull() & after.isNotNull(), (after - before) / span).otherwise(0.0)
        edges = edges | ((span > 0) & (before.isNull() | after.isNull()))
    return df.withColumn("boundary", edges).withColumn("crowding", F.when(edges, 0.0).otherwise(gaps))


def capacity_kept(df: DataFrame, id_col: str, capacity: int, group: list[str] | None = None) -> DataFrame:
    """The ``capacity`` rows kept of a front: those extreme in most dimensions, then by crowding, then by id.

    Every row tied at a dimension's least or greatest value is extreme in it.
    """
    group = group or []
    w = Window.partitionBy(*group)
    extremes, gaps = F.lit(0), F.lit(0.0)
    for c in dims(df):
        o = w.orderBy(c, id_col)
        low, high = F.min(c).over(w), F.max(c).over(w)
        span = high - low
        extremes = extremes + F.when((span > 0) & ((F.col(c) == low) | (F.col(c) == high)), 1).otherwise(0)
        gaps = gaps + F.coalesce(F.when(span > 0, (F.lead(c).over(o) - F.lag(c).over(o)) / span), F.lit(0.0))
    d = df.withColumn("extremes", extremes).withColumn("crowd", F.when(F.col("extremes") > 0, float("inf")).otherwise(gaps))
    d = d.withColumn("keep_order", F.row_number().over(w.orderBy(F.desc("extremes"), F.desc("crowd"), id_col)))
    return d.where(F.col("keep_order") <= capacity).drop("extremes", "crowd", "keep_order")


def volume(points: np.ndarray, reference: np.ndarray) -> float:
    """Exact volume dominated by the points above the reference: slabs of the last dimension, each a smaller problem."""
    points = points[(points >= reference).all(1)]
    if not len(points):
        return 0.0
    if points.shape[1] == 1:
        return float(points.max() - reference[0])
    if points.shape[1] == 2:  # staircase
        p = points[np.lexsort((-points[:, 1], -points[:, 0]))]
        top = np.maximum.accumulate(p[:, 1])
        right = np.r_[p[1:, 0], reference[0]]
        return float(((p[:, 0] - right) * (top - reference[1])).sum())
    cuts = np.unique(np.r_[reference[-1], points[:, -1]])
    return float(sum((b - a) * volume(points[points[:, -1] >= b][:, :-1], reference[:-1]) for a, b in zip(cuts[:-1], cuts[1:])))


def _outline(v: np.ndarray) -> np.ndarray:
    """The rows that matter for a volume, each vector once: the best by sum, then the best of what it doesn't cover, and so on."""
    left, out = v[np.argsort(-v.sum(1), kind="stable")], []
    while len(left):
        out.append(left[0])
        left = left[(left > left[0]).any(1)]
    return np.array(out)


def exclusive(p: np.ndarray, others: np.ndarray, reference: np.ndarray) -> float:
    """The volume above the reference that ``p`` dominates and none of ``others`` does: that of ``p`` less that of its limit set, the others clipped to it."""
    if not (p > reference).all():
        return 0.0
    limit = others[(others > reference).all(1)]
    if len(limit):
        limit = np.minimum(limit, p)
        if (limit == p).all(1).any():
            return 0.0
        limit = _outline(limit)
    return float(np.prod(p - reference)) - measure(limit, reference)


def measure(v: np.ndarray, reference: np.ndarray) -> float:
    """Volume that ``v`` dominates, by exclusive volumes one dimension lower: of the rows by their last value, each against those after it."""
    if not len(v):
        return 0.0
    if v.shape[1] < 3:
        return volume(v, reference)
    if v.shape[1] == 3 and len(v) <= BLOCK:  # sweep down the last dimension; row k of ``high`` is the outline of the first k + 1
        v = v[(v >= reference).all(1)]
        v = v[np.argsort(-v[:, 2], kind="stable")]
        x = np.sort(v[:, 0])
        high = np.maximum.accumulate(np.where(v[:, 0, None] >= x[None, :], v[:, 1, None] - reference[1], 0.0), 0)
        areas = high @ np.diff(x, prepend=reference[0])
        return float(areas @ -np.diff(v[:, 2], append=reference[2]))
    v = v[np.argsort(v[:, -1], kind="stable")]
    return float(sum((v[i, -1] - reference[-1]) * exclusive(v[i, :-1], v[i + 1 :, :-1], reference[:-1]) for i in range(len(v)) if v[i, -1] > reference[-1]))


def _sliced(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of each group dealt to slices of SLICE rows or so by hash, and all rows of the group for each of its slices."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    placed = cut(lookup(rows, sizes, group))
    own = placed.select(*[F.col(c).alias(c) for c in placed.columns]).withColumn("slice", F.pmod(F.xxhash64(*dims(rows)), F.col("slices")).cast("int"))
    return own, placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))


def hypervolume(df: DataFrame, reference: list[float], group: list[str]) -> DataFrame:
    """(group.., hypervolume) of each group's front: the exclusive volumes of its points, each against those after it in an order, dealt over tasks."""
    cols, ref = dims(df), np.array(reference, float)
    own, all_ = _sliced(front(df, group).select(*group, *cols).distinct(), group)

    def of(mine: pa.Table, every: pa.Table) -> pa.Table:
        v, w = boxes.matrix(mine, cols), boxes.matrix(every, cols)
        w = w[np.lexsort(w.T)]  # by the last value, then those before
        if mine.num_rows == every.num_rows:
            part = measure(w, ref)
        else:
            last = lambda x: tuple(x[::-1].tolist())
            at = {last(x): i for i, x in enumerate(w)}
            part = 0.0
            for x in v:
                after = w[at[last(x)] + 1 :]
                part += (x[-1] - ref[-1]) * exclusive(x[:-1], after[:, :-1], ref[:-1]) if (x > ref).all() else 0.0
        return pa.table({g: every.column(g).slice(0, 1).combine_chunks() for g in group} | {"part": [part]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in group)
    parts = own.groupBy(*group, "slice").cogroup(all_.groupBy(*group, "slice")).applyInArrow(of, f"{fields}, part double")
    return parts.groupBy(*group).agg(F.sum("part").alias("hypervolume"))


def contributions(df: DataFrame, id_col: str, reference: list[float], group: list[str]) -> DataFrame:
    """Adds ``contribution``: the volume that a row alone dominates, 0 or more; each row's limit set is a problem of its own, dealt over tasks."""
    cols, ref = dims(df), np.array(reference, float)
    one = df.groupBy(*group, *cols).agg(F.count("*").alias("n"))
    own, all_ = _sliced(one, group)

    def of(mine: pa.Table, every: pa.Table) -> pa.Table:
        v, w = boxes.matrix(mine, cols), boxes.matrix(every, cols)
        w = w[(w > ref).all(1)]
        alone = mine.column("n").to_numpy() == 1
        got = [max(0.0, exclusive(x, w[(w != x).any(1)], ref)) if a else 0.0 for x, a in zip(v, alone, strict=True)]
        return mine.select([*group, *cols]).append_column("contribution", pa.array(got, pa.float64()))

    schema = T.StructType([*[df.schema[c] for c in [*group, *cols]], T.StructField("contribution", T.DoubleType())])
    found = own.groupBy(*group, "slice").cogroup(all_.groupBy(*group, "slice")).applyInArrow(of, schema)
    return lookup(df, found, [*group, *cols]).select(*df.columns, "contribution")


def hypervolume_grid(df: DataFrame, reference: list[float]) -> DataFrame:
    """One row, ``hypervolume``, by a grid of coordinates: built-in joins only, for fronts of a few dozen rows."""
    cols = dims(df)
    pts = df.select(*cols).distinct().where(reduce(lambda a, b: a & b, [F.col(c) >= r for c, r in zip(cols, reference, strict=True)]))
    cells = None
    for i, (c, r) in enumerate(zip(cols, reference, strict=True)):
        edge = pts.select(F.col(c).alias("x")).union(df.sparkSession.createDataFrame([(float(r),)], "x double")).distinct()
        edge = edge.select(F.col("x").alias(f"l{i}"), F.lead("x").over(Window.orderBy("x")).alias(f"u{i}")).where(f"u{i} is not null")
        cells = edge if cells is None else cells.join(edge)
    inside = reduce(lambda a, b: a & b, [F.col(c) >= F.col(f"u{i}") for i, c in enumerate(cols)])
    size = reduce(lambda a, b: a * b, [F.col(f"u{i}") - F.col(f"l{i}") for i in range(len(cols))])
    return cells.join(pts, inside, "left_semi").agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("hypervolume"))


def _pairs(q: boxes.Cells, p: boxes.Cells, near) -> list[tuple[int, int]]:
    """The cells of ``p`` that ``near`` (lower and upper corner, cells' corners) names for each cell of ``q``."""
    full = np.flatnonzero(p.n > 0)
    return [(i, j) for i in np.flatnonzero(q.n > 0).tolist() for j in full[near(q.low[i], q.high[i], p.low[full], p.high[full])].tolist()]


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, ``coverage``: share of ``right`` that some row of ``left`` weakly dominates; 0 without rows."""
    cols = dims(left)
    q = boxes.cells(right.groupBy(*cols).agg(F.count("*").alias("n")), cols)
    p = boxes.cells(vectors(left.select(*cols)), cols)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        hit = pa.array(boxes.beaten(boxes.matrix(a, cols), boxes.matrix(b, cols), False))
        return a.select(["vid", "n"]).filter(hit)

    met = boxes.meet(q.rows, p.rows, _pairs(q, p, lambda low, high, b_low, b_high: (b_high >= low).all(1)), p.n, step, "vid long, n long")
    hits = met.groupBy("vid").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("h"))
    total = q.rows.agg(F.sum("n").alias("all"))
    return hits.join(total).select(F.coalesce(F.col("h") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("coverage"))  # one row each


def _least(q: boxes.Cells, p: boxes.Cells, cols: list[str], bound, widest, exact) -> DataFrame:
    """(vid, least) of the vectors of ``q``: only cells meet whose least possible value is within the greatest of the best one."""

    def near(low, high, b_low, b_high):
        if not len(b_low):
            return np.zeros(0, bool)
        return bound(low, high, b_low, b_high) <= widest(low, high, b_low, b_high).min()

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({"vid": a.column("vid"), "least": boxes.least(boxes.matrix(a, cols), boxes.matrix(b, cols), bound, exact)})

    met = boxes.meet(q.rows, p.rows, _pairs(q, p, near), p.n, step, "vid long, least double")
    return met.groupBy("vid").agg(F.min("least").alias("least"))


def epsilon(approximation: DataFrame, reference: DataFrame) -> DataFrame:
    """One row, ``epsilon``: the least shift by which the approximation weakly dominates all of the reference; null without either.

    What another row dominates never decides it, so only the two fronts meet.
    """
    cols = dims(reference)
    q, p = boxes.cells(vectors(reference.select(*cols)), cols), boxes.cells(vectors(approximation.select(*cols)), cols)
    widest = lambda low, high, b_low, b_high: (high - b_low).max(-1)
    return _least(q, p, cols, boxes.shift_bound, widest, boxes.shift).agg(F.max("least").alias("epsilon"))


def inverted_distance(approximation: DataFrame, reference: DataFrame) -> DataFrame:
    """One row, ``igd``: mean distance of the reference's rows to the nearest row of the approximation; null without either."""
    cols = dims(reference)
    q = boxes.cells(reference.groupBy(*cols).agg(F.count("*").alias("n")), cols)
    p = boxes.cells(approximation.select(*cols).distinct(), cols)
    widest = lambda low, high, b_low, b_high: np.sqrt((np.maximum(high - b_low, b_high - low) ** 2).sum(-1)) * (1 + 1e-12)
    near = _least(q, p, cols, boxes.distance_bound, widest, boxes.distance)
    return q.rows.join(near, "vid").agg((F.sum(F.col("least") * F.col("n")) / F.sum("n")).alias("igd"))
