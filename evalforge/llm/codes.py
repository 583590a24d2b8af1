"""Vector code compression: product codes by a delta-maintained Lloyd iteration.

Vectors of whole numbers are cut into equal parts; each part position has a codebook.  A
round assigns every part to its nearest entry and moves entries to the floor of their
parts' mean.  The assignments of the last round are kept in a written table, and the sums
and counts of all entries are running whole numbers: a round looks for the parts whose
assignment changed, and only these send anything, minus to the entry that they left and
plus to the one that they joined, added up within each task.  What meets is bounded by
parts x entries rows a task, however large or uneven the table is.

All arithmetic is on whole numbers, so neither partitioning nor a lost executor changes
a result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, cut, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances one step computes.
ROWS = 2048
#: Labels of over one in so many rows are joined by a broadcast of so many rows at most.
HOT = 1000
#: Float sums of products are exact below this.
_EXACT = 2**53


@dataclass(frozen=True)
class Codebooks:
    """Entries as whole numbers: parts x entries x width; ``dims`` is the vectors' own length, before zeros fill the last part."""

    entries: np.ndarray
    dims: int

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def limit(dims: int) -> int:
    """Bound of a component's size for which no squared distance of whole vectors leaves 63 bits."""
    return math.isqrt(2**62 // max(dims, 1)) // 2


def _vectors(column, dims: int) -> np.ndarray:
    """Rows x dims of a list column whose lists all have that length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def whole(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, label, v: floor(scale * x) as longs, zeros filling the last part) of the rows that can be coded, and their own length.

    Rows go whose vector is null or empty, has null or non-finite components, has another length than the row with
    the smallest id, or a scaled component beyond ``limit``.
    """
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    own = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = own.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(fine, F.lit(False)))
    first = own.select("id", F.size("x").alias("n")).orderBy(F.asc_nulls_last("id"), "n").first()
    dims = first.n if first else parts
    most = limit(dims)
    own = own.where((F.size("x") == dims) & F.forall("x", lambda e: F.abs(F.floor(e * float(scale)).cast("double")) <= float(most)))
    v = F.transform("x", lambda e: F.floor(e * float(scale)).cast("long"))
    pad = -dims % parts
    if pad:
        v = F.concat(v, F.array(*[F.lit(0).cast("long")] * pad))
    return own.select("id", "label", v.alias("v")), dims


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (n x parts x width) the nearest entry of each part, the first of equals, and its squared distance."""
    n, parts, width = v.shape
    codes, dist = np.zeros((n, parts), np.uint8 if entries.shape[1] <= 256 else np.int32), np.zeros((n, parts), np.int64)
    size = max(int(np.abs(v).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = 4 * width * (size + 1) ** 2 < _EXACT
    for p in range(parts):
        if exact:  # |x|^2 - 2xc + |c|^2, all terms whole and below 2^53
            x, c = v[:, p].astype(np.float64), entries[p].astype(np.float64)
            d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        else:
            d = np.zeros((n, entries.shape[1]), np.int64)
            for j in range(width):
                d += (v[:, p, j, None] - entries[p, :, j]) ** 2
        at = d.argmin(1)
        codes[:, p] = at
        dist[:, p] = d[np.arange(n), at].astype(np.int64)
    return codes, dist


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (id, label, v, code) with the codes of ``books``, and those before as ``old`` (null in the first round)."""
    entries = books.entries
    parts, _, width = entries.shape
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in ("id", "label", "v"))

    def step(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                at_ = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                codes, _ = nearest(_vectors(at_["v"], parts * width).reshape(-1, parts, width), entries)
                yield arrow(id=at_["id"], label=at_["label"], v=at_["v"], old=at_.get("code", pa.nulls(b.num_rows, pa.binary())), code=_bytes(codes))

    return rows.mapInArrow(step, f"{schema}, old binary, code binary")


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in codes], pa.binary())


def _codes(column, parts: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, parts)


def changes(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, n, sums, moved): what the parts whose code is no longer ``old`` take from and give to the entries, over all rows.

    A task sends a row for each entry that changed at most; ``moved`` counts the parts that joined it.
    """
    parts, entries, width = shape
    kind = np.uint8 if entries <= 256 else np.int32

    def step(batches):
        n, moved, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v, old, code = _vectors(b.column(0), parts * width).reshape(-1, parts, width), b.column(1), _codes(b.column(2), parts, kind)
            fresh = old.null_count == len(old)
            before = None if fresh else _codes(old, parts, kind)
            for p in range(parts):
                on = np.arange(len(code)) if fresh else np.flatnonzero(before[:, p] != code[:, p])
                for sign, at in ((1, code),) if fresh else ((1, code), (-1, before)):
                    np.add.at(n[p], at[on, p], sign)
                    np.add.at(sums[p], at[on, p], sign * v[on, p])
                np.add.at(moved[p], code[on, p], 1)
        p, e = np.nonzero((n != 0) | (moved != 0) | (sums != 0).any(2))
        yield arrow(part=p.astype(np.int32), entry=e.astype(np.int32), n=n[p, e], moved=moved[p, e], sums=pa.array(sums[p, e].tolist(), pa.list_(pa.int64())))

    sent = rows.select("v", "old", "code").mapInArrow(step, "part int, entry int, n long, moved long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]
    return sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), *total)


def fit(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame, list[int]]:
    """The codebooks after ``rounds`` rounds, the table of the last assignments, and how many parts each round sent.

    Codebooks start as the parts of the rows with the smallest ids (null ids last, rows of one id by their vectors);
    fewer rows give fewer entries.  The driver holds parts x entries sums.
    """
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    width = -(-dims // parts)
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books, rows, sent = Codebooks(np.ascontiguousarray(start), dims), kept, []
    if not first:
        return books, kept, sent
    n, sums = np.zeros(start.shape[:2], object), np.zeros(start.shape, object)  # whole numbers of any size
    for _ in range(rounds):
        rows = staged(_assigned(rows, books))
        got = changes(rows, start.shape).collect()  # parts x entries rows at most
        for r in got:
            n[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array([r[f"s{j}"] for j in range(width)], object)
        sent.append(sum(r.moved for r in got))
        moved = books.entries.copy()
        for p, e in zip(*np.nonzero(n), strict=True):
            moved[p, e] = [int(s) // int(n[p, e]) for s in sums[p, e]]
        books = Codebooks(moved, dims)
    return books, rows, sent


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code: two hex digits a part, error: squared distances summed over parts) of ``whole`` rows."""
    entries = books.entries
    parts, _, width = entries.shape
    kind = dict(rows.dtypes)["label"]

    def step(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                codes, dist = nearest(_vectors(b.column(2), parts * width).reshape(-1, parts, width), entries)
                wide = 2 if codes.dtype == np.uint8 else 4
                text = [x.tobytes().hex() for x in codes] if wide == 2 else ["".join(f"{i:04x}" for i in x) for x in codes.tolist()]
                yield arrow(id=b.column(0), label=b.column(1), code=pa.array(text, pa.string()), error=dist.sum(1))

    return rows.select("id", "label", "v").mapInArrow(step, f"id long, label {kind}, code string, error long")


def decode(code: str, books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    wide = 2 if books.entries.shape[1] <= 256 else 4
    at = [int(code[i : i + wide], 16) for i in range(0, len(code), wide)]
    return (np.concatenate([books.entries[p, e] for p, e in enumerate(at)])[: books.dims] / scale).tolist()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, nulls together.

    Sums are formed within tasks first.  The labels of more than a thousandth of all rows, a thousand at most, are
    broadcast to their rows; the others are joined.
    """
    sums = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")))
    edge = (sums.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    own, often, other = coded.alias("own"), F.broadcast(sums.where(F.col("n") >= edge)).alias("often"), sums.where(F.col("n") < edge).alias("other")
    told = own.join(often, F.col("own.label").eqNullSafe(F.col("often.label")), "left").select("own.*", "label_error")
    left = told.where("label_error is null").drop("label_error").alias("own")
    rare = left.join(other, F.col("own.label").eqNullSafe(F.col("other.label"))).select("own.*", "label_error")
    return told.where("label_error is not null").unionByName(rare)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """One row for each row that can be coded (``whole``): id, label, code, error, label_error; and the codebooks.

    Repeated rows and ids stay, each coded by itself; null ids come last among the first codebooks; an empty table
    gives no row and empty codebooks; a length that the parts don't divide is filled with zeros; columns other than
    the three are ignored, whatever their names.
    """
    if not 1 <= entries <= 65536 or parts < 1:
        raise ValueError("entries must be 1 to 65536, parts 1 or more")
    kept, dims = whole(df, id_col, vector_col, label_col, parts)
    books, rows, _ = fit(kept, dims, parts, entries, rounds)
    if not books.entries.size:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, books
    return label_errors(staged(encode(rows, books))), books


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``embeddings`` that can be coded."""
    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB: components as rows, two rounds and a last assignment."""
    assigned = "SELECT rid, part, min({{'d': d, 'e': entry}}) AS best FROM (SELECT v.rid, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {books} c ON c.part = v.part AND c.pos = v.pos GROUP BY v.rid, v.part, c.entry) GROUP BY rid, part"
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({assigned.format(books=f'b{i}')})")
        steps.append(f"m{i} AS (SELECT v.part, a.best.e AS entry, v.pos, CAST(floor_div(sum(v.x), count(*)) AS BIGINT) AS x FROM v JOIN a{i} a ON a.rid = v.rid AND a.part = v.part GROUP BY v.part, a.best.e, v.pos)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)")
    steps.append(f"z AS MATERIALIZED ({assigned.format(books=f'b{ROUNDS}')})")
    rounds = ",\n".join(steps).replace("floor_div(sum(v.x), count(*))", "(sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*)")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, (i - 1) // (len(q) // {PARTS}) AS part, (i - 1) % (len(q) // {PARTS}) AS pos, q[i] AS x FROM (SELECT rid, q, unnest(range(1, len(q) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {ENTRIES}),
{rounds},
o AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY rid),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o ON o.rid = k.rid, s"""


QUERIES = {"op12_vector_codes": op12}
SQL: dict[str, str] = {"op12_vector_codes": _sql()}
