"""Phrase collocations: merged count-min sketches, an exact second pass, scores, subsumption.

First pass: every task counts its phrases of 1 to ``MOST_WORDS`` words (occurrences, per
language) in a count-min sketch of two rows.  A task's share of the sketch travels as
sorted cells with their counts, in blocks, and the blocks of a range of cells are added
up where they meet.  A cell's sum is never below the count of any phrase that falls into
it, so a phrase that occurs ``least`` times has both its cells at ``least`` or above; one
bit a cell says so, and these bits are broadcast (2 * ``MOST_CELLS`` bits at most).

Second pass: a phrase is looked up under both its cells, and under those of the two
phrases that it consists of but for its last or first word.  Survivors are counted
exactly, by their text; what the sketch overstated falls out there, and nothing
frequent is lost.  The sketch has a cell for about every ``LOAD`` occurrences up to
its bound; beyond it more phrases survive to be counted, and the result is the same.

A candidate's score is that of its weakest cut in two, floor(2000000 a / (l + r)).
A candidate goes if it lies in a longer one that has ``cover`` percent of its
occurrences or more.  Cuts and covers are looked up by equi-joins on (lang, phrase), and
ranks come from a range partitioning, so no language has to fit a task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, staged, table
from .lm import _LOWER, _M1, _M2, _M3, _MASKS, SHORT, STEP_BYTES, U, _mix, _texts

#: Phrases have up to so many words, and occur so often or more.
MOST_WORDS, LEAST = 4, 30
#: A longer phrase with so many percent of a phrase's occurrences takes its place.
COVER = 80
#: Phrases that are returned for each language.
TOP = 2000
#: Occurrences a cell of a row of the sketch may hold on average, and bound of a row's cells.
LOAD, MOST_CELLS = 8, 1 << 29
#: Bytes of text that stand for one word, for the size of the sketch alone.
WORD_BYTES = 6
#: Words that a task holds before it counts them, and words whose phrases are looked at in one step.
HOLD, AT_ONCE = 1 << 20, 1 << 18
#: Characters that end a piece; they and space and tab separate words (fixed by the contract).
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_ENDS = np.zeros(256, bool)
_ENDS[list(ENDS)] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
#: Odd factors of the second fingerprint.
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U)


def _hashed(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, size, hash, second hash) of the lower-cased words of ``raw``; words also end at ``cuts``."""
    n = len(raw)
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:n])
    gap = _BETWEEN[raw]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = ~gap[cuts]
    last[cuts - 1] = ~gap[cuts - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    two = low[:-1].astype(np.uint16) | low[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(U) | four[4:].astype(U) << U(32)  # eight bytes from every position on
    head = eight[start] & _MASKS[np.minimum(size, 8)]
    tail = eight[start + np.maximum(size - 8, 0)] & _MASKS[np.minimum(size, 8)]
    out = _mix(head + size.astype(U) * _M3)
    for at in range(8, SHORT, 8):
        more = np.flatnonzero((size > at) & (size <= SHORT))
        if not len(more):
            break
        out[more] = _mix(out[more] * _M1 ^ (eight[start[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(low[start[i] : start[i] + size[i]].tobytes(), 5)
    return start, size, out, head * _M1 ^ tail * _M2 ^ size.astype(U) * _M3


def words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, size, hash, second hash, zone) of all words; words of one piece of one row share a zone."""
    got, at = [], 0
    while at < len(raw):
        end = min(at + 2 * STEP_BYTES, len(raw))
        while end < len(raw):  # a slice ends before a separator
            gaps = np.flatnonzero(_BETWEEN[raw[end : end + STEP_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + STEP_BYTES, len(raw))
        start, *more = _hashed(raw[at:end], cuts - at)
        got.append((start + at, *more))
        at = end
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    start, size, h, second = (np.concatenate(x) for x in zip(*got, strict=True))
    return start, size, h, second, np.searchsorted(np.flatnonzero(_ENDS[raw]), start) + np.searchsorted(cuts, start, side="right")


def _steps(batches):
    """For steps of whole rows of (lang, text): languages of the rows, row of each word, text, and ``words``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).to_pylist()
        offsets, raw = _texts(batch.column(1))
        row = 0
        while row < batch.num_rows:
            stop = max(int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1, row + 1)
            part, cuts = raw[offsets[row] : offsets[stop]], offsets[row + 1 : stop] - offsets[row]
            got = words(part, cuts)
            yield langs[row:stop], np.searchsorted(cuts, got[0], side="right"), part, got
            row = stop


def _phrases(langs, row, got, most: int):
    """For blocks of words: (place of the first, [(whole, key, second key) for each length]).

    Keys stand for the phrase that starts at each word, with its language; ``whole`` tells whether it lies within a piece.
    """
    _, _, h, second, zone = got
    of = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in set(langs)}
    lang = np.array([of[x] for x in langs], U)
    for at in range(0, len(h), AT_ONCE):
        n, seen = min(AT_ONCE, len(h) - at), min(AT_ONCE + most - 1, len(h) - at)
        hh, ss, zz, ll = h[at : at + seen], second[at : at + seen], zone[at : at + seen], lang[row[at : at + seen]]
        key, other, out = _mix(hh ^ ll), ss * _ODD[0] + ll, []
        for m in range(1, most + 1):
            if m > 1:
                key = _mix(key[:-1] * _M1 + hh[m - 1 :])
                other = other[:-1] + ss[m - 1 :] * _ODD[(m - 1) % 4] * U(m)
            out.append(((zz[m - 1 :] == zz[: max(len(zz) - m + 1, 0)])[:n], key[:n], other[:n]))
        yield at, out


def _cells(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The key's cell in either row of 2 ** bits cells; the second row's cells follow the first's."""
    down = U(64 - bits)
    return (key >> down).astype(np.uint32), ((_mix(key + _M2) >> down) + U(1 << bits)).astype(np.uint32)


def _packed(a: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of the number, compressed."""
    return pa.compress(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).reshape(-1)


def _bucket_bits(bits: int) -> int:
    """Cells of a block as a power of two: at least 256 blocks make a sketch, and a block has a million cells at most."""
    return max(min(bits + 1 - 8, 20), 3)


def _sketcher(bits: int, most: int):
    """A task's share of the sketch as (bucket, n, cells, counts): differences of sorted cells, and the counts."""
    wide = _bucket_bits(bits)

    def blocks(held):
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = cells >> np.uint32(wide)
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(cells)]
        rows = [(int(bucket[i]), j - i, _packed(np.diff(cells[i:j], prepend=bucket[i] << np.uint32(wide))), _packed(counts[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for at in range(0, len(rows), 64):
            b, n, c, k = zip(*rows[at : at + 64], strict=True)
            yield arrow(bucket=pa.array(b, pa.int32()), n=pa.array(n, pa.int32()), cells=pa.array(c, pa.binary()), counts=pa.array(k, pa.binary()))

    def step(batches):
        held, amount = [], 0
        for langs, row, _, got in _steps(batches):
            for _, lengths in _phrases(langs, row, got, most):
                for whole, key, _ in lengths:
                    held += _cells(key[whole[: len(key)]], bits)
            amount += len(got[0])
            if amount >= HOLD:
                yield from blocks(held)
                held, amount = [], 0
        if amount:
            yield from blocks(held)

    return step


def _adder(bits: int, least: int):
    """Over blocks sorted by bucket: (bucket, bits of the cells whose sum is ``least`` or more)."""
    wide = _bucket_bits(bits)

    def step(batches):
        at, sums = None, None
        told = lambda: arrow(bucket=pa.array([at], pa.int32()), bits=pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary()))
        for b in batches:
            for i, bucket in enumerate(b.column(0).to_pylist()):
                if bucket != at:
                    if at is not None:
                        yield told()
                    at, sums = bucket, np.zeros(1 << wide, np.int64)
                n = b.column(1)[i].as_py()
                sums[np.cumsum(_unpacked(b.column(2)[i].as_py(), n), dtype=np.int64)] += _unpacked(b.column(3)[i].as_py(), n)
        if at is not None:
            yield told()

    return step


def sketch(src: DataFrame, least: int, most: int, bits: int) -> np.ndarray:
    """One bit for each cell of both rows, whether its sum is ``least`` or more, over all rows of (lang, text)."""
    parts = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = src.mapInArrow(_sketcher(bits, most), "bucket int, n int, cells binary, counts binary")
    summed = staged(blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_adder(bits, least), "bucket int, bits binary"))
    size = max((1 << _bucket_bits(bits)) // 8, 1)
    out = np.zeros((1 << (bits + 1)) // (1 << _bucket_bits(bits)) * size, np.uint8)
    for r in summed.toLocalIterator():  # one block at a time; all of them are bounded by MOST_CELLS
        out[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _alive(flags: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    """Places of the keys whose cells both have their bit."""
    one, two = _cells(key, bits)
    hit = lambda c: (flags[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
    first = np.flatnonzero(hit(one))
    return first[hit(two[first])]


def _counter(flags, bits: int, most: int):
    """Exact counts of a task's surviving phrases as (lang, phrase, m, f); m = 0 has the words of a language."""

    def counted(keys, seconds, starts, ends, sizes, of, texts, langs, totals):
        key, second, start, end, m, lang = (np.concatenate(x) for x in (keys, seconds, starts, ends, sizes, of))
        order = np.argsort(key, kind="stable")
        k, s = key[order], second[order]
        if ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():  # different phrases share a key
            order = np.lexsort((second, key))
            k, s = key[order], second[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, np.int64)
        f = np.diff(np.r_[first, len(k)])
        one = order[first]
        raw = np.take(_LOWER, np.concatenate(texts)).tobytes()
        phrase = [b" ".join(raw[i:j].split()) for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        names = list(langs)
        rows = [names[i] for i in lang[one].tolist()] + list(totals)
        phrase += [b""] * len(totals)
        m, f = np.r_[m[one], np.zeros(len(totals), np.int32)], np.r_[f, np.array(list(totals.values()), np.int64)]
        for at in range(0, len(rows), 16384):
            to = at + 16384
            yield arrow(lang=pa.array(rows[at:to], pa.string()), phrase=pa.array(phrase[at:to], pa.binary()), m=pa.array(m[at:to], pa.int32()), f=pa.array(f[at:to], pa.int64()))

    def step(batches):
        held: tuple[list, ...] = ([], [], [], [], [], [])
        texts, langs, totals, amount, base = [], {}, {}, 0, 0
        for names, row, raw, got in _steps(batches):
            start, size = got[0], got[1]
            code = np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)
            for i, n in enumerate(np.bincount(row, minlength=len(names)).tolist()):
                totals[names[i]] = totals.get(names[i], 0) + n
            for at, lengths in _phrases(names, row, got, most):
                before = None
                for m, (whole, key, second) in enumerate(lengths, 1):
                    on = whole if before is None else whole & before[: len(whole)] & np.r_[before[1:], True][: len(whole)]
                    place = np.flatnonzero(on)
                    place = place[_alive(flags.value, bits, key[place])]
                    before = np.zeros(len(whole), bool)
                    before[place] = True
                    word = place + at
                    new = (key[place], second[place], start[word] + base, start[word + m - 1] + size[word + m - 1] + base, np.full(len(word), m, np.int32), code[row[word]])
                    for have, x in zip(held, new, strict=True):
                        have.append(x)
            texts.append(raw)
            base += len(raw)
            amount += len(start)
            if amount >= HOLD:
                yield from counted(*held, texts, langs, totals)
                held, texts, langs, totals, amount, base = ([], [], [], [], [], []), [], {}, {}, 0, 0
        if texts:
            yield from counted(*held, texts, langs, totals) if held[0] else ()

    return step


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, lang_col: str = "lang", text_col: str = "text", load: float = LOAD, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, phrase, m, f long): all phrases of 1 to ``most`` words that occur ``least`` times or more, with exact counts; m = 0 has each language's words.

    Null texts are empty, a null language is ``und``.  Texts may be of any length; rows count as often as they occur.
    """
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    text = src.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    cells = max(min(int(text) / WORD_BYTES * most / load, most_cells), 1)
    bits = max(math.ceil(math.log2(cells)), 10)
    flags = src.sparkSession.sparkContext.broadcast(sketch(src, least, most, bits))
    found = src.mapInArrow(_counter(flags, bits, most), "lang string, phrase binary, m int, f long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "m").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("m") == 0))


def _slice(at: int, n: int):
    return F.array_join(F.slice("words", at, n), " ")


def scored(freq: DataFrame, most: int = MOST_WORDS, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers, from ``frequent``'s rows.

    Of the cuts, the lowest score counts, then the one after the fewest words; all arithmetic is on whole numbers.
    """
    known = freq.where("m >= 1")
    cand = known.where("m >= 2").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    side = lambda k, s, part: F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), part.alias("part"))
    asks = [F.when(F.col("m") > k, side(k, s, _slice(1, k) if s == "l" else F.array_join(F.slice("words", F.lit(k + 1), F.col("m")), " "))) for k in range(1, most) for s in "lr"]
    asked = cand.select("lang", "phrase", "m", "a", F.explode(F.array_compact(F.array(*asks))).alias("x")).select("lang", "phrase", "m", "a", "x.*")
    told = asked.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]).select("lang", "phrase", "a", "k", "s", "f", F.lit(None).cast("long").alias("cover"))
    inner = [F.when(F.col("m") >= i + n, _slice(i + 1, n)) for n in range(2, most) for i in range(most - n + 1)]
    covered = cand.where("m > 2").select("lang", F.explode(F.array_distinct(F.filter(F.array(*inner), lambda x: x.isNotNull() & (x != F.col("phrase"))))).alias("phrase"), F.col("a").alias("cover"))
    nothing = {"a": "long", "k": "int", "s": "string", "f": "long"}
    rows = told.unionByName(covered.select("lang", "phrase", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "cover"))
    at = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("s") == s), F.col("f"))).alias(f"{s}{k}")
    one = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("cover").alias("cover"), *[at(k, s) for k in range(1, most) for s in "lr"])
    exact = lambda c: f"cast({c} as decimal(20, 0))"
    cut_ = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"cast(2000000 as decimal(10, 0)) * {exact('a')} div ({exact(f'l{k}')} + {exact(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most)]
    kept = one.where("a is not null").where(F.expr(f"cover is null or cast(100 as decimal(10, 0)) * {exact('cover')} < cast({int(cover)} as decimal(10, 0)) * {exact('a')}"))
    return kept.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*cut_))).alias("best")).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language with ``rank`` (from 1), by score and a descending, then phrase.

    Ranks are places in a range partitioning plus the number of the language's rows in the partitions before.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    placed = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = sizes.alias("x").join(sizes.select("lang", F.col("part").alias("p"), F.col("n").alias("k")).alias("y"), "lang").where("p < part").groupBy("lang", "part").agg(F.sum("k").alias("before"))
    starts = sizes.join(earlier, ["lang", "part"], "left").select("lang", "part", "first", F.coalesce("before", F.lit(0)).alias("before")).where(F.col("before") < top)
    out = placed.join(starts, ["lang", "part"]).withColumn("rank", F.col("place") - F.col("first") + F.col("before") + 1)
    return out.where(F.col("rank") <= top).drop("part", "place", "first", "before")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, cover: int = COVER, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each time; ties go by score,
    occurrences and the phrase's bytes; an empty table, or one without a frequent phrase, gives no row; other columns
    are ignored, whatever their names.
    """
    if least < 1 or most < 2:
        raise ValueError("least must be 1 or more, most 2 or more")
    freq = staged(frequent(docs, least, most, lang_col, text_col))
    totals = freq.where("m = 0").select("lang", F.col("f").alias("n"))
    out = ranked(scored(freq, most, cover), top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


_EACH = reduce(lambda a, b: f"{a} UNION ALL {b}", [f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(ws) - {m - 2}), lambda i: array_to_string(ws[i:i + {m - 1}], ' '))) AS phrase FROM w" for m in range(1, MOST_WORDS + 1)])
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(ws[1:{k}], ' ') AS lp, array_to_string(ws[{k + 1}:], ' ') AS rp FROM c WHERE m > {k}" for k in range(1, MOST_WORDS))
_INNER = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[{i + 1}:{i + n}], ' ') AS phrase, a FROM c WHERE m > {n} AND m >= {i + n}" for n in range(2, MOST_WORDS) for i in range(MOST_WORDS - n + 1))

QUERIES = {"op11_phrase_collocations": op11}
SQL: dict[str, str] = {
    "op11_phrase_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM ({_EACH}) GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT x.lang, x.phrase, a, k, lf.f AS l, rf.f AS r, (2000000::HUGEINT * a) // (lf.f + rf.f) AS score FROM ({_CUTS}) x JOIN f lf ON lf.lang = x.lang AND lf.phrase = lp JOIN f rf ON rf.lang = x.lang AND rf.phrase = rp),
b AS (SELECT lang, phrase, a, l, r, score FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(a) AS most FROM ({_INNER}) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < {COVER} * a)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}"""
}
