"""Language-model scoring with a log-frequency Bloom filter.

A bigram model with absolute discounting is interpolated with add-0.1 unigrams.
Unigram counts are exact for every token.  Bigram counts are quantised on a
logarithmic scale and kept in a Bloom filter: a bigram of level q is inserted with
each of 1..q, and its level is read back by probing 1, 2, .. until a probe fails
(Talbot and Osborne, 2007).  What a context has in all, and what its bigrams take, is in
the filter as well, in finer steps.  The filter consists of parts, one for a bucket of keys,
that don't depend on any bound.  As many parts as a bound allows go to the workers as a
broadcast; the others are asked where they lie.  Then texts are dealt into chunks, each asks
once for what it doesn't know, in sorted blocks, one for each bucket, and gets blocks of
answers back.  Frequent tokens' counts, and what the filter says of them as contexts, are
broadcast up to another bound.  Both bounds decide where an answer is looked up, never what it is.

The model is that of all bigrams that occur at least ``LEAST`` times, at any size of
the corpus; a context keeps for the unigrams all that its bigrams don't take, so no
probability is lost.

Tokens are 64-bit hashes of their bytes, computed for whole Arrow buffers at once; a
bigram is known by the upper halves of its tokens' hashes.  Counts travel as sorted
blocks, one row for each task and bucket of hashes, and are merged in blocks, so that
neither Spark nor Python handles tokens one at a time.  Buckets are as many as the
text has ``BUCKET_BYTES``, so none grows with the corpus, and a frequent token or
bigram is one entry of a task's block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, crc_bucket, small_batches, staged, table, tidy_shuffles

#: Bound of the table of frequent tokens that workers get as a whole; rarer tokens' counts are joined.
VOCABULARY = 1 << 18
#: Bigrams of the model occur so often or more.
LEAST = 2
DISCOUNT, BASE, LEVELS = 0.75, 1.4, 96
#: Probes of a key's first level, and of each further one.
FIRST, LATER = 10, 5
#: Bound of the broadcast filter in bits (128 MB).
MOST_BITS = 1 << 30
#: Text that one bucket of hashes stands for, text that is looked at in one step, and tokens that a task counts at a time.
BUCKET_BYTES, STEP_BYTES, HOLD = 1 << 22, 1 << 19, 1 << 20
#: Keys that a filter looks up at a time, for each takes over a hundred bytes meanwhile.
KEYS_AT_ONCE = 1 << 16
#: Blocks that go to Spark at a time.
AT_ONCE = 16
#: Text that asks together where the filter isn't broadcast whole.
CHUNK_BYTES = 1 << 23
#: Words up to so many bytes are hashed together; longer ones one by one.
SHORT = 64
U = np.uint64
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_M3), -1, 1 << 64))
#: What stands for the end of a text, and for what precedes its first token.
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_BITS32 = U(0xFFFFFFFF)
#: What sets the two numbers of a context apart, and the steps of their upper digit; the upper half, hence the bucket, stays.
_CONTEXT_COUNT, _CONTEXT_TAKEN = U(0x78BD642F), U(0xA0B428DB)
_STEPS = (np.arange(64, dtype=U) * U(0x9E3779B1)) & U(0xFFFFFFFF)
_LEVEL_SALTS = np.arange(512, dtype=U) * _M1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each lower-cased word of ``raw`` (bytes); words also end at the positions ``cuts``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:n])
    space = _SPACE[raw]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    first[cuts] = ~space[cuts]
    last[:-1] &= space[1:]
    last[cuts - 1] = ~space[cuts - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    # eight bytes from every position on
    two = low[:-1].astype(np.uint16) | low[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(U) | four[4:].astype(U) << U(32)
    out = _mix((eight[start] & _MASKS[np.minimum(size, 8)]) + size.astype(U) * _M3)
    for at in range(8, SHORT, 8):
        more = np.flatnonzero((size > at) & (size <= SHORT))
        if not len(more):
            break
        out[more] = _mix(out[more] * _M1 ^ (eight[start[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(low[start[i] : start[i] + size[i]].tobytes(), 5)
    return start, out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)


def _pieces_of(raw: np.ndarray):
    """Slices of about STEP_BYTES of one long text, cut before white space, for memory's sake."""
    at = 0
    while at < len(raw):
        end = min(at + STEP_BYTES, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end : end + STEP_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + STEP_BYTES, len(raw))
        yield raw[at:end]
        at = end


def token_rows(batches, column: str = "text"):
    """For steps of whole rows: (batch slice, tokens of each row, all their hashes), each row ended by END."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, raw = _texts(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = max(int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1, row + 1)
            begin, part = offsets[row], raw[offsets[row] : offsets[stop]]
            if stop == row + 1 and len(part) > 2 * STEP_BYTES:
                h = np.concatenate([word_hashes(p, np.zeros(0, np.int64))[1] for p in _pieces_of(part)])
                words = np.array([len(h)])
            else:
                start, h = word_hashes(part, offsets[row + 1 : stop] - begin)
                edges = np.searchsorted(start, offsets[row : stop + 1] - begin)
                words = np.diff(edges)
            sizes = words + 1
            all_ = np.empty(len(h) + len(words), U)
            ends = np.cumsum(sizes) - 1
            inner = np.ones(len(all_), bool)
            inner[ends] = False
            all_[inner] = h
            all_[ends] = END
            yield batch.slice(row, stop - row), sizes, all_
            row = stop


def bigrams(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of each token with its predecessor; keys are in one-to-one relation to the upper halves of both hashes."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return ((before & ~_BITS32) | (h >> U(32))) * _M3


def context_of(key: np.ndarray) -> np.ndarray:
    """Upper half of the hash of a bigram's first token."""
    return (key * _BACK) >> U(32)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket; grows with the key."""
    return ((key >> U(32)) * U(buckets)) >> U(32)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised level of each count of LEAST or more, from 1 on."""
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, LEAST) / LEAST) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def _values() -> np.ndarray:
    first = np.ceil(LEAST * BASE ** np.arange(LEVELS) - 1e-9)
    last = np.maximum(np.ceil(LEAST * BASE ** np.arange(1, LEVELS + 1) - 1e-9) - 1, first)
    return np.r_[0.0, np.sqrt(first * last)]


#: The count that each level stands for; 0 for level 0.
VALUES = _values()
#: Contexts have finer steps: level q of a context stands for _FINE ** (q - 1) or less, so that what bigrams take is never understated.
_FINE = 1.05
_FINE_LEVELS = 700
#: Steps of the lower digit of such a level; each step of the upper one is a key of its own.
_DIGIT = 16


def _fine_level(x: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.ceil(np.log(np.maximum(x, 1.0)) / math.log(_FINE) - 1e-9), _FINE_LEVELS).astype(np.int64)


def _fine_value(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, _FINE ** (q - 1.0), 0.0)


def _probe_start(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (key, level) start, and their step."""
    h = _mix(key ^ _LEVEL_SALTS[level])
    return h & _BITS32, (h >> U(32)) | U(1)


def _probe(start: np.ndarray, step: np.ndarray, j: int, size: np.ndarray) -> np.ndarray:
    """The j-th place in a part of ``size`` bits."""
    return ((((start + U(j) * step) & _BITS32) * size) >> U(32)).astype(np.int64)


def insert(bits: np.ndarray, key: np.ndarray, level: np.ndarray) -> None:
    """Sets the bits of all (key, 1..level) in one part, a boolean array."""
    for q in range(1, int(level.max(initial=0)) + 1):
        start, step = _probe_start(key[level >= q], q)
        for j in range(FIRST if q == 1 else LATER):
            bits[_probe(start, step, j, U(len(bits)))] = True


def part_bits(level: np.ndarray) -> int:
    """Bits of a part for keys of these levels, half of which will be set."""
    return _bits_for(len(level), int(level.sum()))


def _bits_for(keys: int, levels_: int) -> int:
    return 64 * math.ceil((keys * FIRST + (levels_ - keys) * LATER) / math.log(2) / 64 + 1)


@dataclass(frozen=True)
class Filter:
    """Log-frequency Bloom filter in parts, one a bucket of keys; part b has the bits from base[b] on.

    Of ``buckets`` parts (0: all that are here) the first len(base) - 1 are here.
    """

    bits: np.ndarray
    base: np.ndarray
    buckets: int = 0

    def level(self, key: np.ndarray, most: int = LEVELS) -> np.ndarray:
        """Level of each key, by membership probes of 1, 2, ..; 0 if the first fails, -1 if its part isn't here."""
        return np.concatenate([self._level(key[at : at + KEYS_AT_ONCE], most) for at in range(0, max(len(key), 1), KEYS_AT_ONCE)])

    def _level(self, key: np.ndarray, most: int) -> np.ndarray:
        here = len(self.base) - 1
        part = _bucket(key, self.buckets or max(here, 1)).astype(np.int64)
        out = np.where(part < here, 0, -1)
        left = np.flatnonzero(part < here)
        if not len(left):
            return out
        part = part[left]
        k, base, size = key[left], self.base[part], (self.base[part + 1] - self.base[part]).astype(U)
        for q in range(1, most + 1):
            alive = np.arange(len(left))
            start, step = _probe_start(k, q)
            for j in range(FIRST if q == 1 else LATER):
                at = base[alive] + _probe(start[alive], step[alive], j, size[alive])
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            left, k, base, size = left[alive], k[alive], base[alive], size[alive]
            out[left] = q
            if not len(left):
                break
        return out


def _digits(key: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter entries (key, level) of fine levels: the lower digit as a level, each step of the upper one as a key."""
    keys, levels_ = [key], [q % _DIGIT + 1]
    for h in range(1, int((q // _DIGIT).max(initial=0)) + 1):
        on = key[q // _DIGIT >= h] ^ _STEPS[h]
        keys.append(on)
        levels_.append(np.ones(len(on), np.int64))
    return np.concatenate(keys), np.concatenate(levels_)


def _fine_of(f: Filter, key: np.ndarray) -> np.ndarray:
    """The fine level of each key; 0 if it has none, -1 if its part isn't here."""
    low = f.level(key, _DIGIT)
    out = np.where(low > 0, low - 1, low)
    left = np.flatnonzero(low > 0)
    out[low > 0] = low[low > 0] - 1
    for h in range(1, _FINE_LEVELS // _DIGIT + 1):
        left = left[f.level(key[left] ^ _STEPS[h], 1) > 0]
        if not len(left):
            break
        out[left] += _DIGIT
    return np.where(low > 0, np.maximum(out, 1), low)


def _grades(f: Filter, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fine levels of contexts: in all, and taken by bigrams."""
    return _fine_of(f, context ^ _CONTEXT_COUNT), _fine_of(f, context ^ _CONTEXT_TAKEN)


def _masses_of(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = (q > 0) & (p > 0)
    return np.where(both, np.maximum(_fine_value(q), _fine_value(p)), 1.0), np.where(both, _fine_value(p), 0.0)


def masses(f: Filter, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(in all, taken by bigrams, whether their part is here) of contexts as the filter has them; 1 and 0 for those that it doesn't."""
    q, p = _grades(f, context)
    return *_masses_of(q, p), q >= 0


class Vocabulary:
    """Sorted hashes of frequent tokens, looked up through an index on their upper bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = U(64 - max(int(len(hashes)).bit_length() + 2, 8))
        slots = 1 << (64 - int(self.shift))
        self.offset = np.searchsorted(hashes >> self.shift, np.arange(slots + 1, dtype=U)).astype(np.int32)
        self.longest = int(np.diff(self.offset).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.offset[slot], self.offset[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        for _ in range(self.longest):
            same = self.hashes[at] == h[left]
            out[left[same]] = at[same]
            at = at + 1
            on = ~same & (at < end)
            left, at, end = left[on], at[on], end[on]
            if not len(left):
                break
        return out


@dataclass(frozen=True)
class Model:
    """What scoring needs: totals, the exact counts of all tokens, the broadcast part (bounded by VOCABULARY and MOST_BITS), and the filters' parts.

    The first ``here`` of ``buckets`` parts are in the broadcast.
    """

    n: int
    v: int
    counts: DataFrame
    #: (bucket, keys, counts) of all tokens, in sorted blocks.
    tokens: DataFrame
    shared: object
    #: (bucket, bits, size) of the bigrams' filter, and of the contexts'.
    parts: tuple[DataFrame, DataFrame]
    buckets: int
    here: int

    @property
    def beyond(self) -> bool:
        """Whether some parts aren't in the broadcast."""
        return self.here < self.buckets


_BLOCK = "kind int, bucket long, keys binary, counts binary"


def _blocks(kind: int, key: np.ndarray, buckets: int, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts as one row for each bucket that has any."""
    b = _bucket(key, buckets)
    edges = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    cut_ = lambda a: pa.array([a[i:j].tobytes() for i, j in spans], pa.binary())
    return arrow(kind=pa.array([kind] * len(spans), pa.int32()), bucket=pa.array([int(b[i]) for i, _ in spans], pa.int64()), keys=cut_(key), counts=cut_(counts))


def _counter(buckets: int):
    """Counts tokens (kind 0) and bigrams (kind 1) of a task's rows."""

    def step(batches):
        held: list[list[np.ndarray]] = [[], []]
        amount = 0

        def flush():
            for kind in (0, 1):
                key, n = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind].clear()
                blocks = _blocks(kind, key, buckets, n.astype(np.uint32))
                for at in range(0, blocks.num_rows, AT_ONCE):
                    yield blocks.slice(at, AT_ONCE)

        for _, sizes, h in token_rows(batches):
            held[0].append(h)
            held[1].append(bigrams(h, sizes))
            amount += len(h)
            if amount >= HOLD:
                yield from flush()
                amount = 0
        if amount:
            yield from flush()

    return step


def _merged(key: np.ndarray, *values: np.ndarray):
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)])


_TOTALS = "types long, total long, histogram array<long>"


def _merge(buckets: int):
    """One bucket's blocks of kind 0 or 1 to one block; kept bigrams and all tokens also give blocks of contexts (kind 2)."""

    def merge(t: pa.Table) -> pa.Table:
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        key, n = _merged(_joined(t, "keys", U), _joined(t, "counts", np.uint32).astype(np.int64))
        types, total = len(key), int(n.sum())
        if kind == 0:
            first = np.where(key == END, START, key) >> U(32)
            size, taken = n, np.zeros(len(n))
            grade = np.floor(4 * np.log2(n)).astype(np.int64)
        else:
            keep = n >= LEAST
            key, n = key[keep], n[keep]
            grade = levels(n)
            first, size, taken = context_of(key), np.zeros(len(n), np.int64), VALUES[grade] - DISCOUNT
        if len(key):
            mixed, size, taken = _merged(_mix(first + _M2), size.astype(np.float64), taken)
            rows = pa.Table.from_batches([_blocks(kind, key, buckets, n), _blocks(2, mixed, buckets, np.stack([size, taken], 1))])
        else:
            rows = pa.Table.from_batches([arrow(kind=pa.array([kind], pa.int32()), bucket=[bucket], keys=pa.array([b""], pa.binary()), counts=pa.array([b""], pa.binary()))])
        lead = len(rows) - 1
        rows = rows.append_column("types", pa.array([types] + [0] * lead, pa.int64())).append_column("total", pa.array([total] + [0] * lead, pa.int64()))
        return rows.append_column("histogram", pa.array([np.bincount(grade).tolist()] + [[]] * lead, pa.list_(pa.int64())))

    return merge


def _histogram(df: DataFrame) -> dict[int, int]:
    """Sum of the histograms of blocks; at most a few hundred grades."""
    got = df.select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return {r.pos: int(r.n) for r in got}


def _as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, most_bits: int = MOST_BITS) -> Model:
    """Counts over all rows of ``docs`` (null text: the end alone); no row is left out, and no count but of bigrams seen less than LEAST times."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    buckets = max(-(-int(size) // BUCKET_BYTES), 1)
    with small_batches(spark), tidy_shuffles(spark):
        merged = staged(text.mapInArrow(_counter(buckets), _BLOCK).groupBy("kind", "bucket").applyInArrow(_merge(buckets), f"{_BLOCK}, {_TOTALS}"))
    token_blocks, pair_blocks = merged.where("kind = 0"), merged.where("kind = 1")
    sums = token_blocks.agg(F.sum("types").alias("v"), F.sum("total").alias("n")).first()
    n, v = int(sums.n or 0), int(sums.v or 0)

    # the frequent tokens: all above the least grade that leaves no more than ``vocabulary``
    grades, room, least = _histogram(token_blocks), vocabulary, 0
    for g in sorted(grades, reverse=True):
        if grades[g] > room:
            least = g + 1
            break
        room -= grades[g]

    def counted(above: int):
        def step(batches):
            for b in batches:
                for i in range(b.num_rows):
                    key, c = np.frombuffer(b.column(0)[i].as_buffer(), U), np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                    on = np.floor(4 * np.log2(np.maximum(c, 1))) >= above
                    yield arrow(token=_as_long(key[on]), n=c[on])

        return step

    counts = token_blocks.select("keys", "counts").mapInArrow(counted(0), "token long, n long")
    top = token_blocks.select("keys", "counts").mapInArrow(counted(least), "token long, n long").toArrow()  # ``vocabulary`` rows at most
    names, c = top.column("token").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(names)
    names, c = names[order], c[order]

    contexts = merged.where("kind = 2").select("bucket", "keys", "counts")

    def pair_bits(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield _part(b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_buffer(), U), levels(np.frombuffer(b.column(2)[i].as_buffer(), np.int64)))

    part = "bucket long, bits binary, size long"
    with tidy_shuffles(spark):
        parts = staged(pair_blocks.select("bucket", "keys", "counts").mapInArrow(pair_bits, part)), staged(contexts.groupBy("bucket").applyInArrow(_context_part, part))
    held = lambda most: sum(p.where(F.col("bucket") < most).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for p in parts)
    here, need = buckets, held(buckets)
    while need > most_bits and here:  # as many parts as there is room for
        here = min(int(here * most_bits / need), here - 1)
        need = held(here)
    pairs, others = (_assembled(p.where(F.col("bucket") < here), here, buckets) for p in parts)
    mine = np.unique(np.r_[_mix((names >> U(32)) + _M2), _mix(np.array([START >> U(32)], U) + _M2)])
    size, taken, known = masses(others, mine)
    if not known.all():  # ``vocabulary`` + 1 rows at most
        asked = spark.createDataFrame([(int(x),) for x in mine[~known].view(np.int64)], "key long")
        got = {r.key: (r.size, r.taken) for r in _probed_masses(asked, parts[1], buckets).collect()}
        for i in np.flatnonzero(~known).tolist():
            size[i], taken[i] = got[int(mine[i : i + 1].view(np.int64)[0])]
    shared = spark.sparkContext.broadcast((names, c, mine, np.stack([size, taken], 1), (pairs.bits, pairs.base, buckets), (others.bits, others.base, buckets)))
    return Model(n, v, counts, token_blocks.select("bucket", "keys", "counts"), shared, parts, buckets, here)


def _context_part(t: pa.Table) -> pa.Table:
    """One bucket's blocks of contexts to its part: each that has bigrams has a number for its total and one for what they take.

    All entries of a context lie in its own bucket.  This is one step, for each Python step of a stage has processes of its
    own, and executors keep them and their memory.
    """
    mass = _joined(t, "counts", np.float64).reshape(-1, 2)
    key, size, taken = _merged(_joined(t, "keys", U), mass[:, 0], mass[:, 1])
    keep = taken > 0
    key, size, taken = key[keep], np.maximum(size[keep], taken[keep]), taken[keep]
    entries = zip(_digits(key ^ _CONTEXT_COUNT, _fine_level(size)), _digits(key ^ _CONTEXT_TAKEN, _fine_level(taken)), strict=True)
    part = _part(t.column("bucket")[0].as_py(), *(np.concatenate(x) for x in entries))
    return pa.Table.from_batches([part.slice(0, min(len(key), 1))])


def _part(bucket: int, key: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
    bits = np.zeros(part_bits(level), bool)
    insert(bits, key, level)
    return arrow(bucket=[bucket], bits=pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), size=[len(bits)])


#: A part without keys.
_EMPTY = np.packbits(np.zeros(64, bool)).tobytes()


def _assembled(parts: DataFrame, here: int, buckets: int) -> Filter:
    """The filter of the first ``here`` parts; their size was checked against the bound, and one part at a time comes to the driver."""
    by = {r.bucket: bytes(r.bits) for r in parts.toLocalIterator()}
    found = [by.pop(b, _EMPTY) for b in range(here)]
    return Filter(np.frombuffer(b"".join(found), np.uint8), np.r_[0, np.cumsum([8 * len(x) for x in found])].astype(np.int64), buckets)


def _probed(asked: DataFrame, parts: DataFrame, buckets: int, read, fields: str) -> DataFrame:
    """(key, fields) of distinct keys, read from the parts of their buckets: ``read`` takes a filter and keys and returns columns."""
    names = [x.split()[0] for x in fields.split(", ")]

    def placed(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            yield arrow(key=key, bucket=_bucket(key.view(U), buckets).astype(np.int64))

    def probe(keys: pa.Table, part: pa.Table) -> pa.Table:
        raw = np.frombuffer(part.column("bits")[0].as_py() if part.num_rows else _EMPTY, np.uint8)
        key = keys.column("key").to_numpy()
        got = read(Filter(raw, np.array([0, 8 * len(raw)], np.int64)), key.view(U))
        return pa.table({"key": key, **dict(zip(names, got, strict=True))})

    left = asked.mapInArrow(placed, "key long, bucket long")
    return left.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(probe, f"key long, {fields}")


def _probed_masses(asked: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    return _probed(asked, parts, buckets, lambda f, k: masses(f, k)[:2], "size double, taken double")


class _Known:
    """What was broadcast, and what it says of tokens."""

    def __init__(self, value: tuple):
        names, self.c, mine, mass, pair_parts, rare_parts = value
        self.words, self.contexts = Vocabulary(names), Vocabulary(mine)
        self.pairs, self.others = Filter(*pair_parts), Filter(*rare_parts)
        self.size, self.taken = np.r_[mass[:, 0], 1.0], np.r_[mass[:, 1], 0.0]

    def of(self, h: np.ndarray, sizes: np.ndarray) -> _Seen:
        """What it says of the tokens ``h`` of texts of these sizes."""
        one, back = np.unique(bigrams(h, sizes), return_inverse=True)
        context = _mix(context_of(one) + _M2)
        place = self.contexts.find(context)
        total, used = self.size[place], self.taken[place]
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            total[unknown], used[unknown], here = masses(self.others, context[unknown])
            total[unknown[~here]] = -1.0
        return _Seen(self.words.find(h), one, back, self.pairs.level(one), context, total, used)


#: What a worker process made of a broadcast; it goes as soon as Spark lets go of the broadcast.
_made: WeakKeyDictionary = WeakKeyDictionary()


def _known(shared) -> _Known:
    if shared not in _made:
        _made[shared] = _Known(shared.value)
    return _made[shared]


@dataclass
class _Seen:
    """Places of tokens in the vocabulary (-1: not in it), their distinct bigrams, and of each token the place of its bigram.

    Of each bigram: its level (-1: another part has it), its context, and that one's masses (total -1: likewise).
    """

    at: np.ndarray
    one: np.ndarray
    back: np.ndarray
    level: np.ndarray
    context: np.ndarray
    total: np.ndarray
    used: np.ndarray

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each bigram, the probability that the filter gives it, and what is left for unigrams in its context."""
        a = np.where((self.level > 0) & (self.used > 0), np.maximum(VALUES[np.maximum(self.level, 0)] - DISCOUNT, 0) / np.maximum(self.total, 1e-9), 0.0)
        return a, np.maximum(1 - self.used / np.maximum(self.total, 1e-9), 1e-3)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10 of the whole text).

    Null and empty texts are the end alone; repeated rows and null ids stay; an empty table gives no row; columns
    other than doc_id and text are ignored.  A model of no text gives every token the same probability.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = _by_blocks(src, model) if model.beyond else _by_rows(src, model)
    return got.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _norm(model: Model) -> float:
    return math.log10(model.n + 0.1 * (model.v + 1))


def _by_rows(src: DataFrame, model: Model) -> DataFrame:
    """Scores where the whole filter is broadcast; rare tokens' counts are joined."""
    norm, shared = _norm(model), model.shared

    def step(batches):
        known = _known(shared)
        base = np.r_[np.log10(known.c + 0.1), -1.0] - norm  # the last: a token that was never seen
        uni = 10.0**base
        for part, sizes, h in token_rows(batches):
            seen = known.of(h, sizes)
            at, back, (a, b) = seen.at, seen.back, seen.shares()
            starts = np.cumsum(sizes) - sizes
            found = at >= 0
            s = np.where(found, np.log10(np.minimum(a[back] + b[back] * uni[at], 1.0)), 0.0)
            add = lambda x: np.add.reduceat(x, starts)
            left = np.flatnonzero(~found)
            owner = np.searchsorted(starts, left, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
            k = back[left]
            fields = {"token": _as_long(h[left]), "a": pa.array(a[k]), "b": pa.array(b[k])}
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield arrow(doc_id=part.column(0), n_tokens=sizes, n_top=add(found.astype(np.int64)), base_top=add(np.where(found, base[at], 0.0)), score_top=add(s), rest=rest)

    got = src.mapInArrow(step, "doc_id long, n_tokens long, n_top long, base_top double, score_top double, rest array<struct<token:bigint,a:double,b:double>>")
    # the row number is fixed by writing the table
    with small_batches(src.sparkSession):
        got = staged(got.withColumn("row", F.monotonically_increasing_id()))
    rare = got.select("row", F.inline("rest")).join(model.counts.withColumnRenamed("n", "found"), "token", "left")
    k = F.coalesce("found", F.lit(0))
    uni = (k + 0.1) / 10**norm
    late = rare.select("row", (k > 0).cast("long").alias("known"), F.log10(uni).alias("logs"), F.log10(F.least(F.col("a") + F.col("b") * uni, F.lit(1.0))).alias("score"))
    sums = late.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "logs", "score")])
    some = lambda c, zero: F.coalesce(c, F.lit(zero))
    return got.join(sums, "row", "left").select("doc_id", "n_tokens", (F.col("n_top") + some("known", 0)).alias("n_known"), (F.col("base_top") + some("logs", 0.0)).alias("base_score"), (F.col("score_top") + some("score", 0.0)).alias("score"))


def _tokens_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each row, hashes of all) of a table of texts."""
    steps = [(sizes, h) for _, sizes, h in token_rows(t.select(["text"]).to_batches())]
    return tuple(np.concatenate(x) for x in zip(*steps, strict=True))


def _by_blocks(src: DataFrame, model: Model) -> DataFrame:
    """Scores where parts of the filter aren't broadcast: a chunk of texts asks for each token, bigram and context once.

    Questions and answers are sorted blocks, a row for each chunk and bucket, so that what is moved is the text, eight
    bytes for each distinct question of a chunk, and a byte for each answer on a bigram; no token becomes a row.
    """
    norm, buckets, shared = _norm(model), model.buckets, model.shared
    size = src.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    chunks = max(-(-int(size) // CHUNK_BYTES), 1)
    dealt = src.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def asked(seen: _Seen, h: np.ndarray):
        """What a chunk has to ask: tokens (kind 0), bigrams (1), contexts (2), in order."""
        return np.unique(h[seen.at < 0]), seen.one[seen.level < 0], np.unique(seen.context[seen.total < 0])

    def ask(t: pa.Table) -> pa.Table:
        sizes, h = _tokens_of(t)
        blocks = [_blocks(kind, key, buckets, np.zeros(0, np.uint8)).drop_columns("counts") for kind, key in enumerate(asked(_known(shared).of(h, sizes), h))]
        out = pa.Table.from_batches(blocks)
        return out.append_column("chunk", pa.array([t.column("chunk")[0].as_py()] * len(out), pa.int64()))

    def answer(keys: pa.Table, have: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({n: pa.array([], k) for n, k in (("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("found", pa.binary()))})
        kind = keys.column("kind")[0].as_py()
        a, b = (have.column(n)[0].as_py() if have.num_rows else None for n in ("a", "b"))
        if kind == 0:
            names, counts = np.frombuffer(a or b"", U), np.frombuffer(b or b"", np.int64)
        else:
            bits = np.frombuffer(a if a is not None else _EMPTY, np.uint8)
            part = Filter(bits, np.array([0, 8 * len(bits)], np.int64))
        out = []
        for raw in keys.column("keys"):
            key = np.frombuffer(raw.as_buffer(), U)
            if kind == 0:
                at = np.minimum(np.searchsorted(names, key), max(len(names) - 1, 0))
                found = np.where(names[at] == key, counts[at], 0) if len(names) else np.zeros(len(key), np.int64)
            elif kind == 1:
                found = part.level(key).astype(np.uint8)
            else:
                found = np.stack(_grades(part, key), 1).astype(np.int16)
            out.append(found.tobytes())
        return pa.table({"chunk": keys.column("chunk"), "kind": keys.column("kind"), "bucket": keys.column("bucket"), "found": pa.array(out, pa.binary())})

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, h = _tokens_of(t)
        known = _known(shared)
        seen = known.of(h, sizes)
        questions = asked(seen, h)
        got = {0: [], 1: [], 2: []}
        for kind, bucket, found in sorted(zip(*(answers.column(n).to_pylist() for n in ("kind", "bucket", "found")), strict=True)):
            got[kind].append(found)
        counts, level, grades = (np.frombuffer(b"".join(got[k]), t) for k, t in ((0, np.int64), (1, np.uint8), (2, np.int16)))
        grades = grades.reshape(-1, 2)
        if any(len(q) != len(x) for q, x in zip(questions, (counts, level, grades), strict=True)):
            raise ValueError("the texts to score must be the same each time they are read")
        seen.level[seen.level < 0] = level
        away = np.flatnonzero(seen.total < 0)
        seen.total[away], seen.used[away] = (x[np.searchsorted(questions[2], seen.context[away])] for x in _masses_of(grades[:, 0], grades[:, 1]))
        rare = np.flatnonzero(seen.at < 0)
        n = np.r_[known.c, 0][seen.at]
        n[rare] = counts[np.searchsorted(questions[0], h[rare])]
        logs = np.log10(n + 0.1) - norm
        a, b = seen.shares()
        p = np.log10(np.minimum(a[seen.back] + b[seen.back] * 10.0**logs, 1.0))
        add = lambda x: np.add.reduceat(x, np.cumsum(sizes) - sizes)
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": sizes, "n_known": add((n > 0).astype(np.int64)), "base_score": add(logs), "score": add(p)})

    questions = dealt.groupBy("chunk").applyInArrow(ask, "kind int, bucket long, keys binary, chunk long")
    table_of = lambda kind, df, a, b: df.select(F.lit(kind).alias("kind"), "bucket", F.col(a).alias("a"), b.alias("b"))
    none = F.lit(None).cast("binary")
    have = table_of(0, model.tokens, "keys", F.col("counts")).unionByName(table_of(1, model.parts[0], "bits", none)).unionByName(table_of(2, model.parts[1], "bits", none))
    with tidy_shuffles(src.sparkSession):  # the texts are shuffled again below: then the questions are gone
        answers = staged(questions.groupBy("kind", "bucket").cogroup(have.groupBy("kind", "bucket")).applyInArrow(answer, "chunk long, kind int, bucket long, found binary"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``; a null id is learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket("doc_id", 10) == 0, F.lit(False))
    out = score(docs, fit(docs.where(~held)))
    return out.withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_bloom": op8}
SQL: dict[str, str] = {}
