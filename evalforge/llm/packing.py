"""Packing by cutting-stock column generation.

Documents are tokenised once and gathered into blocks of bounded size, each packed
where it was read, without a shuffle.  Whole sequences are cut off long documents;
the rest lengths of a block form a histogram of classes.  A linear program over
cutting patterns (Gilmore and Gomory, 1961) is solved by column generation: a
knapsack dynamic program prices the next pattern from the dual values.  Patterns
are rounded down and dealt to the documents ranked by length.  Short documents are kept
back and fill the slack of the patterns whole, where one, two or three of them fit
exactly.  Only what is left over is cut, to fill the remaining slack and then whole
sequences; the block's last incomplete one becomes sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, pieces, table

LENGTH, CLASSES, END_ID = 4096, 64, 2
#: A block is packed once it holds so many ids (one document more at most).
BLOCK_IDS = 3_000_000
#: Rest lengths up to this are kept back to fill slack.
SHORT = 512
#: Words that a worker remembers lately; as many older ones are kept, and forgotten if they don't come again.
REMEMBERED = 300_000
#: How this vocabulary's file splits a text (fixed values).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these code points are their own NFC form, are lower-cased code point by code point, and have plain white space only.
_PLAIN = regex.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ]*").fullmatch

#: Texts by which a vocabulary shows whether it splits texts as _PIECE does.
_PROBES = ("Hello, World!! it's 42 DON'T we've ''s", "  two  spaces\n\nlines\tand 1234 5.6%%% foo### $$$ ", "Équeê straße ñandú x_y a-b (c) [d] e@f.g", "I'LL they'd 'tis UPPER lower 3x x3 ... --")


def default_tokenizer() -> str:
    """Path of the public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Lower-cased whitespace-separated word to its ids (little-endian 16 bits), remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.older: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.kind = "<u2" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        # the shortcut holds for vocabularies that split as this one does; others are asked for whole texts
        self.plain = all(np.array_equal(self._by_words(x), self._whole(x)) for x in _PROBES)

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            pieces_ = [word] if word.isalpha() else _PIECE.findall(word)
            out = self._piece(word) if pieces_ == [word] else b"".join(map(self._part, pieces_))
        self[word] = out
        return out

    def _part(self, piece: str) -> bytes:
        """A piece of a longer word; often a word that is known."""
        out = self.get(piece)
        return self._piece(piece) if out is None else out

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(piece)], self.kind).tobytes()

    def _by_words(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), self.kind)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)

    def ids(self, text: str) -> np.ndarray:
        """The tokenizer's ids of a whole text."""
        return self._by_words(text) if self.plain and _PLAIN(text) else self._whole(text)


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One per worker process, kept from task to task."""
    return Words(path)


def patterns(demand: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Cutting patterns (columns: pieces of each class) and how often to use each, by column generation.

    ``demand[c]`` pieces of c + 1 units are to be cut from stock of ``len(demand)`` units, with the least stock.
    """
    n = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((n, 0), int), np.zeros(0)
    units, need = used + 1, demand[used].astype(float)
    basis = np.diag((n // units).astype(float))
    amount = need / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)  # duals: every pattern costs one
        best, pick = np.zeros(n + 1), np.full(n + 1, -1)
        for room in range(1, n + 1):
            fits = np.searchsorted(units, room, side="right")
            best[room] = best[room - 1]
            if fits:
                value = price[:fits] + best[room - units[:fits]]
                top = int(value.argmax())
                if value[top] > best[room] + 1e-12:
                    best[room], pick[room] = value[top], top
        if best[n] <= 1 + 1e-7:
            break
        column, room = np.zeros(len(units)), n
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= units[pick[room]]
        change = inverse @ column
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        basis[:, out] = column
    full = np.zeros((n, len(units)), int)
    full[used] = basis.round().astype(int)
    return full, amount


class Shelf:
    """Short documents by length, taken to fill gaps exactly."""

    def __init__(self, docs: np.ndarray, rest: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for d in docs[np.lexsort((docs, rest[docs]))][::-1].tolist():
            self.by.setdefault(int(rest[d]), []).append(d)
        self.count = np.zeros(max(self.by, default=0) + 1, np.int64)
        for n, ds in self.by.items():
            self.count[n] = len(ds)

    def _take(self, n: int) -> int:
        self.count[n] -= 1
        return self.by[n].pop()

    def _pair(self, gap: int) -> tuple[int, ...] | None:
        """Lengths, one or two, that add up to the gap."""
        top = len(self.count) - 1
        if 0 < gap <= top and self.count[gap]:
            return (gap,)
        low = np.arange(max(gap - top, 1), gap // 2 + 1)
        if len(low):
            ok = (self.count[low] > 0) & (self.count[gap - low] > (low == gap - low))
            if ok.any():
                a = int(low[ok.argmax()])
                return a, gap - a
        return None

    def fill(self, gap: int) -> list[int]:
        """Documents that fill the gap exactly, or none."""
        top, out = len(self.count) - 1, []
        have = np.flatnonzero(self.count)
        while gap > 2 * top and len(have):  # the longest first while the gap is wide
            out.append(self._take(int(have[-1])))
            gap -= int(have[-1])
            have = np.flatnonzero(self.count)
        found = self._pair(gap) if gap > 0 else ()
        if found is None:
            for n in have[::-1].tolist():
                if n < gap:
                    self.count[n] -= 1
                    found = self._pair(gap - n)
                    self.count[n] += 1
                    if found:
                        found = (n, *found)
                        break
        return out + [self._take(n) for n in found or ()]

    def left(self) -> list[int]:
        """What nobody took, the longest last."""
        return [d for n in sorted(self.by) for d in self.by[n]]


def pack(lengths: np.ndarray, length: int = LENGTH, classes: int = CLASSES) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each id of each document once."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(lengths >= length).tolist():
        for k in range(int(lengths[d]) // length):
            out.append((d, k * length, length, sequence, 0))
            sequence += 1
    rest = lengths % length
    have = np.flatnonzero(rest)
    if not len(have):
        return out
    width = length // classes
    small = rest[have] <= min(SHORT, length // 8)
    long_ = have[~small]
    kind = (rest[long_] + width - 1) // width - 1
    form, amount = patterns(np.bincount(kind, minlength=classes))
    ranked = long_[np.lexsort((long_, -rest[long_], kind))]  # by class, longest first
    bounds = np.searchsorted(np.sort(kind), np.arange(classes + 1))
    queues = [ranked[bounds[c] : bounds[c + 1]].tolist()[::-1] for c in range(classes)]
    bins: list[list[int]] = []
    for j in np.argsort(-amount, kind="stable").tolist():
        for _ in range(int(amount[j] + 1e-6)):
            bins.append([queues[c].pop() for c in np.flatnonzero(form[:, j]).tolist() for _ in range(form[c, j]) if queues[c]])
    shelf = Shelf(have[small], rest)
    for b in bins:
        b += shelf.fill(length - int(rest[b].sum()))
    free = [d for q in queues for d in q] + shelf.left()
    rest_of = rest.tolist()
    slack = sum(length - sum(rest_of[d] for d in b) for b in bins)
    pool = sum(rest_of[d] for d in free)
    while bins and pool < slack:  # too little to fill with: the last patterns are cut up as well
        gone = bins.pop()
        size = sum(rest_of[d] for d in gone)
        free += gone
        pool += size
        slack -= length - size
    free = [[d, int(lengths[d]) - rest_of[d], rest_of[d]] for d in free][::-1]

    def fill(at: int, room: int):
        nonlocal sequence
        while room and free:
            item = free[-1]
            n = min(room, item[2])
            out.append((item[0], item[1], n, sequence, at))
            item[1] += n
            item[2] -= n
            at += n
            room -= n
            if not item[2]:
                free.pop()

    for b in bins:
        at = 0
        for d in b:
            out.append((d, int(lengths[d]) - rest_of[d], rest_of[d], sequence, at))
            at += rest_of[d]
        fill(at, length - at)
        sequence += 1
    left = pool - slack
    while left > 0:
        n = length if left >= length else 1 << (left.bit_length() - 1)
        fill(0, n)
        sequence += 1
        left -= n
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the ids.

    Null and empty texts are documents of the end id alone; null ids and repeated rows are packed like any other;
    an empty table gives no row; other columns of ``docs`` are ignored, whatever their names.  Sequence ids are
    unique: the partition's number and a count within it.
    """
    path = tokenizer or default_tokenizer()

    def step(batches):
        known = words(path)
        end = np.array([end_id], known.kind)
        base = TaskContext.get().partitionId() << 40
        held_id: list = []
        held: list[np.ndarray] = []
        total = 0

        def block():
            nonlocal base
            got = pack(np.array([len(x) for x in held], np.int64))
            crc, parts = [], []
            for d, start, n, _, _ in got:
                piece = held[d][start : start + n]
                crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                if ids:
                    parts.append(piece.astype(np.int32))
            cols = list(zip(*got, strict=True))
            out = {"doc_id": pa.array([held_id[d] for d in cols[0]], pa.int64()), "start": cols[1], "length": cols[2], "ids_crc32": crc, "doc_tokens": [len(held[d]) for d in cols[0]], "sequence_id": [base + s for s in cols[3]], "offset": cols[4]}
            base += max(cols[3]) + 1
            return arrow(**out, **({"ids": parts} if ids else {}))

        for part, texts in pieces(batches):
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                held_id.append(doc)
                held.append(np.concatenate([known.ids(text or ""), end]))
                total += len(held[-1])
                if total >= BLOCK_IDS:
                    yield block()
                    held_id, held, total = [], [], 0
        if held:
            yield block()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(step, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing_cutting_stock": op5}
SQL: dict[str, str] = {}
