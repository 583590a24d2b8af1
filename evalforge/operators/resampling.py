"""Block bootstrap by a splittable multinomial tree.

A replicate draws as many blocks of a stratum as it has, with replacement.  Instead of
one row a draw, the number of draws that fall into a range of places comes from binomial
splits down a binary tree over the stratum, each from a generator that the seed, the
stratum and the range name; at ``LEAF`` places the draws themselves are made.  So any
task can tell the multiplicities of its own range for all replicates, whatever the other
tasks do, and what it sends are sums: replicates x statistics for each candidate and group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import numbered
from .bootstrap import metrics
from .objectives import BLOCK, base_passed, passed

#: Places of a leaf of the tree, and sums that a task holds before it sends them.
LEAF, HELD = 1024, 400
STATS = ("n", "c", "b", "f", "tok")


def _generator(*name) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(map(str, name)).encode()).digest()[:16], "big")))


def leaf_draws(seed: int, stratum: str, size: int, replicates: int, leaf: int) -> np.ndarray:
    """For each replicate, how many of its ``size`` draws fall into a leaf."""
    low, high = 0, -(-size // LEAF)
    left = np.full(replicates, size, np.int64)
    places = lambda a, b: min(b * LEAF, size) - a * LEAF
    while high - low > 1:
        mid = (low + high) // 2
        below = _generator(seed, stratum, size, low, high).binomial(left, places(low, mid) / places(low, high))
        if leaf < mid:
            left, high = below, mid
        else:
            left, low = left - below, mid
    return left


def weights(seed: int, stratum: str, size: int, replicates: int, leaf: int) -> np.ndarray:
    """Replicates x places of a leaf: how often each block is drawn."""
    here = min(LEAF, size - leaf * LEAF)
    n = leaf_draws(seed, stratum, size, replicates, leaf)
    out = np.zeros((replicates, here))
    draw = _generator(seed, stratum, size, leaf)
    for at in range(0, replicates, 256):  # memory stays bounded
        k = n[at : at + 256]
        cell = np.repeat(np.arange(len(k)) * here, k) + draw.integers(0, here, int(k.sum()), dtype=np.int32)
        out[at : at + 256] = np.bincount(cell, minlength=len(k) * here).reshape(len(k), here)
    return out


def _summer(seed: int, replicates: int):
    """Over blocks sorted by (stratum, size, leaf): weighted sums of each candidate, split and group for all replicates."""

    def step(batches):
        key, w, sums = None, None, {}

        def sent():
            for at in range(0, len(sums), 16):
                part = list(sums.items())[at : at + 16]
                flat = [pa.array([v[:, j].astype(np.int64).tolist() for _, v in part], pa.list_(pa.int64())) for j in range(len(STATS))]
                names = [pa.array([k[i] for k, _ in part], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*names, *flat], ["candidate_id", "split", "grp", *STATS])

        for b in batches:
            strata, sizes, places, who = (b.column(i).to_pylist() for i in range(4))
            blocks = b.column(4).to_pylist()
            stats: dict[tuple, dict[int, np.ndarray]] = {}

            def folded(stats=stats):
                for k, by in stats.items():
                    got = w[:, list(by)] @ np.array(list(by.values()))
                    sums[k] = sums[k] + got if k in sums else got
                stats.clear()

            for stratum, size, place, name, rows in zip(strata, sizes, places, who, blocks, strict=True):
                now = (stratum, size, place // LEAF)
                if now != key:
                    if key is not None:
                        folded()
                    key, w = now, weights(seed, stratum, size, replicates, place // LEAF)
                at = place % LEAF
                for r in rows:
                    own = stats.setdefault((name, r["split"], r["grp"]), {})
                    one = np.array([r[s] for s in STATS], float)
                    own[at] = own[at] + one if at in own else one
            folded()
            if len(sums) > HELD:
                yield from sent()
                sums = {}
        yield from sent()

    return step


def samples(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """What ``bootstrap.samples`` gives, with the same law, by the tree: work is blocks x replicates in tasks of any number."""
    row = F.struct("split", F.col("grp").alias("grp"), F.lit(1).cast("long").alias("n"), passed().cast("long").alias("c"), base_passed().cast("long").alias("b"), (base_passed() & ~passed()).cast("long").alias("f"), (F.col("input_tokens") + F.col("output_tokens")).alias("tok"))
    sign = F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "split", "target_id", F.coalesce("grp", F.lit(""))))), ";"))
    blocks = pairs.groupBy("candidate_id", *BLOCK).agg(sign.alias("stratum"), F.collect_list(row).alias("rows"))
    placed = numbered(blocks, ["candidate_id", "stratum"], BLOCK)
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    leaf = F.floor(F.col("place") / LEAF)
    dealt = placed.withColumn("leaf", leaf).repartition(parts, "stratum", "size", "leaf").sortWithinPartitions("stratum", "size", "leaf").select("stratum", "size", "place", "candidate_id", "rows")
    kinds = ", ".join(f"{s} array<long>" for s in STATS)
    sent = dealt.mapInArrow(_summer(seed, replicates), f"candidate_id string, split string, grp string, {kinds}")
    each = sent.select("candidate_id", "split", "grp", F.posexplode(F.arrays_zip(*STATS)).alias("replicate", "x")).select("candidate_id", "split", "grp", "replicate", "x.*")
    by_group = each.groupBy("candidate_id", "replicate", "split", "grp").agg(*[F.sum(s).alias(s) for s in STATS])
    return metrics(by_group, pairs)
