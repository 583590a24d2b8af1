"""Patch folds over file maps, content-addressed stores, and version lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import cut
from .checks import varying


class FoldError(ValueError):
    """A patch can't be applied exactly."""


def apply_patch(files: dict[str, str], operation: str, path: str, content: str, match: str | None) -> dict[str, str]:
    """``files`` after one patch: add (append a block once), drop, rewrite, compress (exact replacement of one match)."""
    out = dict(files)
    text = out.get(path)
    if operation == "add":
        block = content.strip("\n")
        have = (text or "").strip("\n")
        if block in have.split("\n\n") or have == block or f"\n\n{block}\n\n" in f"\n\n{have}\n\n":
            return out
        out[path] = f"{have}\n\n{block}\n" if have else block + "\n"
        return out
    if text is None:
        raise FoldError(f"{path} doesn't exist")
    if not match:
        raise FoldError("nothing to match")
    n = text.count(match)
    if n != 1:
        raise FoldError(f"the match occurs {n} times in {path}")
    new = "" if operation == "drop" else content
    if operation == "compress" and len(new) >= len(match):
        raise FoldError("a compression must be shorter")
    if operation not in ("drop", "rewrite", "compress"):
        raise FoldError(f"no operation {operation!r}")
    out[path] = text.replace(match, new)
    return out


def fold_patches(candidates: DataFrame, patches: DataFrame, files: dict[str, str]) -> DataFrame:
    """candidate_id, path, content, error: the base files after each candidate's patches, in order of (sequence, patch_id).

    ``candidates``: (candidate_id, patch_id); ``patches``: (patch_id, sequence, operation, target_path, content,
    match_text).  A candidate whose fold fails has one row with its error.  One task holds one candidate's patches.
    """
    import pandas as pd

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        state, error = dict(files), None
        for r in df.sort_values(["sequence", "patch_id"]).itertuples():
            try:
                state = apply_patch(state, r.operation, r.target_path, r.content or "", r.match_text)
            except FoldError as e:
                error = f"{r.patch_id}: {e}"
                break
        who = df["candidate_id"].iloc[0]
        if error:
            return pd.DataFrame([(who, None, None, error)], columns=["candidate_id", "path", "content", "error"])
        return pd.DataFrame([(who, p, c, None) for p, c in sorted(state.items())], columns=["candidate_id", "path", "content", "error"])

    j = candidates.select("candidate_id", "patch_id").join(patches, "patch_id")
    return j.groupBy("candidate_id").applyInPandas(fold, "candidate_id string, path string, content string, error string")


def replace_once(text, before, after):
    """Column: exact replacement if the match occurs once, else null."""
    n = (F.length(text) - F.length(F.replace(text, before, F.lit("")))) / F.length(before)
    return F.when(n == 1, F.replace(text, before, after))


def content_hashes(files: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key, content_hash of the sorted (path, content) pairs of each artifact."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "content")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["path"], F.lit("\0"), p["content"])), "\0\0")
    return files.groupBy(key).agg(F.sha2(text, 256).alias("content_hash"))


def store(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts once by content_hash, all derivations)."""
    return artifacts.select("content_hash", "content").dropDuplicates(["content_hash"]), artifacts.select("version_id", "parent_version_id", "content_hash")


def save(artifacts: DataFrame, path: str) -> None:
    """Writes contents once by their digest, and all derivations."""
    contents, lineage = store(artifacts)
    contents.write.mode("overwrite").parquet(f"{path}/contents")
    lineage.write.mode("overwrite").parquet(f"{path}/lineage")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contents, lineage) of a saved store; a digest that isn't its content's, a derivation without content, a missing parent or a cycle is an error."""
    contents, lineage = spark.read.parquet(f"{path}/contents"), spark.read.parquet(f"{path}/lineage")
    wrong = contents.where(F.sha2("content", 256) != F.col("content_hash")).select("content_hash")
    lost = lineage.join(contents, "content_hash", "left_anti").select("content_hash")
    odd = lineage_violations(lineage).where("problem <> 'content_drift'").select(F.col("version_id").alias("content_hash"))
    for what, found in (("contents that aren't their digest's", wrong), ("derivations without content", lost), ("broken lineage", odd)):
        if not found.isEmpty():
            raise ValueError(f"{what}: {[r.content_hash for r in found.limit(5).collect()]}")
    return contents, lineage


def ancestors(lineage: DataFrame) -> DataFrame:
    """(version_id, ancestor_id, least distance) at any depth by doubling, cycles included.

    Once all pairs up to a reach are known, those up to twice the reach are a pair at exactly the reach and one of the
    known pairs, for on a shortest path the version at the reach is no nearer than that.  So a round makes hardly more rows
    than it keeps; the last round finds no pair at exactly the reach.
    """
    paths = cut(lineage.where("parent_version_id is not null").select("version_id", F.col("parent_version_id").alias("ancestor_id"), F.lit(1).alias("distance")).distinct())
    reach = 1
    while not (jump := paths.where(F.col("distance") == reach)).isEmpty():
        a = jump.select("version_id", F.col("ancestor_id").alias("middle"))
        b = paths.toDF("middle", "ancestor_id", "far")
        longer = a.join(b, "middle").select("version_id", "ancestor_id", (F.lit(reach) + F.col("far")).alias("distance"))
        paths = cut(paths.unionByName(longer).groupBy("version_id", "ancestor_id").agg(F.min("distance").alias("distance")))
        reach *= 2
    return paths


def on_cycles(lineage: DataFrame) -> DataFrame:
    """version_id of all versions that are their own ancestor.

    Where no version has two parents, pointers to ancestors are doubled: after as many steps as there are versions, only
    versions that lead into a cycle still point anywhere, and they point to all of it.  That takes log n joins of one
    row a version, and no path is kept.  Else all ancestors are found.
    """
    edges = cut(lineage.where("parent_version_id is not null").select("version_id", F.col("parent_version_id").alias("to")).distinct())
    n = edges.count()
    if edges.groupBy("version_id").count().where("count > 1").isEmpty():
        steps = 1
        while steps < n:
            far = edges.select(F.col("version_id").alias("to"), F.col("to").alias("further"))
            edges = cut(edges.join(far, "to").select("version_id", F.col("further").alias("to")))
            steps *= 2
        return edges.select(F.col("to").alias("version_id")).distinct()
    return ancestors(lineage).where("version_id = ancestor_id").select("version_id")


def lineage_violations(lineage: DataFrame) -> DataFrame:
    """version_id, problem: missing_parent, cycle, or drift of a version's content."""
    missing = lineage.where("parent_version_id is not null").select("version_id", F.col("parent_version_id").alias("p")).join(lineage.select(F.col("version_id").alias("p")).distinct(), "p", "left_anti").select("version_id", F.lit("missing_parent").alias("problem"))
    cycle = on_cycles(lineage).select("version_id", F.lit("cycle").alias("problem"))
    drift = varying(lineage, ["version_id"], ["content_hash"]).select("version_id", F.lit("content_drift").alias("problem"))
    return reduce(DataFrame.unionByName, [missing, cycle, drift]).distinct()
