"""Canonical JSON and digests as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.verify import canonical, strict_json


def canonical_json(c: str | Column) -> Column:
    """Canonical form of a JSON text; null if it isn't strict JSON.  A pandas UDF, for Spark has no canonical JSON."""

    def one(x):
        try:
            return canonical(strict_json(x))
        except (ValueError, TypeError):
            return None

    return F.pandas_udf(lambda s: s.map(one), "string")(c)


def stable_hash(json_text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(json_text), 256)


def digest(value) -> str:
    """SHA-256 of a Python value's canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def is_sha256(c: Column) -> Column:
    """64 lower-case hex digits."""
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def normal_path(c: Column) -> Column:
    """POSIX path without "." parts; null if it is absolute, empty or leaves its root."""
    p = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"(?:(?<=/)|\A)(?:\./)+", ""), "/+", "/")
    return F.when(p.rlike(r"\A/|\A\s*\z|(?:\A|/)\.\.(?:/|\z)|\A[A-Za-z]:"), None).otherwise(F.regexp_replace(p, r"/\.?\z", ""))


def newline_normal(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of a part, not overlapping."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def whole_block(text: Column, block: Column) -> Column:
    """Whether the block stands in the text between blank lines or its ends."""
    gap = F.lit("\n\n")
    return (text == block) | F.startswith(text, F.concat(block, gap)) | F.endswith(text, F.concat(gap, block)) | F.contains(text, F.concat(gap, block, gap))
