"""Verifier predicates over response columns.

Native expressions where Spark agrees with the exact semantics; the ``exact_*`` forms are Arrow-batched UDFs for
Python's own casefold, JSON equality and regular expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(x: Column, strip: bool = True) -> Column:
    """Something is left after stripping."""
    return F.coalesce(F.length(F.btrim(x, F.lit(" \t\n\r\f\x0b")) if strip else x) > 0, F.lit(False))


def exact(x: Column, expected: str, strip: bool = False, ignore_case: bool = False) -> Column:
    """Equality of strings, for text whose case folding is lower-casing."""
    v, e = x, expected
    if strip:
        v, e = F.btrim(v, F.lit(" \t\n\r\f\x0b")), e.strip()
    if ignore_case:
        v, e = F.lower(v), e.lower()
    return F.coalesce(v == e, F.lit(False))


def contains(x: Column, expected: str, ignore_case: bool = False) -> Column:
    """The expected text occurs."""
    return F.coalesce(F.contains(F.lower(x), F.lit(expected.lower())) if ignore_case else F.contains(x, F.lit(expected)), F.lit(False))


def full_match(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The whole text matches a pattern that both regex dialects read alike."""
    return F.coalesce(x.rlike(("(?i)" if ignore_case else "") + rf"\A(?:{pattern})\z"), F.lit(False))


def numeric(x: Column, expected: float, tolerance: float) -> Column:
    """A finite number within an absolute tolerance."""
    v = x.try_cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")) & (F.abs(v - expected) <= tolerance), F.lit(False))


def json_boolean(x: Column, path: str, expected: bool) -> Column:
    """A real boolean at the path of a JSON text; broken JSON and missing paths fail."""
    v = F.try_parse_json(x)
    at = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(at)
    return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == expected), F.lit(False))


def json_text(x: Column, path: str) -> Column:
    """The value at the path as text, null if there is none."""
    return F.try_variant_get(F.try_parse_json(x), path, "string")


def fenced_json(x: Column) -> Column:
    """The body of a fenced JSON block if it parses, else the text itself."""
    body = F.regexp_extract(x, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), F.btrim(body, F.lit(" \t\n\r"))).otherwise(x)


def _pairs(items):
    out = {}
    for k, v in items:
        if k in out:
            raise ValueError(f"key {k!r} twice")
        out[k] = v
    return out


def _no_constant(name):
    raise ValueError(f"{name} is no JSON")


def strict_json(text: str):
    """Parses JSON; duplicate keys and NaN or Infinity are errors."""
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant)


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, UTF-8 kept, finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def at_path(value, path: list):
    """(found, value) through objects and arrays; a missing part is told from null."""
    for p in path:
        if isinstance(value, dict) and isinstance(p, str) and p in value:
            value = value[p]
        elif isinstance(value, list) and isinstance(p, int) and not isinstance(p, bool) and 0 <= p < len(value):
            value = value[p]
        else:
            return False, None
    return True, value


def exact_json_field(path: list, expected):
    """Pandas UDF: the value at the path equals ``expected`` as canonical JSON, so 1 isn't 1.0 and true isn't 1."""
    want = canonical(expected)

    def one(text) -> bool:
        try:
            found, v = at_path(strict_json(text), path)
        except (ValueError, TypeError):
            return False
        return found and canonical(v) == want

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=bool), "boolean")


def exact_match(expected: str, strip: bool = False, ignore_case: bool = False):
    """Pandas UDF: equality with Python's strip and casefold."""

    def norm(x):
        x = x.strip() if strip else x
        return x.casefold() if ignore_case else x

    want = norm(expected)
    return F.pandas_udf(lambda s: pd.Series([x is not None and norm(x) == want for x in s], dtype=bool), "boolean")


def exact_full_match(pattern: str, ignore_case: bool = False):
    """Pandas UDF: full match in Python's dialect."""
    p = re.compile(pattern, re.I if ignore_case else 0)
    return F.pandas_udf(lambda s: pd.Series([x is not None and p.fullmatch(x) is not None for x in s], dtype=bool), "boolean")
