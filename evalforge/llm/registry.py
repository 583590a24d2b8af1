"""Queries of the training-data operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "quality", "fingerprint", "rules", "packing", "extract", "toxicity", "lm", "simhash", "chat", "phrases", "codes", "urls")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    """Name to (spark, sf_dir) -> DataFrame."""
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL; operators that SQL can't express have none and are tested in tests/llm."""
    return _all("SQL")
