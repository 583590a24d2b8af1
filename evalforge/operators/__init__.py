"""Relational and statistical operators: DataFrames in, DataFrame out."""
