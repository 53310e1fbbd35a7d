"""Deriving columns in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(d: DataFrame, kept: list[str], new: dict[str, Column]) -> DataFrame:
    """d with the kept columns and the new ones behind a generator, through which the optimizer pushes no filter:
    it would otherwise write the whole derivation out again in every condition on a new column."""
    return d.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(name) for name, c in new.items()]))))
