"""Evidence scores, outcome tables, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STRENGTHS = {"weak": 10, "moderate": 35, "strong": 70, "exact": 100}


def strength_score(strength: Column) -> Column:
    """exact 100, strong 70, moderate 35, anything else 10."""
    return F.when(strength == "exact", 100).when(strength == "strong", 70).when(strength == "moderate", 35).otherwise(10)


def evidence_score(strength: str = "strength", stance: str = "stance") -> Column:
    """Sum over supporting evidence; 0 without any."""
    return F.coalesce(F.sum(F.when(F.col(stance) == "supports", strength_score(F.col(strength)))), F.lit(0))


def least_of(a: Column, b: Column) -> Column:
    """Null if either is: not what least() does."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest_of(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def status_outcome(code: Column) -> Column:
    return (
        F.when(code.between(200, 299), "success")
        .when(code.isin(404, 410), "unavailable")
        .when(code.isin(401, 403), "authentication_failed")
        .when(code == 429, "rate_limited")
        .when(code >= 500, "transient_failure")
        .otherwise("permanent_failure")
    )


def backoff_seconds(attempt: Column, jitter: Column, base: float = 1.0) -> Column:
    """base * 2**attempt, stretched by 0.7 to 1.5 as jitter goes from 0 to 1."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt) * (F.lit(0.7) + jitter * 0.8)


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value
