"""Ranks of the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY = ("info", "low", "medium", "high")
CONFIDENCE = ("unknown", "low", "medium", "high", "confirmed")


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in ``order``, from 0; null for other values."""
    return F.create_map(*(x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))))[column]


def value(rank_column: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, order)), rank_column)
