"""Ordered rules: the first failing one names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def first_failing(rules: list[Rule]) -> Column:
    """Reason of the first rule whose condition holds, null if none does."""
    chain = None
    for reason, fails in rules:
        chain = F.when(fails, F.lit(reason)) if chain is None else chain.when(fails, F.lit(reason))
    return chain if chain is not None else F.lit(None).cast("string")
