"""Gates: queries that must return no rows, as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A rule: its number, what it says, and the rows that break it as (subject, detail)."""

    number: str
    says: str
    breaks: Callable[[SparkSession, str], DataFrame]


def run(gates: list[Gate], spark: SparkSession, where: str) -> DataFrame:
    """(gate, says, violations): counts of all gates, one aggregate per gate."""
    out = None
    for g in gates:
        n = g.breaks(spark, where).agg(F.count("*").alias("violations")).select(F.lit(g.number).alias("gate"), F.lit(g.says).alias("says"), "violations")
        out = n if out is None else out.unionByName(n)
    return out
