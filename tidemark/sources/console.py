"""The query console: read-only SQL over registered tables."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import table

READS = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(?:select|with|values|show|describe|explain)\b", re.I)


#: A statement up to its semicolon, which doesn't count inside quotes and comments.
STATEMENT = re.compile(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|[^;'\"`])+")


@dataclass
class Console:
    """Tables of a folder as views, worked examples, and run() for queries only."""

    spark: SparkSession
    examples: dict[str, str] = field(default_factory=dict)
    timings: list[tuple[str, float]] = field(default_factory=list)

    def register(self, folder: str, names: list[str]) -> None:
        for n in names:
            table(self.spark, folder, n).createOrReplaceTempView(n)

    def tables(self) -> dict[str, list[tuple[str, str]]]:
        return {t.name: self.spark.table(t.name).dtypes for t in self.spark.catalog.listTables() if t.isTemporary}

    def run(self, sql: str) -> DataFrame:
        """Result of the first statement; anything but a query is refused."""
        first = next((s for s in STATEMENT.findall(sql) if s.strip()), "")
        if not READS.match(first):
            raise ValueError("queries only")
        began = time.time()
        out = self.spark.sql(first)
        self.timings.append((first, time.time() - began))
        return out
