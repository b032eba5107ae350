"""Tables kept between increments in hash buckets, of which an increment reads and writes those it touches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path

#: Buckets of a table by default; a large one takes so many that a bucket fits a few tasks.
BUCKETS = 16


@dataclass(frozen=True)
class Bucketed:
    """A table in the shared folder, in hash buckets of its key columns; a new version shares the buckets without changes."""

    spark: SparkSession
    name: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    paths: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold or would hold the keys of `rows`; at most `buckets` numbers."""
        return [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def read(self, which: list[int] | None = None) -> DataFrame:
        paths = [p for b, ps in self.paths.items() if which is None or b in which for p in ps]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> dict[int, str]:
        path = new_path(self.spark, self.name)
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names, self.bucket().alias("bucket")).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        found = self.spark.read.schema(self.schema + ", bucket int").parquet(path).select("bucket").distinct().collect()
        return {r.bucket: f"{path}/bucket={r.bucket}" for r in found}

    def with_buckets(self, rows: DataFrame, which: list[int]) -> Bucketed:
        """The version whose buckets `which` hold `rows` and nothing else."""
        if not which:
            return self
        kept = {b: p for b, p in self.paths.items() if b not in which}
        return replace(self, paths={**kept, **{b: (p,) for b, p in self._written(rows).items()}})

    def appended(self, rows: DataFrame) -> Bucketed:
        """The version with `rows` beside what is there; nothing is read or written again."""
        new = self._written(rows)
        return replace(self, paths={b: self.paths.get(b, ()) + ((new[b],) if b in new else ()) for b in {*self.paths, *new}})
