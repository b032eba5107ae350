"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.captures import Captures, captures, latest_rows
from tidemark.session import new_path


#: Keys looked at to cut the key space into ranges; they are drawn by hash.
SAMPLE = 10_000


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ, null equal to null only."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def merge_range(batches: Iterator[pa.RecordBatch], values: list[str], last: int) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of the snapshots of one key range.

    The range streams in sorted by (key, ordinal), so the lists of all
    snapshots advance together: one pointer stands on the previous row, one on
    the current row, and columns are compared as arrays. A key missing in the
    next list is 'removed' there, one missing in the list before is 'added',
    one in both is compared column by column. Only one row is held between
    batches.
    """
    names = ["ordinal", "key", "change"]

    def made(parts: list[tuple[np.ndarray, pa.Array, str]]) -> pa.RecordBatch:
        ords = np.concatenate([p[0] for p in parts]).astype(np.int32)
        keys = pa.concat_arrays([p[1].cast(pa.string()) for p in parts])
        what = pa.concat_arrays([pa.array([p[2]] * len(p[0]), pa.string()) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(ords), keys, what], names)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns)] if held is not None else batch.columns
        key, at, n = rows[0], rows[1].to_numpy(zero_copy_only=False), len(rows[0])
        before, after = (lambda c: c.slice(0, n - 1)), (lambda c: c.slice(1))
        follows = pc.equal(before(key), after(key)).to_numpy(zero_copy_only=False) & (at[1:] == at[:-1] + 1)
        pick = lambda c, where: c.take(pa.array(np.flatnonzero(where)))
        gone, new = ~follows & (at[:-1] < last), ~follows & (at[1:] > 0)
        parts = [(at[:-1][gone] + 1, pick(before(key), gone), "removed"), (at[1:][new], pick(after(key), new), "added")]
        if held is None and at[0] > 0:
            parts.append((at[:1], key.slice(0, 1), "added"))
        for name, c in zip(values, rows[2:]):
            changed = follows & _differs(before(c), after(c))
            parts.append((at[1:][changed], pick(after(key), changed), name))
        yield made(parts)
        held = [c.slice(n - 1) for c in rows]
    if held is not None and (at := held[1].to_numpy(zero_copy_only=False))[0] < last:
        yield made([(at + 1, held[0], "removed")])


def diff_snapshots(rows: DataFrame, known: Captures, values: list[str]) -> DataFrame:
    """(ordinal, key, change) for all consecutive pairs of snapshots.

    `rows` has one row per key and ordinal. One range partitioning by key and
    one sort inside the ranges serve all pairs; a key has at most one row per
    snapshot, so no range can be blown up by one key.
    """
    last = len(known.names) - 1
    ranged = rows.select("key", "ordinal", *values).repartitionByRange("key").sortWithinPartitions("key", "ordinal")
    return ranged.mapInArrow(lambda batches: merge_range(batches, values, last), "ordinal int, key string, change string")


@dataclass(frozen=True)
class KeptSnapshots:
    """Snapshots kept in the shared folder, each cut at the same keys into ranges and sorted in them.

    A delivery is cut and sorted once; only it and the snapshot before are
    read for the changes, whatever the length of the history.
    """

    spark: SparkSession
    bounds: tuple[str, ...]
    values: tuple[str, ...]
    paths: tuple[str, ...] = ()

    @staticmethod
    def empty(spark: SparkSession, first: DataFrame, values: list[str], ranges: int = 200) -> KeptSnapshots:
        """Ranges of about equal size, from SAMPLE keys of the first delivery drawn by hash."""
        drawn = sorted(r.key for r in first.where("key IS NOT NULL").select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect())
        cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
        return KeptSnapshots(spark, tuple(sorted(set(cuts))), tuple(values))

    def _range(self) -> Column:
        if not self.bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(b) for b in self.bounds]), lambda b: b <= F.col("key")))

    def add(self, rows: DataFrame) -> tuple[KeptSnapshots, DataFrame]:
        """Keep the next delivery, (key, values...) with one row per key; and its (key, change) against the one before."""
        path = new_path(self.spark, "snapshot")
        cut = rows.where("key IS NOT NULL").select("key", *self.values, self._range().alias("range"))
        cut.repartition("range").sortWithinPartitions("range", "key").write.option("compression", "zstd").partitionBy("range").parquet(path)
        kept = replace(self, paths=(*self.paths, path))
        if len(kept.paths) == 1:
            return kept, self.spark.createDataFrame([], "key string, change string")
        schema = cut.schema
        newest = None
        for i, p in enumerate(kept.paths[-2:]):
            one = self.spark.read.schema(schema).parquet(p).select("range", "key", F.lit(i).alias("ordinal"), *self.values)
            newest = one if newest is None else newest.unionByName(one)
        sorted_ = newest.repartition("range").sortWithinPartitions("key", "ordinal").select("key", "ordinal", *self.values)
        values = list(self.values)
        return kept, sorted_.mapInArrow(lambda batches: merge_range(batches, values, 1), "ordinal int, key string, change string").select("key", "change")


def changed_values(rows: DataFrame, known: Captures, values: list[str]) -> DataFrame:
    """(ordinal, key, field, was, now) for every field that differs between a snapshot and the one before; nulls are values."""
    per_key = Window.partitionBy("key").orderBy("ordinal")
    now = F.struct(*values)
    x = rows.select("key", "ordinal", now.alias("now"), F.lag("ordinal").over(per_key).alias("before"), F.lag(now).over(per_key).alias("was"))
    fields = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"was.{v}").alias("was"), F.col(f"now.{v}").alias("now")) for v in values])
    return x.where("before = ordinal - 1").select("ordinal", "key", F.inline(fields)).where("NOT was <=> now")


def changes(people: DataFrame, sources: DataFrame | None = None, key: str = "id", values: tuple[str, ...] = ("name", "role", "org")) -> tuple[DataFrame, Captures]:
    known = captures(people, sources)
    rows = latest_rows(people, known, key, list(values))
    return diff_snapshots(rows, known, list(values)), known


def stale_flags(nodes: DataFrame, rows: DataFrame, known: Captures) -> DataFrame:
    """(key): persons ever listed whose node's no_longer_listed disagrees with the last list.

    Of several rows of a node the one recorded first counts; a null flag is 0;
    nodes of other types and persons never listed give no row.
    """
    listed = rows.groupBy("key").agg(F.max("ordinal").alias("_last"))
    flag = (
        nodes.where((F.col("type") == "Person") & F.col("id").startswith("person:"))
        .groupBy("id")
        .agg(F.min(F.struct(F.col("recorded").isNull().alias("n"), F.col("recorded").alias("r"), F.coalesce(F.col("no_longer_listed"), F.lit(0)).alias("f"))).alias("_f"))
        .select(F.expr("substring(id, 8)").alias("key"), F.col("_f.f").alias("_flag"))
    )
    gone = F.col("_last") < len(known.names) - 1
    return flag.join(listed, "key").where((F.col("_flag") == 1) != gone).select("key")


def snapshot_changes(people: DataFrame, sources: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(to_snapshot, person, change), with 'stale_flag' rows at the last capture.

    Empty people give no rows; the first capture reports nothing.
    """
    values = ["name", "role", "org"]
    known = captures(people, sources)
    rows = latest_rows(people, known, "id", values)
    diff = diff_snapshots(rows, known, values).select(known.name_at(F.col("ordinal")).alias("to_snapshot"), F.col("key").alias("person"), "change")
    stale = stale_flags(nodes, rows, known).select(F.lit(known.names[-1] if known.names else None).alias("to_snapshot"), F.col("key").alias("person"), F.lit("stale_flag").alias("change"))
    return diff.unionByName(stale)
