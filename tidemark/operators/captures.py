"""Full captures of a keyed list: the captures in order, and the row that counts for a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.instants import iso_micros, utc_day

#: Captures are folders written a few times a month; more than this is a wrong column, not a long history.
MAX_CAPTURES = 100_000


@dataclass(frozen=True)
class Captures:
    """The captures in order (byte order of their names), with the day of each."""

    names: list[str]
    days: list[str | None]

    def day_at(self, ordinal: Column) -> Column:
        """Day of an ordinal; null beyond the last capture."""
        if not self.days:
            return F.lit(None).cast("string")
        days = F.array(*[F.lit(d).cast("string") for d in self.days])
        return F.get(days, ordinal.cast("int"))

    def name_at(self, ordinal: Column) -> Column:
        if not self.names:
            return F.lit(None).cast("string")
        return F.get(F.array(*[F.lit(n) for n in self.names]), ordinal.cast("int"))

    def frame(self, spark) -> DataFrame:
        """(capture, ordinal): one row per capture, so its size is the number of captures."""
        return spark.createDataFrame(list(zip(self.names, range(len(self.names)))), "capture string, ordinal int")


def captures(people: DataFrame, sources: DataFrame | None = None, snapshot: str = "snapshot", page: str = "speakers", state: str = "primary") -> Captures:
    """Distinct values of `snapshot` in order, each with the UTC day its page was retrieved.

    One row per capture reaches the driver. Without `sources` the days are the
    names themselves. Null snapshots are no captures. A capture without a
    matching source row has a null day; of several, the earliest counts.
    """
    rows = people.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("capture")).distinct().limit(MAX_CAPTURES + 1).collect()
    names = sorted((r.capture for r in rows), key=lambda s: s.encode())
    if len(names) > MAX_CAPTURES:
        raise ValueError(f"more than {MAX_CAPTURES} captures")
    if sources is None:
        return Captures(names, list(names))
    day = (
        sources.where((F.col("page") == page) & (F.col("state") == state))
        .groupBy("snapshot")
        .agg(utc_day(F.min(iso_micros(F.col("retrieved")))).alias("day"))
    )
    of = {r.snapshot: r.day for r in day.collect() if r.snapshot in set(names)}
    return Captures(names, [of.get(n) for n in names])


def latest_rows(people: DataFrame, known: Captures, key: str, values: list[str], snapshot: str = "snapshot", loaded: str = "loaded") -> DataFrame:
    """(key, ordinal, values...): for each key and capture the row loaded last.

    Rows without key or snapshot are left out. Ties on `loaded` are settled by
    the greatest values in column order, nulls lowest, so the result doesn't
    depend on the order of the input. Extra columns are ignored. A key that
    holds many rows is reduced map-side before it moves.
    """
    rows = people.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(key).alias("key"), F.col(snapshot).alias("capture"), F.struct(F.col(loaded).alias("_l"), *[F.col(v).alias(v) for v in values]).alias("_r")
    )
    best = rows.join(F.broadcast(known.frame(people.sparkSession)), "capture").groupBy("key", "ordinal").agg(F.max("_r").alias("_b"))
    return best.select("key", "ordinal", *[F.col("_b")[v].alias(v) for v in values])
