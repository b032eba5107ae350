"""Equi-joins whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is split into parts of about as many; there can be at most (rows / HOT_ROWS) such keys.
HOT_ROWS = 200_000
#: So many hot keys (of about 100 bytes) are broadcast at most; beyond that they are joined by shuffle.
MAX_BROADCAST_KEYS = 50_000


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join where single keys of `many` may hold a third of the rows; `one` has one row per key.

    Counts rows per key with map-side combine (one small shuffle), then spreads
    the rows of hot keys over as many partitions as their number needs and
    copies only the matching rows of `one` as often. All rows of `many` stay; null keys match nothing.
    """
    hot = many.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    n_hot = hot.limit(MAX_BROADCAST_KEYS + 1).count()
    if n_hot == 0:
        return many.join(one, keys, how)
    mark = F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.col("_parts"))).otherwise(F.lit(0))
    left = many.join(mark, keys, "left").withColumn("_salt", salt.cast("int")).drop("_parts")
    copies = F.when(F.col("_parts").isNotNull(), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(0)))
    right = one.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
