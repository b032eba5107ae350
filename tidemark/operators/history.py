"""History of changing attributes: versions with the days between which each one held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.captures import Captures, captures, latest_rows

WORD = 64


def _ordinals(words: list[Column]) -> Column:
    """Positions of the set bits of a bitmap held in words, ascending."""

    def of(w: int, word: Column) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(word, i) == 1)
        return F.transform(bits, lambda i: i + F.lit(w * WORD))

    return F.concat(*[of(w, word) for w, word in enumerate(words)])


def versions(rows: DataFrame, known: Captures, values: list[str]) -> DataFrame:
    """(key, values..., first, last): one row per unbroken run of captures with the same values.

    `rows` has one row per key and capture ordinal. Each distinct (key, values)
    gets a presence bitmap, one bit per capture, by bit_or of single bits
    (map-side combined, 8 bytes per 64 captures); runs of consecutive bits are
    the versions, so gaps close a version and a return opens a new one. Null is
    a value of its own. Grouping is on the values themselves beside their hash,
    so a hash collision can't merge two versions.
    """
    n_words = max(1, -(-len(known.names) // WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ordinal") % WORD).cast("int"))
    maps = rows.groupBy("key", F.xxhash64(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values]).alias("_h"), *values).agg(
        *[F.bit_or(F.when(F.floor(F.col("ordinal") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(n_words)]
    )
    at = maps.withColumn("_o", _ordinals([F.col(f"_w{w}") for w in range(n_words)]))
    starts = F.filter("_o", lambda x, i: (i == 0) | (F.get(F.col("_o"), i - 1) != x - 1))
    ends = F.filter("_o", lambda x, i: (i == F.size("_o") - 1) | (F.get(F.col("_o"), i + 1) != x + 1))
    runs = at.select("key", *values, F.explode(F.arrays_zip(starts.alias("first"), ends.alias("last"))).alias("_r"))
    return runs.select("key", *values, F.col("_r.first").alias("first"), F.col("_r.last").alias("last"))


def history(people: DataFrame, sources: DataFrame, key: str = "id", values: tuple[str, ...] = ("role", "org")) -> DataFrame:
    """(key, values..., valid_from, valid_to) with days; valid_to is '' for versions that still hold.

    Empty input gives no rows; see captures() and latest_rows() for nulls, ties
    and late rows.
    """
    known = captures(people, sources)
    runs = versions(latest_rows(people, known, key, list(values)), known, list(values))
    return runs.select(
        "key",
        *values,
        known.day_at(F.col("first")).alias("valid_from"),
        F.when(F.col("last") == len(known.names) - 1, F.lit("")).otherwise(known.day_at(F.col("last") + 1)).alias("valid_to"),
    )
