"""References to records that don't exist (yet, or any more), kept up incrementally."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.instants import iso_micros, micros, utc_month
from tidemark.operators.buckets import BUCKETS, Bucketed
from tidemark.operators.skew import salted_join
from tidemark.session import as_table

REF = ["tbl", "rec", "field", "ptbl", "parent", "at"]
REF_SCHEMA = "tbl string, rec string, field string, ptbl string, parent string, at long"
INDEX_SCHEMA = "ptbl string, parent string, seen long, gone long, excluded boolean"


@dataclass(frozen=True)
class OrphanState:
    """Keyed state between increments, in hash buckets of the parent.

    index: one row per parent, when it was first seen and deleted. pending:
    references waiting for a parent. settled: references whose parent is there.
    cases: references that were orphans when they came, with the reason.
    """

    index: Bucketed
    pending: Bucketed
    settled: Bucketed
    cases: Bucketed

    @staticmethod
    def empty(spark, buckets: int = BUCKETS) -> OrphanState:
        of = lambda name, schema: Bucketed(spark, f"orphan-{name}", schema, ("ptbl", "parent"), buckets)
        return OrphanState(of("index", INDEX_SCHEMA), of("pending", REF_SCHEMA), of("settled", REF_SCHEMA), of("cases", REF_SCHEMA + ", reason string"))

    def open(self) -> DataFrame:
        """(tbl, rec, field, ptbl, parent, at, reason) of all references that are cases now."""
        return self.cases.read().unionByName(self.pending.read().withColumn("reason", F.lit("missing")))


def _reason() -> Column:
    return (
        F.when(F.col("seen").isNull(), F.lit("missing"))
        .when(F.col("excluded") | (F.col("gone") <= F.col("at")), F.lit("deleted"))
        .when(F.col("seen") > F.col("at"), F.lit("late"))
        .otherwise(F.lit("ok"))
    )


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ptbl", "parent").agg(F.min("seen").alias("seen"), F.min("gone").alias("gone"), F.coalesce(F.bool_or("excluded"), F.lit(False)).alias("excluded"))


def step(state: OrphanState, refs: DataFrame, parents: DataFrame, deletions: DataFrame) -> OrphanState:
    """Apply one increment: new references, arriving parents, deletions.

    Arriving parents and deletions are merged into the buckets of the index
    they touch; new references probe the buckets they refer to; arriving
    parents resolve the pending references of their buckets ('late', or
    'deleted' if excluded); deletions reopen settled references that are not
    older. Increments must come in order of time and a referring row at most
    once, deduplicated by first_rows().
    """
    arrived = as_table(_merge(parents.unionByName(deletions, allowMissingColumns=True)), "orphan-parents")
    hit = state.index.touched(arrived)
    index = state.index.with_buckets(_merge(state.index.read(hit).unionByName(arrived)), hit)
    moved = salted_join(refs, index.read(index.touched(refs)), ["ptbl", "parent"]).withColumn("reason", _reason()).select(*REF, "reason")
    waiting = [b for b in hit if b in state.pending.paths]
    if waiting:
        seen = arrived.where(F.col("seen").isNotNull())
        resolved = salted_join(state.pending.read(waiting), seen, ["ptbl", "parent"]).withColumn("reason", _reason())
        moved = moved.unionByName(resolved.select(*REF, "reason"))
    dead = arrived.where(F.col("gone").isNotNull()).select("ptbl", "parent", F.col("gone").alias("_gone"))
    if any(b in state.settled.paths for b in hit):
        reopened = salted_join(state.settled.read(hit), dead, ["ptbl", "parent"], "inner").where(F.col("_gone") <= F.col("at"))
        moved = moved.unionByName(reopened.select(*REF, F.lit("deleted").alias("reason")))
    moved = as_table(moved, "orphan-refs")
    missing = moved.where(F.col("reason") == "missing").select(*REF)
    of = [b for b in state.pending.touched(missing) if b not in waiting]
    pending = state.pending.with_buckets(missing.unionByName(state.pending.read(of)), waiting + of)
    settled = state.settled.appended(moved.where(F.col("reason") == "ok").select(*REF))
    return OrphanState(index, pending, settled, state.cases.appended(moved.where(F.col("reason").isin("late", "deleted"))))


def first_rows(df: DataFrame, at: Column, values: list[str]) -> DataFrame:
    """(id, at, values...): of several rows with one id the one recorded first; a null time comes last."""
    least = F.min(F.struct(at.isNull().alias("n"), at.alias("at"), *values)).alias("_f")
    return df.groupBy("id").agg(least).select("id", "_f.at", *[F.col(f"_f.{v}") for v in values])


@dataclass
class Feed:
    """All references, parents and deletions of a delivery."""

    refs: DataFrame
    parents: DataFrame
    deletions: DataFrame


def graph_feed(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> Feed:
    """Ends of edges refer to nodes, nodes.source refers to sources; null references are none, empty ones are."""
    e = first_rows(edges, micros(edges, "recorded"), ["source", "target"])
    n = first_rows(nodes.withColumn("gone", micros(nodes, "withdrawn")), micros(nodes, "recorded"), ["source", "gone"])
    s = first_rows(sources, iso_micros(F.col("retrieved")), ["state"])
    end = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("parent"))
    refs = (
        e.select(F.lit("edges").alias("tbl"), F.col("id").alias("rec"), F.explode(F.array(end("source"), end("target"))).alias("r"), F.lit("nodes").alias("ptbl"), "at")
        .select("tbl", "rec", "r.field", "ptbl", "r.parent", "at")
        .unionByName(n.select(F.lit("nodes").alias("tbl"), F.col("id").alias("rec"), F.lit("source").alias("field"), F.lit("sources").alias("ptbl"), F.col("source").alias("parent"), "at"))
        .where(F.col("parent").isNotNull())
    )
    parents = n.select(F.lit("nodes").alias("ptbl"), F.col("id").alias("parent"), F.col("at").alias("seen"), F.lit(False).alias("excluded")).unionByName(
        s.select(F.lit("sources").alias("ptbl"), F.col("id").alias("parent"), F.col("at").alias("seen"), F.coalesce(F.col("state") == "excluded", F.lit(False)).alias("excluded"))
    )
    deletions = n.where(F.col("gone").isNotNull()).select(F.lit("nodes").alias("ptbl"), F.col("id").alias("parent"), "gone")
    return Feed(refs, parents.where(F.col("parent").isNotNull()), deletions)


def replay(feed: Feed, increments: int = 2) -> Iterator[OrphanState]:
    """Run a whole delivery through the state in `increments` steps cut by time; the state after each.

    The last state doesn't depend on the number of increments. Rows without
    time go into the last one.
    """
    state = OrphanState.empty(feed.refs.sparkSession)
    if increments > 1:
        feed = Feed(as_table(feed.refs, "orphan-feed"), as_table(feed.parents, "orphan-feed-parents"), as_table(feed.deletions, "orphan-feed-deletions"))
    lo, hi = feed.refs.agg(F.min("at"), F.max("at")).first() if increments > 1 else (None, None)
    cuts = [] if lo is None else [lo + (hi - lo) * i // increments for i in range(1, increments)]
    for a, b in zip([None, *cuts], [*cuts, None]):

        def part(df: DataFrame, name: str, a=a, b=b) -> DataFrame:
            t = F.col(name)
            after = F.lit(True) if a is None else (t > a) | t.isNull()
            return df.where(after & (F.lit(True) if b is None else t <= b))

        state = step(state, part(feed.refs, "at"), part(feed.parents, "seen"), part(feed.deletions, "gone"))
        yield state


def orphans(edges: DataFrame, nodes: DataFrame, sources: DataFrame, increments: int = 2) -> DataFrame:
    """(tbl, rec, field, parent, at, reason) of every reference to nothing, to something deleted or delivered later."""
    *_, last = replay(graph_feed(edges, nodes, sources), increments)
    return last.open()


def counts_over_time(edges: DataFrame, nodes: DataFrame, sources: DataFrame, increments: int = 4) -> DataFrame:
    """(increment, tbl, month, reason, n): the report as it stood after each increment."""
    out = None
    for i, state in enumerate(replay(graph_feed(edges, nodes, sources), increments)):
        now = counts(state.open()).select(F.lit(i).alias("increment"), "tbl", "month", "reason", "n")
        out = now if out is None else out.unionByName(now)
    return out


def counts(open_refs: DataFrame) -> DataFrame:
    """(tbl, month, reason, n): the periodic report."""
    return open_refs.groupBy("tbl", utc_month(F.col("at")).alias("month"), "reason").agg(F.count("*").alias("n"))
