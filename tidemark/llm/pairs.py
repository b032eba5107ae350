"""Items that appear together: an incremental table of pair counts, and the pairs well above chance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.buckets import BUCKETS, Bucketed
from tidemark.session import as_table

#: Baskets with more distinct items are cut into blocks, so that no task holds all pairs of one basket.
MAX_ITEMS = 1000
BLOCK = 500
KEPT, NEW, GONE = 0, 1, -1


@dataclass(frozen=True)
class PairTable:
    """Persistent counts: members of baskets, pairs, items, the number of baskets, and the marginals of pairs of `least` and more."""

    members: Bucketed
    pairs: Bucketed
    items: Bucketed
    scores: DataFrame
    baskets: int
    least: int

    @staticmethod
    def empty(spark: SparkSession, basket_type: str = "string", least: int = 4, buckets: int = BUCKETS) -> PairTable:
        return PairTable(
            Bucketed(spark, "pair-members", f"basket {basket_type}, item_id long, item string", ("basket",), buckets),
            Bucketed(spark, "pair-counts", "a long, b long, n long", ("a",), buckets),
            Bucketed(spark, "pair-items", "item_id long, item string, n long", ("item_id",), buckets),
            spark.createDataFrame([], "a long, b long, n long, n_a long, n_b long, item_a string, item_b string"),
            0,
            least,
        )


def clean_rows(rows: DataFrame) -> DataFrame:
    """(basket, item_id, item), distinct; null baskets and items are left out."""
    return rows.where(F.col("basket").isNotNull() & F.col("item").isNotNull()).select("basket", F.xxhash64("item").alias("item_id"), "item").distinct()


def changed_members(table: PairTable, coming: DataFrame, going: DataFrame) -> DataFrame:
    """(basket, item_id, item, state) of the baskets that change: KEPT, NEW or GONE. Reads only the buckets of these baskets."""
    asked = coming.withColumn("_c", F.lit(1)).unionByName(going.withColumn("_c", F.lit(-1)))
    asked = asked.groupBy("basket", "item_id", "item").agg(F.max("_c").alias("_c"))  # what comes and goes at once stays
    old = table.members.read(table.members.touched(asked)).join(asked.select("basket").distinct(), "basket", "left_semi").withColumn("_o", F.lit(1))
    both = old.join(asked, ["basket", "item_id", "item"], "full")
    state = F.when(F.col("_o").isNull(), F.when(F.col("_c") > 0, NEW)).otherwise(F.when(F.col("_c") < 0, GONE).otherwise(KEPT))
    return both.select("basket", "item_id", "item", state.alias("state")).where("state IS NOT NULL")


def _ordered(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(sign).cast("long").alias("d"))


def _in_array(rows: DataFrame, of: str) -> DataFrame:
    """Pairs within an array, one generator after the other, so nothing is built up."""
    first = rows.select(F.col(of).alias("_s"), F.posexplode(of).alias("_i", "x"))
    return first.select("x", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("y"))


def _across(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.explode(one).alias("x"), F.col(other)).select("x", F.explode(other).alias("y"))


def pair_deltas(changed: DataFrame, had: bool = True, less: bool = True) -> DataFrame:
    """(a, b, d), a < b: +1 for each pair a basket now holds with a new item, -1 for each it held with one that is gone.

    Nothing was there before if not `had`, nothing goes if not `less`.
    """
    sizes = changed.groupBy("basket").agg(F.count("*").alias("n_items"), F.max(F.abs("state")).alias("_any")).where("_any > 0")
    large = sizes.where(F.col("n_items") > MAX_ITEMS)
    small = changed.join(sizes.where(F.col("n_items") <= MAX_ITEMS).select("basket"), "basket", "left_semi")
    of = lambda s: F.collect_list(F.when(F.col("state") == s, F.col("item_id")))
    grouped = small.groupBy("basket").agg(of(KEPT).alias("kept"), of(NEW).alias("new"), of(GONE).alias("gone"))
    out = _ordered(_in_array(grouped, "new"), 1)
    if had:
        out = out.unionByName(_ordered(_across(grouped, "new", "kept"), 1))
    if less:
        out = out.unionByName(_ordered(_across(grouped, "gone", "kept"), -1)).unionByName(_ordered(_in_array(grouped, "gone"), -1))
    if large.isEmpty():
        return out
    # large baskets: items meet in pairs of blocks of about BLOCK each
    rows = changed.join(large.select("basket", "n_items"), "basket").select("basket", "item_id", "state", F.ceil(F.col("n_items") / BLOCK).cast("int").alias("_k"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("_k")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_k") - 1)
    left = rows.select("basket", F.col("item_id").alias("a"), F.col("state").alias("_s"), F.col("_b").alias("_x"), F.explode(others).alias("_y"))
    right = rows.select("basket", F.col("item_id").alias("b"), F.col("state").alias("_t"), F.col("_b").alias("_y"), F.explode(others).alias("_x"))
    met = left.join(right, ["basket", "_x", "_y"]).where("a < b AND (_s <> 0 OR _t <> 0) AND _s * _t >= 0")
    return out.unionByName(met.select("a", "b", F.when((F.col("_s") > 0) | (F.col("_t") > 0), 1).otherwise(-1).cast("long").alias("d")))


def checked_item() -> Column:
    """The item of an id; two items with one id are an error, not a wrong count."""
    same = F.min("item") == F.max("item")
    return F.when(same, F.min("item")).otherwise(F.raise_error(F.concat(F.lit("two items with one id: "), F.min("item"), F.lit(", "), F.max("item"))))


def update(table: PairTable, coming: DataFrame, going: DataFrame | None = None) -> PairTable:
    """Apply rows (basket, item) that come and go: signed deltas merged into the buckets they touch.

    Rows the table holds already, or doesn't hold when they go, change nothing.
    Only changed baskets emit, and only pairs with a changed item; scores are
    recomputed for pairs whose count or an item of which has changed.
    """
    coming = clean_rows(coming)
    less = going is not None
    going = clean_rows(going) if less else coming.limit(0)
    first = not table.members.paths
    changed = as_table(coming.withColumn("state", F.lit(NEW)) if first else changed_members(table, coming, going), "pair-changes")
    moved = changed.where(F.col("state") != KEPT)
    deltas = as_table(pair_deltas(changed, not first, less).groupBy("a", "b").agg(F.sum("d").alias("d")).where("d <> 0"), "pair-deltas")
    item_deltas = as_table(moved.groupBy("item_id").agg(checked_item().alias("item"), F.sum("state").cast("long").alias("d")).where("d <> 0"), "item-deltas")

    hit = table.pairs.touched(deltas)
    merged = table.pairs.read(hit).unionByName(deltas.select("a", "b", F.col("d").alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
    pairs = table.pairs.with_buckets(merged, hit)
    hit_items = table.items.touched(item_deltas)
    merged = table.items.read(hit_items).unionByName(item_deltas.select("item_id", "item", F.col("d").alias("n")))
    items = table.items.with_buckets(merged.groupBy("item_id").agg(checked_item().alias("item"), F.sum("n").alias("n")).where("n <> 0"), hit_items)
    hit_baskets = table.members.touched(moved)
    stay = table.members.read(hit_baskets).join(moved.where(F.col("state") == GONE).select("basket", "item_id"), ["basket", "item_id"], "left_anti")
    members = table.members.with_buckets(stay.unionByName(moved.where(F.col("state") == NEW).drop("state")), hit_baskets)

    filled = changed.groupBy("basket").agg(F.max((F.col("state") != NEW).cast("int")).alias("had"), F.max((F.col("state") != GONE).cast("int")).alias("has"))
    more = filled.agg(F.sum(F.col("has") - F.col("had"))).first()[0] or 0
    scores = as_table(rescored(table, pairs.read(hit).where(F.col("n") >= table.least).join(deltas.select("a", "b"), ["a", "b"], "left_semi"), deltas, items, item_deltas, hit_items), "pair-scores")
    return PairTable(members, pairs, items, scores, table.baskets + more, table.least)


def rescored(table: PairTable, counted: DataFrame, deltas: DataFrame, items: Bucketed, item_deltas: DataFrame, hit_items: list[int]) -> DataFrame:
    """The scores with new counts and marginals where one has changed; `counted` are the changed pairs with their counts."""
    now = items.read(hit_items).join(item_deltas.select("item_id"), "item_id", "left_semi").select("item_id", F.col("n").alias("_n"))
    kept = table.scores.join(deltas.select("a", "b"), ["a", "b"], "left_anti")
    for side in "ab":
        kept = kept.join(now.withColumnRenamed("item_id", side), side, "left").withColumn(f"n_{side}", F.coalesce("_n", f"n_{side}")).drop("_n")
    fresh = counted
    for side in "ab":
        fresh = fresh.join(items.read().select(F.col("item_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("item").alias(f"item_{side}")), side)
    return kept.select(*table.scores.columns).unionByName(fresh.select(*table.scores.columns))


def associated(table: PairTable, lift: int = 3) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets): pairs with n_ab >= least and n_ab * N >= lift * n_a * n_b."""
    n = F.lit(table.baskets).cast("long")
    rows = table.scores.where(F.col("n") * n >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    swap = F.col("item_a") > F.col("item_b")
    return rows.select(
        F.least("item_a", "item_b").alias("item_a"),
        F.greatest("item_a", "item_b").alias("item_b"),
        F.col("n").alias("n_ab"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        n.alias("n_baskets"),
    )


def person_rows(people: DataFrame, topics: DataFrame, tags: DataFrame) -> DataFrame:
    """(basket, item, snapshot): items of persons; topics and tags have no snapshot."""
    none = F.lit(None).cast("string").alias("snapshot")
    return (
        topics.select(F.col("person").alias("basket"), F.concat(F.lit("topic:"), "topic").alias("item"), none)
        .unionByName(tags.select(F.col("person").alias("basket"), F.concat(F.lit("tag:"), "tag").alias("item"), none))
        .unionByName(people.where("id IS NOT NULL AND org <> ''").select(F.col("id").alias("basket"), F.concat(F.lit("org:"), "org").alias("item"), F.col("snapshot")))
    )


def co_occurring(people: DataFrame, topics: DataFrame, tags: DataFrame, least: int = 4, lift: int = 3) -> DataFrame:
    """All rows but those of the last capture are loaded, the last capture is applied as an increment.

    Empty tables give no rows.
    """
    last = people.agg(F.max("snapshot")).first()[0]
    rows = person_rows(people, topics, tags)
    newest = F.col("snapshot").eqNullSafe(last) & F.col("snapshot").isNotNull()
    table = update(PairTable.empty(people.sparkSession, least=least), rows.where(~newest).select("basket", "item"))
    return associated(update(table, rows.where(newest).select("basket", "item")), lift)
