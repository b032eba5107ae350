"""The incremental pair table against counting by hand."""

import random
from collections import Counter
from itertools import combinations

import oracle
import pytest

from tidemark.llm import pairs as P
from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p3_found", "p3_scores"])
def test_sql(spark, name):
    _, a, b = oracle.compare(spark, SMALL, queries.QUERIES[name], queries.ORACLE[name])
    assert not a and not b


def table_of(table):
    names = {r.item_id: r.item for r in table.items.read().collect()}
    pairs = {tuple(sorted((names[r.a], names[r.b]))): r.n for r in table.pairs.read().collect()}
    return pairs, {r.item: r.n for r in table.items.read().collect()}, table.baskets


def by_hand(rows):
    baskets = {}
    for b, i, _ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    return dict(Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))), dict(Counter(i for s in baskets.values() for i in s)), len(baskets)


@pytest.mark.parametrize("largest", [1000, 4])
def test_increment_and_removal(spark, monkeypatch, largest):
    """Small baskets as arrays, large ones in blocks: the same counts; nulls and repeats don't count."""
    monkeypatch.setattr(P, "MAX_ITEMS", largest)
    monkeypatch.setattr(P, "BLOCK", 2)
    random.seed(1)
    rows = [(random.choice([None, *"abcdef"]), random.choice([None, *[f"i{k}" for k in range(12)]]), random.random() < 0.7) for _ in range(150)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "basket string, item string, before boolean")
    old = {(b, i) for b, i, x in rows if x}
    first = P.update(P.PairTable.empty(spark, least=1, buckets=4), df.where("before"))
    assert table_of(first) == by_hand([r for r in rows if (r[0], r[1]) in old])
    now = P.update(first, df)
    assert table_of(now) == by_hand(rows)
    less = P.update(now, df.limit(0), df.where("basket = 'a' OR item = 'i3'"))
    assert table_of(less) == by_hand([r for r in rows if r[0] != "a" and r[1] != "i3"])
    again = P.update(less, df.where("basket = 'a' AND item <> 'i3'"), df.where("basket = 'b'"))
    want = by_hand([r for r in rows if r[0] != "b" and r[1] != "i3"])
    assert table_of(again) == want
    scores = {tuple(sorted((r.item_a, r.item_b))): (r.n, *(x for _, x in sorted(((r.item_a, r.n_a), (r.item_b, r.n_b))))) for r in again.scores.collect()}
    assert scores == {p: (n, want[1][p[0]], want[1][p[1]]) for p, n in want[0].items()}
    assert table_of(P.update(P.PairTable.empty(spark), df)) == by_hand(rows)


def test_an_increment_touches_only_its_buckets(spark):
    """One changed basket of many: few buckets are written again, the others are the same files."""
    rows = [(f"b{k}", f"i{k % 40}") for k in range(400)] + [(f"b{k}", f"i{(7 * k + 3) % 40}") for k in range(400)]
    table = P.update(P.PairTable.empty(spark, least=1, buckets=16), spark.createDataFrame(rows, "basket string, item string"))
    more = P.update(table, spark.createDataFrame([("b7", "new item"), ("b7", "i7")], "basket string, item string"))
    for part in ("members", "pairs", "items"):
        before, after = getattr(table, part).paths, getattr(more, part).paths
        changed = [b for b in after if before.get(b) != after[b]]
        assert 1 <= len(changed) <= 3 and len(before) > 8, part
        fresh = [p for b in changed for p in after[b]]
        assert spark.read.parquet(*fresh).count() < 0.4 * getattr(more, part).read().count()
    assert P.update(more, spark.createDataFrame(rows[:50], "basket string, item string")).pairs.paths == more.pairs.paths  # nothing new, nothing written


def test_threshold_is_inclusive_and_empty(spark):
    rows = [(f"b{k}", i, True) for k in range(12) for i in (("x", "y") if k < 4 else ("x",) if k < 4 else ("z",))]
    table = P.update(P.PairTable.empty(spark), spark.createDataFrame(rows, "basket string, item string, before boolean"))
    assert [tuple(r) for r in P.associated(table).collect()] == [("x", "y", 4, 4, 4, 12)]
    assert P.associated(P.update(P.PairTable.empty(spark), spark.createDataFrame([], "basket string, item string"))).count() == 0
