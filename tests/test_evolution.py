"""History, snapshot diff and orphans on small cases: nulls, ties, gaps, repeats, empty tables, clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import orphans as O
from tidemark.operators import snapshots as S
from tidemark.operators.captures import Captures, captures, latest_rows
from tidemark.operators.skew import salted_join

PEOPLE = "id string, name string, role string, org string, snapshot string, loaded timestamp_ntz, key string, ordinal int, capture string"
SOURCES = "id string, snapshot string, page string, retrieved string, state string"
NODES = "id string, type string, source string, no_longer_listed int, recorded timestamp_ntz, withdrawn timestamp_ntz, at string"
EDGES = "id string, verb string, source string, target string, recorded timestamp_ntz, seen string"
T = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def people(spark, rows):
    return spark.createDataFrame([(i, n, r, o, s, t, "x", 7, "y") for i, n, r, o, s, t in rows], PEOPLE)


def sources(spark, names):
    return spark.createDataFrame([(f"{n}/speakers", n, "speakers", f"{n}T23:30:00-02:00", "primary") for n in names], SOURCES)


A, B, C, D = "2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01"


def test_history_runs_gaps_nulls_and_late_rows(spark):
    p = people(
        spark,
        [
            ("a", "n", "x", None, A, T(0)),
            ("a", "n", "x", None, B, T(1)),
            ("a", "n", "x", None, B, T(1)),  # exact repeat
            ("a", "n", "y", None, D, T(3)),
            ("b", "n", "x", "o", A, T(0)),
            ("b", "n", "z", "o", A, T(90)),  # loaded late, counts
            ("b", "n", "x", "o", C, T(2)),
            (None, "n", "x", "o", C, T(2)),
            ("c", "n", "", None, A, None),
            ("c", "n", None, None, B, T(1)),  # '' and null are two versions
        ],
    )
    got = {(r.key, r.role, r.valid_from, r.valid_to) for r in H.history(p, sources(spark, [A, B, C, D])).collect()}
    day = lambda s: (dt.date.fromisoformat(s) + dt.timedelta(days=1)).isoformat()  # noqa: E731 23:30 at -02:00 is the next day in UTC
    assert got == {("a", "x", day(A), day(C)), ("a", "y", day(D), ""), ("b", "z", day(A), day(B)), ("b", "x", day(C), day(D)), ("c", "", day(A), day(B)), ("c", None, day(B), day(C))}


def test_history_over_many_words(spark):
    names = [f"2026-{i:03d}" for i in range(150)]
    random.seed(2)
    on = sorted(random.sample(range(150), 110))
    p = people(spark, [("a", "n", "x", "o", names[i], T(i)) for i in on] + [("z", "n", "x", "o", n, T(0)) for n in names])
    want, start = set(), on[0]
    for i, j in zip(on, [*on[1:], None]):
        if j != i + 1:
            want.add((start, i))
            start = j
    known = captures(p)
    rows = latest_rows(p, known, "id", ["role", "org"])
    assert {(r["first"], r["last"]) for r in H.versions(rows, known, ["role", "org"]).where("key = 'a'").collect()} == want


@pytest.mark.parametrize("f", ["history", "changes"])
def test_empty_tables(spark, f):
    p, s = people(spark, []), spark.createDataFrame([], SOURCES)
    assert (H.history(p, s) if f == "history" else S.changes(p)[0]).count() == 0


def test_snapshot_diff_against_brute_force(spark):
    random.seed(5)
    rows = [(f"p{i}", random.choice("ab"), random.choice(["r", None, ""]), random.choice(["o", "q"]), s, T(k)) for i in range(60) for k, s in enumerate((A, B, C, D)) if random.random() < 0.7]
    p = people(spark, rows)
    lists = {s: {r[0]: r[1:4] for r in rows if r[4] == s} for s in (A, B, C, D)}
    want = set()
    for x, y in zip((A, B, C), (B, C, D)):
        for k in lists[x].keys() | lists[y].keys():
            if k not in lists[x]:
                want.add((y, k, "added"))
            elif k not in lists[y]:
                want.add((y, k, "removed"))
            else:
                want |= {(y, k, f) for f, a, b in zip(("name", "role", "org"), lists[x][k], lists[y][k]) if a != b}
    nodes = spark.createDataFrame([(f"person:p{i}", "Person", None, i % 2 if i % 5 else None, T(0), None, "") for i in range(70)], NODES)
    ever = {r[0] for r in rows}
    for i in range(70):
        flag = (i % 2 if i % 5 else 0) == 1
        if f"p{i}" in ever and flag != (f"p{i}" not in lists[D]):
            want.add((D, f"p{i}", "stale_flag"))
    assert {tuple(r) for r in S.snapshot_changes(p, None, nodes).collect()} == want


def graph(spark, seed):
    random.seed(seed)
    ids = [f"n{i}" for i in range(25)]
    nodes = [(i, "Person", random.choice(["s1", "s2", "s9", "", None]), 0, T(random.randint(0, 60)), random.choice([None, None, T(random.randint(61, 80))]), "") for i in ids]
    nodes += [(n[0], "Person", n[2], 0, n[4] + dt.timedelta(days=30), None, "") for n in nodes[:5]]  # delivered again later
    edges = [(f"e{i}", "v", random.choice([*ids, "gone", "", None]), random.choice([*ids[:3], "gone"]), T(random.randint(0, 100)), "") for i in range(120)]
    edges += edges[:10] + [(e[0], "v", "other", "other", e[4] + dt.timedelta(days=1), "") for e in edges[10:20]]
    src = [("s1", A, "p", "2026-01-10T00:00:00Z", "primary"), ("s2", A, "p", "2026-01-10 00:00:00+00:00", "excluded")]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(src, SOURCES), edges, nodes


@pytest.mark.parametrize("increments", [1, 2, 4])
def test_orphans_in_increments(spark, increments):
    e, n, s, edges, nodes = graph(spark, 3)
    first = lambda rows, at: {r[0]: r for r in sorted(rows, key=lambda r: r[at], reverse=True)}
    fn, want = first(nodes, 4), set()
    for r in first(edges, 4).values():
        for field, ref in (("source", r[2]), ("target", r[3])):
            if ref is None:
                continue
            x = fn.get(ref)
            why = "missing" if x is None else "deleted" if x[5] and x[5] <= r[4] else "late" if x[4] > r[4] else None
            if why:
                want.add(("edges", r[0], field, why))
    for r in fn.values():
        if r[2] is not None:
            why = {"s1": "late" if T(9) > r[4] else None, "s2": "deleted"}.get(r[2], "missing")
            if why:
                want.add(("nodes", r[0], "source", why))
    got = [(r.tbl, r.rec, r.field, r.reason) for r in O.orphans(e, n, s, increments).collect()]
    assert set(got) == want and len(got) == len(want)


def test_deletion_reopens(spark):
    state = O.OrphanState.empty(spark)
    ref = spark.createDataFrame([("edges", "e", "source", "nodes", "n", 10)], O.REF_SCHEMA)
    parent = spark.createDataFrame([("nodes", "n", 5, False)], "ptbl string, parent string, seen long, excluded boolean")
    none = spark.createDataFrame([], "ptbl string, parent string, gone long")
    state = O.step(state, ref, parent.limit(0), none)
    assert [r.reason for r in state.open().collect()] == ["missing"]
    state = O.step(state, ref.limit(0), parent, none)
    assert state.open().count() == 0 and state.settled.read().count() == 1
    state = O.step(state, ref.limit(0), parent.limit(0), spark.createDataFrame([("nodes", "n", 7)], "ptbl string, parent string, gone long"))
    assert [r.reason for r in state.open().collect()] == ["deleted"]


def test_an_increment_touches_only_its_buckets(spark):
    refs = spark.createDataFrame([("edges", f"e{i}", "source", "nodes", f"n{i}", 10) for i in range(300)], O.REF_SCHEMA)
    parents = spark.createDataFrame([("nodes", f"n{i}", 5, False) for i in range(0, 300, 2)], "ptbl string, parent string, seen long, excluded boolean")
    none = spark.createDataFrame([], "ptbl string, parent string, gone long")
    state = O.step(O.OrphanState.empty(spark, buckets=16), refs, parents, none)
    one = spark.createDataFrame([("nodes", "n1", 12, False)], "ptbl string, parent string, seen long, excluded boolean")
    after = O.step(state, refs.limit(0), one, none)
    for part in ("index", "pending"):
        a, b = getattr(state, part).paths, getattr(after, part).paths
        assert len(a) > 10 and sum(a[k] != b.get(k) for k in a) == 1, part
    assert after.open().where("reason = 'late'").count() == 1 and after.open().count() == 150


def test_counts_after_each_increment(spark):
    e, n, s, _, _ = graph(spark, 5)
    over = O.counts_over_time(e, n, s, 3).collect()
    last = {(r.tbl, r.month, r.reason, r.n) for r in over if r.increment == 2}
    assert last == {tuple(r) for r in O.counts(O.orphans(e, n, s, 1)).collect()} and {r.increment for r in over} == {0, 1, 2}


@pytest.mark.parametrize("name", ["p4_found", "p4_counts"])
def test_the_queries_of_orphans_work_on_a_kept_state(spark, monkeypatch, name):
    """Later increments meet references that wait and settled ones; the first meets none."""
    from tidemark.plans import catalogue

    met, step = [], O.step

    def watched(state, *new):
        met.append((state.pending.read().count(), state.settled.read().count()))
        return step(state, *new)

    monkeypatch.setattr(O, "step", watched)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert met[0] == (0, 0) and len(met) > 1 and all(min(m) > 0 for m in met[1:])


def test_kept_snapshots_merge_the_newest_pair(spark):
    rng = random.Random(4)
    rows = [(f"k{k}", o, rng.choice(["x", "y", None])) for o in range(5) for k in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, ordinal int, v string")
    kept = S.KeptSnapshots.empty(spark, df.where("ordinal = 0"), ["v"], ranges=4)
    got = []
    for o in range(5):
        kept, diff = kept.add(df.where(F.col("ordinal") == o).select("key", "v"))
        got += [(o, r.key, r.change) for r in diff.collect()]
    known = Captures([A, B, C, "2026-04-01", "2026-05-01"], [None] * 5)
    assert sorted(got) == sorted((r.ordinal, r.key, r.change) for r in S.diff_snapshots(df, known, ["v"]).collect())


def test_salted_join_is_the_join(spark):
    many = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i int, k string")
    one = spark.createDataFrame([("hot", 1), ("k9", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        a = sorted(map(str, salted_join(many, one, ["k"], how, hot_rows=10).select("i", "k", "v").collect()))
        assert a == sorted(map(str, many.join(one, "k", how).select("i", "k", "v").collect()))
    assert many.agg(F.count("*")).first()[0] == 300


def test_every_kind_of_change_with_old_and_new_values(spark, tmp_path):
    from tidemark.plans import catalogue

    rows = [("a", "n", "x", None, A, T(0)), ("a", "n", "y", "o", B, T(1)), ("b", "n", "x", "o", A, T(0)), ("c", "n", "x", "o", B, T(1)), ("d", "n", "x", "o", A, T(0)), ("d", "m", "x", "o", B, T(1)), ("d", "m", "x", "o", C, T(2)), ("c", "n", "x", None, C, T(2)), ("b", "n", "z", "o", C, T(2))]
    people(spark, rows).write.parquet(str(tmp_path / "people.parquet"))
    run = lambda n: {tuple(r) for r in catalogue.QUERIES[n](spark, str(tmp_path)).collect()}
    assert run("ev01_snapshot_diff") == {(B, "added", 1), (B, "removed", 1), (B, "role", 1), (B, "org", 1), (B, "name", 1), (C, "added", 1), (C, "removed", 1), (C, "org", 1)}
    assert run("ev01_changed_values") == {(B, "a", "role", "x", "y"), (B, "a", "org", None, "o"), (B, "d", "name", "n", "m"), (C, "c", "org", "o", None)}


@pytest.mark.parametrize("most", [10_000, 6])
def test_mentions_against_counting(spark, most):
    """Also with several automata; occurrences of one phrase don't overlap, nulls and empty phrases are nowhere."""
    from tidemark.operators.phrases import mentions

    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("aab c") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(99, None)]
    phrases = [("x", "aa"), ("y", "ab"), ("z", "aa"), ("w", "b c"), ("v", ""), ("u", None), (None, "a"), ("t", "aabaa")]
    df, ph = spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(phrases, "name string, phrase string")
    got = {tuple(r) for r in mentions(df, ph, most).collect()}
    assert got == {(k, n, x.count(p)) for k, x in texts if x for n, p in phrases if n and p and x.count(p)}
    words = spark.createDataFrame([(1, "an aa, xaa aax aa")], "key int, text string")
    assert {tuple(r) for r in mentions(words, ph, whole_words=True).collect()} == {(1, "x", 2), (1, "z", 2)}
