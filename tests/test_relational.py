"""conn_talk against its SQL on tables with ties, hot things and few pairs; what it writes must not grow with the pairs."""

import os
import random

import oracle
import pytest

from tidemark import session
from tidemark.plans import catalogue, relational

SMALL = "/root/testdata/sf0.001"


def tables(spark, tmp_path, grounds):
    """One person per organisation, who stands on its things; the other tables are the smallest ones."""
    mine = {"people", "orgs", "person_topics", "person_tags"}
    for t in set(oracle.TABLES) - mine:
        os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    write = lambda t, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    write("people", [(f"p-{o}", o) for o in grounds] + [("x", None), (None, "x")], "id string, org string")
    write("orgs", [("n", "none", 1), ("m", None, 1)], "id string, name string, placeholder int")
    write("person_topics", [(f"p-{o}", w) for o, ws in grounds.items() for w in ws] * 2 + [("x", "t")], "person string, topic string")
    write("person_tags", [(f"p-{o}", ws[0], "Ideia") for o, ws in grounds.items() if ws and ws[0]] + [(f"p-{o}", "t0", "Other") for o in grounds], "person string, tag string, type string")
    return str(tmp_path)


def check(spark, d, name="conn_talk"):
    n, ours, theirs = oracle.compare(spark, d, catalogue.QUERIES[name], catalogue.ORACLE[name])
    assert not ours and not theirs
    return n


@pytest.mark.parametrize("seeds,block,things,most", [(200, 4000, 12, 9), (3, 7, 12, 9), (1, 5, 40, 30), (30, 2, 5, 5), (5, 3, 300, 12)])
def test_pairs_of_organisations_with_small_seeds_and_blocks(spark, tmp_path, monkeypatch, seeds, block, things, most):
    monkeypatch.setattr(relational, "SEEDS", seeds, raising=False)
    monkeypatch.setattr(relational, "BLOCK", block, raising=False)
    rng = random.Random(seeds)
    names = [f"{rng.choice(['Á', 'a', 'Z', 'é', ' '])}{i}" for i in range(90)] + ["none", ""]
    some = lambda: [f"t{min(rng.randrange(things), rng.randrange(things))}" for _ in range(rng.randint(0, most))] + rng.choice([[], [None]])
    check(spark, tables(spark, tmp_path, {o: some() for o in names}))


def test_fewer_pairs_than_the_report_holds(spark, tmp_path):
    assert check(spark, tables(spark, tmp_path, {"a": ["1", "2", "3"], "b": ["3", "2", "1"], "c": ["2", "1"], "d": ["9"]})) == 1


def test_no_pairs(spark, tmp_path):
    assert check(spark, tables(spark, tmp_path, {"a": ["1", "2"], "b": ["3"]})) == 0


@pytest.mark.parametrize("name", ["conn_talk", "sql_orgs_should_talk"])
def test_pairs_that_cannot_be_among_the_best_are_not_written(spark, tmp_path, name):
    """600 organisations share three things, which is 179,700 pairs; 20 of them share more."""
    grounds = {f"o{i:03}": ["1", "2", "3"] + [f"more{j}" for j in range(5)] * (i % 30 == 0) for i in range(600)}
    d, held = tables(spark, tmp_path, grounds), sum(map(len, grounds.values()))
    before = set(session._written)
    assert check(spark, d, name) == 40
    assert max(spark.read.parquet(p).count() for p in set(session._written) - before) <= held + len(grounds)


def shuffled(spark, work):
    """Records that the stages of `work` write to shuffle files."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    ended = lambda: sc.listenerBus().waitUntilEmpty(30_000) or sc.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for s in [ended()] for x in map(s.apply, range(s.size()))}
    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["conn_talk", "sql_orgs_should_talk"])
def test_pairs_are_not_shuffled(spark, tmp_path, name):
    """1,200 organisations share three things, which is 719,400 pairs; 40 of them share more."""
    grounds = {f"o{i:04}": ["1", "2", "3"] + [f"more{j}" for j in range(5)] * (i % 30 == 0) for i in range(1200)}
    d, held = tables(spark, tmp_path, grounds), sum(map(len, grounds.values()))
    assert shuffled(spark, lambda: check(spark, d, name)) <= 20 * held


@pytest.mark.parametrize("name", ["conn_talk", "sql_orgs_should_talk"])
def test_longest_lists_that_share_nothing_do_not_let_all_meet(spark, tmp_path, monkeypatch, name):
    """The 20 longest lists are of things nobody else has; of the other 400, 20 share twelve things more."""
    rng, met, pairs = random.Random(7), [], relational.talk_pairs
    grounds = {f"o{i:03}": [f"t{j}" for j in rng.sample(range(24), 12)] + [f"more{j}" for j in range(12)] * (i % 20 == 0) for i in range(400)}
    grounds |= {f"alone{i}": [f"own{i}-{j}" for j in range(60)] for i in range(20)}
    monkeypatch.setattr(relational, "SEEDS", 20)
    monkeypatch.setattr(relational, "talk_pairs", lambda lists, least: met.extend(n - least + 1 for (n,) in lists.selectExpr("size(ws)").collect()) or pairs(lists, least))
    assert check(spark, tables(spark, tmp_path, grounds), name) == 40
    assert len(met) <= 40 and sum(met) <= 400  # organisations that meet, and rows they meet on
