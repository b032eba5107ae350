"""Every core query against its SQL on the smallest tables."""

import oracle
import pytest

from tidemark.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.ORACLE:
        _, ours, theirs = oracle.compare(spark, SMALL, catalogue.QUERIES[name], catalogue.ORACLE[name])
        assert not ours and not theirs
    else:
        assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_written_tables_can_be_removed(spark):
    from tidemark.session import as_table, clean

    df = as_table(spark.range(3), "some")
    assert df.count() == 3 and clean(spark) >= 1 and clean(spark) == 0
