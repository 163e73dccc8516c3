"""Every registered catalog query against its SQL twin."""

import pytest

from lumentrail.plans import catalog, details, incremental

assert details.QUERIES is catalog.QUERIES is incremental.QUERIES


def rows(columns, data):
    order = sorted(columns)
    return order, sorted((tuple(dict(zip(columns, r))[c] for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
