import os
from collections import Counter

import duckdb
import pytest

from stavelake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = Counter(tuple(r) for r in rel.select(*[f'"{c}"' for c in df.columns]).fetchall())
        assert Counter(tuple(r) for r in df.collect()) == want


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
