"""Every registered query of the library against its SQL twin."""

import decimal

import duckdb
import pytest

from quorumlake.plans import catalogue, ingest, oracle, rules

QUERIES = catalogue.QUERIES | ingest.QUERIES | rules.QUERIES
ORACLE = oracle.ORACLE | ingest.ORACLE | rules.ORACLE

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, (decimal.Decimal, float)):
        return repr(float(x))
    return repr(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        assert got == rows(r.fetchall(), [d[0] for d in r.description])
    else:
        assert got[1]


def test_all_oracles_have_queries():
    assert set(ORACLE) == set(QUERIES)
    assert len(QUERIES) == len(catalogue.QUERIES) + len(ingest.QUERIES) + len(rules.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
