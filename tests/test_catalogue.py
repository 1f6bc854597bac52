import math

import duckdb
import pytest

from emberline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return d


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = oracle.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_flagship_figures(spark, sf_dir):
    out = catalogue.retained_spans_error(spark, "/root/testdata/sf0.001")
    assert out.count() == 706 and out.select("ord").distinct().count() == 645


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
