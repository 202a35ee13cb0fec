"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from meshloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else list(v) if isinstance(v, np.ndarray) else v
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_point_stands_without_the_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['meshloom.llm'] = None; import __spark_entry__ as e; assert 'edge_cut' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0
