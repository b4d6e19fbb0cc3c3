"""Spark plans vs their DuckDB oracle SQL on the smallest fixture tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from cadenza.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "conversations", "labels", "embeddings", "events"]
registry.load_all()
NAMES = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(rows, order):
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    s = _rows([tuple(r) for r in df.collect()], range(len(cols)))
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == sorted(cols)
    d = _rows(rel.fetchall(), [dcols.index(c) for c in cols])
    assert s == d


def test_every_query_has_columns(spark):
    qs = E.queries()
    assert len(qs) >= 60
    df = E.entry(spark)
    assert df.columns == ["doc_id", "metre", "score", "num_lines"]
