"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate)."""

import math

import pytest

from places import SF_CHECK
from triplematch.plans.registry import load_all

QUERIES = load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_query_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    df = q.fn(spark, SF_CHECK)
    cols = sorted(df.columns)
    got = sorted((_norm(tuple(r)) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(q.oracle)
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((_norm(tuple(r[i] for i in idx)) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.oracle))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name].fn(spark, SF_CHECK)
    assert df.count() >= 0
