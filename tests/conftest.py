import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from places import SF_CHECK  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from triplematch.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_CHECK}/{t}.parquet'")
    return con


def approx_rows(rows, digits=6):
    out = []
    for r in rows:
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return out
