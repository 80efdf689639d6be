import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, copy long, bits string"


def docs_frame(spark, rows, schema=SCHEMA):
    """Documents with columns whose names clash with the operators' own. rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, True, 9.5, 77, "x") for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: docs_frame(spark, rows)
