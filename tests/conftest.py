import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surtscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Small frame from a DDL schema and tuples."""
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


@pytest.fixture
def collect():
    """Rows as sorted tuples, NULLs last."""
    def run(df, *columns):
        out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])

    return run
