import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabkit.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tabkit-tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows_of():
    """Rows as sorted tuples, nulls first."""

    def collect(df, *columns):
        rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(rows, key=lambda r: [(v is not None, str(v) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else 0) for v in r])

    return collect
