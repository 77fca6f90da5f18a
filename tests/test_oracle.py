"""Every registered query on the smallest given tables, against its SQL where there is one."""

import os

import pytest
from compare import connect, difference

from tabkit import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), duck, catalog.ORACLE[name]) is None


@pytest.mark.parametrize("name", ["interp_cubic", "multilabel_logit", "gbt_series", "perm_importance"])
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
