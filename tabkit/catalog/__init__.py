"""Every registered query, and the SQL that must give the same rows where there is one."""

from tabkit.catalog import metrics, models, preparation, relational, statistics, timeseries

_MODULES = (relational, statistics, timeseries, preparation, metrics, models)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
