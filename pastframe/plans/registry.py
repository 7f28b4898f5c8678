"""Every query of the library by name, with its SQL."""

from . import history_queries, job_queries, ml_queries, stream_queries, table_queries

_PARTS = [history_queries, table_queries, ml_queries, job_queries, stream_queries]

QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
