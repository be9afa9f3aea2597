"""The registered queries by name, and the SQL of those that SQL can express."""

from . import driver_queries, frame_queries, record_queries, space_queries

_MODULES = (driver_queries, frame_queries, record_queries, space_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
