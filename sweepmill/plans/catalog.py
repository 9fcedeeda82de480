"""The driver-facing queries and their SQL, by module."""

from . import captures, clouds, gates, live, motions, places, surfaces, timelines

_MODULES = (clouds, timelines, surfaces, places, motions, gates, live, captures)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
