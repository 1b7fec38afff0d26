"""All core queries and their SQL."""

from veinwork.plans import claims, entities, graphs, refs

_PARTS = [graphs, entities, claims, refs]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
