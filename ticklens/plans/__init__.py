"""Plans: the distributed ordered-window core, dispatch entry points, SQL views
and the registry of queries with their DuckDB oracles."""
