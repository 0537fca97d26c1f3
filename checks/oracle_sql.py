"""All DuckDB oracle statements, keyed like ``quarry.catalog.REGISTRY``."""

from checks import oracle_analysis, oracle_catalogue, oracle_pe, oracle_storage

SQL: dict[str, str] = {}
for part in (oracle_pe, oracle_storage, oracle_catalogue, oracle_analysis):
    SQL.update(part.SQL)
