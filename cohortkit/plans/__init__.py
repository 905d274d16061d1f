"""Plans: the cohort build (``cohort``), model development (``modelling``), the
test-table mapping with its registered queries (``driver_tables``) and their
DuckDB oracle SQL (``oracle_sql``)."""
