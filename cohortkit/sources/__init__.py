"""Sources and sinks: CSV / gzip CSV / Parquet / catalog tables, lookups, models."""
