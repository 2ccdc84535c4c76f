"""Sources and sinks: test tables, raw exchange messages, parquet rollups."""
