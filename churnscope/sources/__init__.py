"""Sources and sinks: parquet tables, the derived subscriptions table, CSV uploads,
the dataset registry and the model store."""
