"""Log analytics on Spark: lines to entries to Parquet to SQL."""
