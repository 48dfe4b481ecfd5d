"""Order analytics on Spark: feeds, staging, star schema, marts and data checks."""
