"""Contest analytics on Spark: DataFrame operators for competitive-event data."""
