"""Contest analytics on Spark: ratings, validation, data quality and serving as DataFrame jobs."""
