"""Document reading on Spark: positioned text and delimited text into checked rows."""
