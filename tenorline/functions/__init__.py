"""Column functions. All of them compose built-in Spark expressions; there is no Python UDF."""
