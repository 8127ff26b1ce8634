"""Environmental level analytics on Spark: DataFrame in, DataFrame out."""
