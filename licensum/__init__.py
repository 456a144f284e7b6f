"""Licensing-register analytics on Spark: DataFrame in, DataFrame out."""
