"""Panel analytics on Spark: climate exposure, yields, coverage and panel models."""
