"""Column rules built from Spark's own functions."""
