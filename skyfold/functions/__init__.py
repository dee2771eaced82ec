"""Column functions: each takes columns and returns columns, all evaluated inside Spark's own engine."""
