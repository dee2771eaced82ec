"""Skyfold: Spark operators that turn large event tables into analysis and training data."""
