"""Operators of a training-data pipeline over a table of documents; nothing else in the library imports them."""

from skyfold.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
