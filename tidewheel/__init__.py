"""Keyed cyclic time-series analytics on PySpark."""
