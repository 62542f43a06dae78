"""Weftline: a Spark-first engine for time-stamped text and knowledge objects."""
