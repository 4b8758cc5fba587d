"""Siftstone: a PySpark engine for the data side of code-review findings."""
