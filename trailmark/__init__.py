"""Tracking of several individuals from per-frame probability maps, and training-corpus operators, on PySpark."""
