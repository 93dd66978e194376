"""Operators over DataFrames: validation, flatten, metadata merge, reads and joins, stats, retention, extensions."""
