"""Joinlift: which joinable tables are worth joining, decided on Spark.

The lake is one tall table of cells ``(dataset_id, row_key, col, v)``; every
operator is a DataFrame -> DataFrame function over it.
"""
