"""Spark-native analytics over per-cell and per-organelle tables: operators take and return DataFrames."""
