"""Diversity of categories along the axis over a stream: counts are state, indices are read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.operators.bins import plogp, right_closed


def bin_counts(stream: DataFrame, keys: list[str], position: str, category: str, low: float, high: float, n: int) -> DataFrame:
    """(keys, bin, category, n): running counts; use output mode complete or update. Rows outside the range or without category stay out."""
    binned = stream.withColumn("bin", right_closed(F.col(position), low, high, n)).where(F.col("bin").isNotNull() & F.col(category).isNotNull())
    return binned.groupBy(*keys, "bin", category).agg(F.count("*").alias("n"))


def indices(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n_cells, H, D) from a table of running counts, for instance inside foreachBatch."""
    n_cells = F.sum("n").over(Window.partitionBy(*keys, "bin"))  # a window, as a memory table can't be joined with itself
    p = counts.withColumn("n_cells", n_cells).withColumn("p", F.col("n") / F.col("n_cells"))
    return p.groupBy(*keys, "bin").agg(F.first("n_cells").alias("n_cells"), F.sum(plogp(F.col("p"))).alias("H"), F.sum(F.col("p") * F.col("p")).alias("D"))
