"""Bins along an axis, histograms, entropy and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_closed(x: Column, low: float | Column, high: float | Column, n: int) -> Column:
    """Bin 0..n-1 of (a, b], the lowest edge included; null outside and for null or NaN."""
    low, high = F.lit(low), F.lit(high)
    at = F.ceil((x - low) / ((high - low) / n)) - 1
    return F.when(x.between(low, high) & ~F.isnan(x), F.least(F.lit(n - 1), F.greatest(F.lit(0), at)).cast("int"))


def left_closed(x: Column, low: float | Column, high: float | Column, n: int, close_last: bool = False) -> Column:
    """Bin 0..n-1 of [a, b); the highest edge is outside unless close_last."""
    low, high = F.lit(low), F.lit(high)
    at = F.floor((x - low) / ((high - low) / n))
    inside = (x >= low) & ((x <= high) if close_last else (x < high)) & ~F.isnan(x)
    return F.when(inside, F.least(F.lit(n - 1), at).cast("int"))


def snapped_range(low: float | None, high: float | None, near: float = 1.2) -> tuple[float, float]:
    """(-1, 1) if the data lie within +-near, else their own range; an empty range is widened by 0.5 each way."""
    if low is None or high is None or (low >= -near and high <= near):
        return -1.0, 1.0
    return (low, high) if low < high else (low - 0.5, high + 0.5)


def quantile_bins(df: DataFrame, value: str, n: int, keys: list[str]) -> DataFrame:
    """Adds `bin` 0..k-1 by the value's exact quantiles in each group, right-closed; equal edges are merged. Null values get null."""
    at = [i / n for i in range(n + 1)]
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile(F.col(f"`{value}`"), at)).alias("edges"))
    joined = df.join(edges, keys)  # as many rows as groups; the planner broadcasts it if it is small
    below = F.size(F.filter("edges", lambda e: e < F.col(f"`{value}`")))
    return joined.withColumn("bin", F.when(F.col(f"`{value}`").isNotNull(), F.greatest(F.lit(0), below - 1))).drop("edges")


def histogram(df: DataFrame, value: Column, low: float, high: float, n: int, keys: list[str]) -> DataFrame:
    """(keys, bin, n) with a row for every bin of every group, empty ones too; the last bin is closed."""
    counted = df.withColumn("bin", left_closed(value, low, high, n, True)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shares(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, category, n, share): counts of categories and their share within the keys."""
    counted = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy()))


def plogp(p: Column, base: str = "log2") -> Column:
    """-p log p, 0 where p is 0."""
    return F.when(p > 0, -p * (F.log2(p) if base == "log2" else F.ln(p))).otherwise(0.0)


def diversity(df: DataFrame, keys: list[str], category: str, possible: int | None = None, base: str = "log2") -> DataFrame:
    """(keys, n_cells, H, D, E): Shannon H, Simpson dominance D = sum p^2, evenness H / log(possible).

    possible defaults to the number of categories observed in the group; one category gives E = null.
    """
    counted = shares(df, keys, category)
    k = F.lit(possible) if possible else F.count("*")
    span = F.log2(k.cast("double")) if base == "log2" else F.ln(k.cast("double"))
    out = counted.groupBy(*keys).agg(F.sum("n").alias("n_cells"), F.sum(plogp(F.col("share"), base)).alias("H"), F.sum(F.col("share") * F.col("share")).alias("D"), span.alias("span"))
    return out.withColumn("E", F.try_divide("H", "span")).drop("span")


def diversity_curve(df: DataFrame, keys: list[str], position: Column, category: str, low: float, high: float, n: int, possible: int, base: str = "log2") -> DataFrame:
    """diversity() of every bin of the axis, empty bins with n_cells 0 and null indices; adds the bin's edges and middle."""
    binned = df.withColumn("bin", right_closed(position, low, high, n)).where("bin is not null")
    found = diversity(binned, [*keys, "bin"], category, possible, base)
    width = (high - low) / n
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wide = grid.join(found, [*keys, "bin"], "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    return wide.withColumns({"bin_left": F.lit(low) + F.col("bin") * width, "bin_right": F.lit(low) + (F.col("bin") + 1) * width})


def conditional_entropy(df: DataFrame, keys: list[str], category: str, bin_name: str = "bin") -> DataFrame:
    """(keys, h, h_given, fraction_explained, accuracy): entropy of the category over all rows, its mean entropy within bins over the rows
    that have a bin, 1 - h_given / h, and the accuracy of guessing each bin's commonest category."""
    whole = diversity(df, keys, category).select(*keys, F.col("H").alias("h"))
    inside = shares(df.where(F.col(bin_name).isNotNull()), [*keys, bin_name], category)
    of_bin = inside.groupBy(*keys, bin_name).agg(F.sum("n").alias("m"), F.sum(plogp(F.col("share"))).alias("hb"), F.max("share").alias("top"))
    given = of_bin.groupBy(*keys).agg((F.sum(F.col("m") * F.col("hb")) / F.sum("m")).alias("h_given"), (F.sum(F.col("m") * F.col("top")) / F.sum("m")).alias("accuracy"))
    joined = whole.join(given, keys, "left")
    return joined.withColumn("fraction_explained", 1 - F.try_divide("h_given", "h"))


def pooled_curve(df: DataFrame, replicate: str, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sem, n): mean over replicates' means and its standard error with ddof 0, replicates without values left out."""
    each = df.groupBy(*keys, replicate).agg(F.avg(value).alias("m")).where("m is not null")
    return each.groupBy(*keys).agg(F.avg("m").alias("mean"), (F.stddev_pop("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def data_range_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Adds `bin` 1..n of equal width over the value's own range, right-closed, the smallest value in the first; one value alone is bin 1."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.withColumn("bin", F.lit(None).cast("int"))
    if low == high:
        return df.withColumn("bin", F.when(F.col(value).isNotNull(), 1))
    return df.withColumn("bin", right_closed(F.col(value), low, high, n) + 1)


def zero_filled(curve: DataFrame) -> DataFrame:
    """The indices of empty bins as zeros, where 0 stands for no diversity."""
    return curve.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("H", "D", "E")})
