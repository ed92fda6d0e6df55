"""Aggregates and joins beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions.cleaning import col, finite


def group_moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long table (keys, feature, n, mean, var, std, cv) of finite values, ddof 1; one shuffle of partial aggregates."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(col(c).cast("double")).alias("x")) for c in columns])).alias("f")
    long = df.select(*keys, pairs).select(*keys, "f.*")
    out = long.groupBy(*keys, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.stddev_samp("x").alias("std"))
    return out.withColumn("cv", F.try_divide("std", "mean"))


def composition(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, share): column sums over their total in the group, 0 where the total is 0."""
    sums = df.groupBy(*keys).agg(*[F.coalesce(F.sum(finite(col(c))), F.lit(0.0)).alias(c) for c in columns])
    total = sum((col(c) for c in columns[1:]), col(columns[0]))
    return sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.try_divide(col(c), total), F.lit(0.0)).alias("share")) for c in columns])).alias("f")).select(*keys, "f.*")


def lookup(df: DataFrame, table: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first row of each key of the lookup table, so that no row of df is lost or multiplied."""
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").select(key, *columns)
    return df.join(first, key, "left")


def assert_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """df, or an error naming keys that have more than one value."""
    bad = df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{key} with several values of {value}: {[r[key] for r in bad]}")
    return df


def fill_grid(df: DataFrame, keys: list[str], category: str, values: list, columns: list[str]) -> DataFrame:
    """df with a row for every key and every category value, missing numbers 0."""
    grid = df.select(*keys).distinct().withColumn(category, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df, [*keys, category], "left").na.fill(0, subset=columns)


def pivot_wide(df: DataFrame, keys: list[str], category: str, values: list, value: str, fill: float | None = 0.0) -> DataFrame:
    """One column for each given category; values are listed, so no extra pass looks for them."""
    out = df.groupBy(*keys).pivot(category, values).agg(F.first(value))
    return out if fill is None else out.na.fill(fill)


def location_correct(value: Column, batch: str) -> Column:
    """x - mean of its batch + mean of all."""
    return value - F.avg(value).over(Window.partitionBy(batch)) + F.avg(value).over(Window.partitionBy())


def join_texts(c: str, sep: str = ";") -> Column:
    """Aggregate: the group's texts, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_list(c)), sep)


def ordinal_levels(df: DataFrame, column: str, name: str, share: float = 0.8) -> DataFrame:
    """df with the category's place among all categories, from 0: by number if more than `share` of the values are numbers (others get
    null), else as text. Null stays null. Only the distinct categories are sorted."""
    text = F.col(f"`{column}`").cast("string")
    number = text.try_cast("double")
    known = df.agg(F.count(number), F.count(text)).first()
    value = number if known[1] and known[0] > share * known[1] else text
    levels = df.select(value.alias("_v")).where("_v is not null").distinct()
    levels = levels.withColumn(name, F.row_number().over(Window.orderBy("_v")) - 1)  # one row per category
    return df.withColumn("_v", value).join(F.broadcast(levels) if levels.limit(10_001).count() <= 10_000 else levels, "_v", "left").drop("_v")


def join_results(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Result tables left-joined on their key to the first; a column name that comes twice gets its table's name in front."""
    out = None
    for name, t in tables.items():
        if out is None:
            out = t
            continue
        clash = [c for c in t.columns if c in out.columns and c != key]
        out = out.join(t.withColumnsRenamed({c: f"{name}_{c}" for c in clash}), key, "left")
    return out


def zip_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables of the same rows side by side: full joins on a unique key, as rows have no place of their own."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out
