"""Ranks, top rows, normalisation, samples and splits by hash, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LCG = 2147483648


def scatter(key: Column, seed: int = 0) -> Column:
    """A reproducible scattering of integer keys over 0 .. 2^31 - 1, the same in any engine with 64-bit integers."""
    mixed = (key % LCG * 1103515245 + 12345 + seed * 7919) % LCG
    return (mixed * 69069 + 1) % LCG


def average_rank(value: Column, keys: list[str]) -> Column:
    """Rank from 1, tied values sharing the mean of their places."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(by.partitionBy(*keys, value)) - 1) / 2


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the row_number filter lets the planner cut groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def top_with_forced(df: DataFrame, keys: list[str], order: list[Column], k: int, forced: Column) -> DataFrame:
    """The first k rows of each group, and the first row for which `forced` holds if it isn't among them."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("place", F.row_number().over(by.orderBy(*order))).withColumn("is_forced", forced)
    ranked = ranked.withColumn("first_forced", F.min(F.when(F.col("is_forced"), F.col("place"))).over(by))
    return ranked.where((F.col("place") <= k) | (F.col("place") == F.col("first_forced"))).drop("first_forced", "is_forced")


def best_row(df: DataFrame, keys: list[str], value: str, tie: str, columns: list[str], smallest: bool = False) -> DataFrame:
    """The row with the largest (or smallest) value of each group, ties by the smallest `tie`; null values never win."""
    sign = F.col(value) if smallest else -F.col(value)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(sign, F.col(tie))).alias("r"))
    return rows.select(*keys, "r.*")


def extreme_share(df: DataFrame, value: str, tie: str, share: float = 0.1) -> DataFrame:
    """Rows among the top or bottom share by value, marked in `side`; the number is max(1, round(share n)), at most n // 2.

    The limits are found by a distributed sort and limit, not by ranking all rows in one task.
    """
    known = df.where(F.col(value).isNotNull())
    total = known.count()
    n = min(max(1, round(share * total)), total // 2) if total > 1 else total
    top = known.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(known.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("bottom")))


def minmax(value: Column, keys: list[str], constant: float | None = 0.5) -> Column:
    """(x - min) / (max - min) within the group; `constant` where the group has one value only."""
    by = Window.partitionBy(*keys)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(value.isNotNull(), F.coalesce(F.try_divide(value - low, high - low), F.lit(constant)))


def scaled(df: DataFrame, columns: list[str], how: str = "zscore", ddof: int = 0, clip: float | None = None, fitted_on: DataFrame | None = None) -> DataFrame:
    """The columns as z-scores (ddof 0 or 1), centred, or min-max scaled, by statistics of `fitted_on` (default: the table itself).

    One aggregate pass; its single row is put into the plan as literals. Constant columns are divided by 1; nulls stay.
    """
    source = df if fitted_on is None else fitted_on
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = source.agg(*[x for i, c in enumerate(columns) for x in (F.avg(f"`{c}`").alias(f"m{i}"), std(f"`{c}`").alias(f"s{i}"), F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"b{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        if how == "minmax":
            low, width = row[f"a{i}"] or 0.0, (row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0)
            y = (x - F.lit(float(low))) / F.lit(float(width) or 1.0)
        else:
            y = x - F.lit(float(row[f"m{i}"] or 0.0))
            if how == "zscore":
                y = y / F.lit(float(row[f"s{i}"] or 0.0) or 1.0)
        if clip is not None:
            y = F.when(y.isNotNull(), F.least(F.greatest(y, F.lit(-clip)), F.lit(clip)))
        out[c] = y
    return df.withColumns(out)


def row_normalise(df: DataFrame, row: list[str], value: str) -> DataFrame:
    """Adds `p`: the value over its row's sum; rows whose sum is 0 or unknown become uniform."""
    by = Window.partitionBy(*row)
    return df.withColumn("p", F.coalesce(F.try_divide(F.col(value), F.sum(value).over(by)), 1 / F.count("*").over(by)))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), those first in the key's scattered order."""
    return df.orderBy(scatter(F.col(key), seed), key).limit(n)


def fraction_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows, chosen by the key alone, so the choice doesn't depend on partitioning."""
    return df.where(scatter(F.col(key), seed) < int(share * LCG))


def folds(key: Column, k: int, seed: int = 0) -> Column:
    """Fold 0..k-1 of a row, by its key."""
    return (scatter(key, seed) / 64).cast("long") % k


def is_train(key: Column, share: float = 0.8, seed: int = 0) -> Column:
    return scatter(key, seed) < int(share * LCG)


def bootstrap(df: DataFrame, key: str, times: int, seed: int = 0) -> DataFrame:
    """Each row with `run` 0..times-1 and `copies`, its Poisson(1) number of copies in that resample; rows with none are left out.

    Counts come from the key's scattered order, so no row is moved between tasks; resamples have n rows on average.
    """
    chance = scatter(F.col(key) * 1_000_003 + F.col("run"), seed) / LCG
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    copies = sum(((chance >= s).cast("int") for s in steps), F.lit(0))
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("copies", copies).where("copies > 0")


def permute_within(df: DataFrame, strata: list[str], value: str, key: str, seed: int = 0) -> DataFrame:
    """The value shuffled within each stratum, as column `shuffled`: values in scattered order meet rows in key order."""
    rows = df.withColumn("at", F.row_number().over(Window.partitionBy(*strata).orderBy(key)))
    drawn = df.select(*strata, F.col(value).alias("shuffled"), F.row_number().over(Window.partitionBy(*strata).orderBy(scatter(F.col(key), seed), key)).alias("at"))
    return rows.join(drawn, [*strata, "at"]).drop("at")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all parts under one schema, missing columns null, with the part's name in `tag`."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def outlier_cut(df: DataFrame, value: str, quantile: float = 0.99, most: float = 0.999, least_rows: int = 3) -> DataFrame:
    """Rows whose value lies below the smaller of its quantile and `most`; if fewer than `least_rows` stay, below `most` alone."""
    x = F.col(value)
    known = df.where(x.isNotNull() & ~F.isnan(x))
    q = known.agg(F.percentile(x, quantile)).first()[0]
    cut = most if q is None else min(q, most)
    if known.where(x < cut).limit(least_rows).count() < least_rows <= known.limit(least_rows).count():
        cut = most
    return known.where(x < cut)


def before_after(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """One row of number, minimum, median and maximum of a column in both tables."""
    parts = lambda name: [F.count(value).alias(f"n_{name}"), F.min(value).alias(f"min_{name}"), F.percentile(value, 0.5).alias(f"median_{name}"), F.max(value).alias(f"max_{name}")]
    return before.agg(*parts("before")).crossJoin(after.agg(*parts("after")))  # one row each


def signed_rescale(df: DataFrame, value: str, root: Column, target: Column) -> DataFrame:
    """Adds `signed` and `unit`: rows of the root at 0, of the target side at 0..1 and all others at -1..0, each side by its own largest
    value (0 where that isn't positive), and the same scale from 0 to 1. Unknown values stay null."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    other = ~F.coalesce(root, F.lit(False)) & ~F.coalesce(target, F.lit(False))
    top = df.agg(F.max(F.when(target, x)).alias("t"), F.max(F.when(other, x)).alias("o")).first()

    def part(most: float | None) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / float(most))) if most and most > 0 else F.lit(0.0)

    signed = F.when(x.isNull(), None).when(target, part(top["t"])).when(root, 0.0).otherwise(-part(top["o"]))
    return df.withColumn("signed", signed).withColumn("unit", (F.col("signed") + 1) / 2)


def places_to(df: DataFrame, keys: list[str], share: str, tie: str, threshold: float) -> DataFrame:
    """(keys, needed): how many of a group's rows, largest shares first, add up to the threshold."""
    by = Window.partitionBy(*keys).orderBy(F.desc(share), tie)
    upto = df.withColumns({"_upto": F.sum(share).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(by)})
    return upto.where(F.col("_upto") >= threshold - 1e-12).groupBy(*keys).agg(F.min("_place").alias("needed"))
