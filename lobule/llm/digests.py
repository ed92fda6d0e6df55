"""Percentiles by merging centroid digests, certified by a counting pass.

A digest is a table of centroids (keys, mean, weight, low, high): sorted values are cut where the scale function
delta / pi * (asin(2 q - 1) + pi / 2) of the quantile q passes an integer, so centroids are small at the tails and never more than
delta. Digests of parts (days, files) are merged by clustering their centroids again with the same function. After estimates are made,
a second pass counts the values below and at each estimate, which certifies its rank error; groups beyond the allowed error are done
again with a finer digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.shared import join_one_row_each, stage

DELTA = 500
SALT_ROWS = 250_000  # distinct values of a group and part that one task sorts; a larger group is cut by hash into digests that are merged
FAN_IN = 64  # digests that are merged at a time
BROADCAST_GROUPS = 50_000  # estimates of up to so many groups are sent to the rows; more are joined by shuffle


def compress(centroids: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Cluster the centroids of each key anew; values are centroids with low = high = mean. Works for building and for merging."""
    by = Window.partitionBy(*keys)
    running = by.orderBy("mean", "low", "high", "weight").rowsBetween(Window.unboundedPreceding, 0)
    q = (F.sum("weight").over(running) - F.col("weight") / 2) / F.sum("weight").over(by)
    bucket = F.floor((F.asin(2 * q - 1) / F.pi() + 0.5) * delta)
    marked = centroids.withColumn("bucket", bucket)
    mean = F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")
    return marked.groupBy(*keys, "bucket").agg(mean.alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")).drop("bucket")


def build_digests(values: DataFrame, keys: list[str], part: list[str], delta: int = DELTA, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One digest per key and part of a table (keys, part, value, weight); weight counts equal values.

    A group of more than `salt_rows` distinct values is cut by hash into as many digests as it needs, others are not; these are merged, at
    most FAN_IN at a time. Only the big groups, at most rows / salt_rows, go to the driver.
    """
    by = [*keys, *part]
    plain = values.select(*by, F.col("value").alias("mean"), F.col("weight").cast("double"), F.col("value").alias("low"), F.col("value").alias("high"))
    big = values.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > salt_rows).collect()
    if not big:
        return compress(plain, by, delta)
    group = F.xxhash64(*by)
    pieces = {r["h"]: -(-r["n"] // salt_rows) for r in values.sparkSession.createDataFrame(big).select(group.alias("h"), "n").collect()}
    times = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for h, c in pieces.items() for x in (h, c)]), group), F.lit(1).cast("long"))
    return merge_pieces(plain.withColumn("piece", F.pmod(F.xxhash64("mean"), times)), by, max(pieces.values()), delta)


def merge_pieces(pieces: DataFrame, keys: list[str], count: int, delta: int = DELTA) -> DataFrame:
    """Digests of a column `piece` (0 .. count - 1) of each key, merged to one per key, at most FAN_IN at a time."""
    out = compress(pieces, [*keys, "piece"], delta)
    while count > FAN_IN:
        out = compress(out.withColumn("piece", F.floor(F.col("piece") / FAN_IN)), [*keys, "piece"], delta)
        count = -(-count // FAN_IN)
    return compress(out.drop("piece"), keys, delta) if count > 1 else out.drop("piece")


def merge_digests(digests: DataFrame, keys: list[str], part: list[str], delta: int = DELTA, parts: int | None = None) -> DataFrame:
    """One digest per key from those of its parts (days, files, runs), which may have been saved at different times; at most FAN_IN, about,
    are merged at a time. parts: how many parts a key has at most, counted if not given."""
    if parts is None:
        parts = digests.select(*part).distinct().count()
    if parts <= FAN_IN:
        return compress(digests.drop(*part), keys, delta)
    count = -(-parts // FAN_IN)
    return merge_pieces(digests.withColumn("piece", F.pmod(F.xxhash64(*part), F.lit(count))).drop(*part), keys, count, delta)


def estimate(digests: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """(keys, n, percent, estimate) by linear interpolation between the middles of neighbouring centroids of one digest per key."""
    by = Window.partitionBy(*keys)
    order = by.orderBy("mean", "low", "high", "weight")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    c = digests.withColumns({
        "n": F.sum("weight").over(by), "upto": F.sum("weight").over(running), "place": F.row_number().over(order), "of": F.count("*").over(by),
        "least": F.min("low").over(by), "most": F.max("high").over(by), "next": F.lead("mean").over(order), "next_weight": F.lead("weight").over(order),
    })
    c = c.withColumn("middle", F.col("upto") - F.col("weight") / 2).withColumn("next_middle", F.col("upto") + F.coalesce("next_weight", F.lit(0.0)) / 2)
    c = c.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("target", F.col("n") * F.col("percent") / 100)
    before = (F.col("place") == 1) & (F.col("target") < F.col("middle"))
    after = (F.col("place") == F.col("of")) & (F.col("target") >= F.col("middle"))
    between = (F.col("target") >= F.col("middle")) & (F.col("target") < F.col("next_middle")) & (F.col("place") < F.col("of"))
    value = (
        F.when(before, F.col("least") + (F.col("mean") - F.col("least")) * F.col("target") / F.col("middle"))
        .when(after, F.col("mean") + (F.col("most") - F.col("mean")) * F.least(F.lit(1.0), F.try_divide(F.col("target") - F.col("middle"), F.col("weight") / 2)))
        .otherwise(F.col("mean") + (F.col("next") - F.col("mean")) * (F.col("target") - F.col("middle")) / (F.col("next_middle") - F.col("middle")))
    )
    return c.where(before | after | between).select(*keys, F.col("n").cast("long").alias("n"), "percent", value.alias("estimate"))


def certify(values: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank_error to the estimates: how far percent / 100 lies outside the true ranks of the estimate, as a share of n."""
    lists = estimates.groupBy(*keys).agg(F.first("n").alias("n"), F.collect_list(F.struct("percent", "estimate")).alias("e"))
    few = lists.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = values.groupBy(*keys, "value").agg(F.sum("weight").alias("weight")) if not few else values
    joined = (rows.join(F.broadcast(lists), keys) if few else join_one_row_each(rows, lists.withColumn("size", F.col("n")), keys, "size")).select(*keys, "n", "value", "weight", F.explode("e").alias("e"))
    counted = joined.groupBy(*keys, "e.percent", "e.estimate").agg(
        F.first("n").alias("n"), F.sum(F.when(F.col("value") < F.col("e.estimate"), F.col("weight")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("e.estimate"), F.col("weight")).otherwise(0)).alias("upto")
    )
    p = F.col("percent") / 100
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - p, p - F.greatest("upto", "below") / F.col("n"))
    return counted.select(*keys, "n", "percent", "estimate", error.alias("rank_error"))


def percentiles(values: DataFrame, keys: list[str], part: list[str], percents: list[float], delta: int = DELTA, tolerance: float = 0.003, salt_rows: int = SALT_ROWS, rounds: int = 4) -> DataFrame:
    """(keys, n, percent, estimate, rank_error) of every key of a table (keys, part, value).

    rank_error is certified by counting: the estimate's true rank is that close to the percentile. A group with an error above
    `tolerance` (a share of its n; half a value at least, as estimates lie between values) is done again with four times the centroids,
    up to `rounds` times. Rows with a null, NaN or infinite value take no part; null keys and parts are keys of their own; equal values
    count as often as they occur. An empty table gives an empty result. Other columns are ignored.
    """
    value = F.col("value").cast("double")
    names = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(k) for k in [*keys, *part]]
    kept = values.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    rows = stage(kept.select(*names, (value + 0.0).alias("value")).groupBy(*keys, *part, "value").agg(F.count("*").alias("weight")), "values")
    parts = rows.select(*part).distinct().count()
    open_rows, done = rows, None
    for i in range(rounds):
        days = build_digests(open_rows, keys, part, delta * 4**i, salt_rows)
        whole = merge_digests(days, keys, part, delta * 4**i, parts)
        found = stage(certify(open_rows, stage(estimate(whole, keys, percents), "estimates"), keys), "certified")
        bad = found.where(F.col("rank_error") > F.greatest(F.lit(tolerance), 1 / F.col("n"))).select(*keys).distinct()
        if i == rounds - 1 or bad.isEmpty():
            done = found if done is None else done.unionByName(found)
            break
        bad = stage(bad, "open")
        good = found.join(bad, keys, "left_anti")
        done = good if done is None else done.unionByName(good)
        open_rows = stage(open_rows.join(bad, keys, "left_semi"), "values")
    return done.select(*[F.when(F.col(k) != "\0null", F.col(k)).alias(k) for k in keys], "n", "percent", "estimate", "rank_error")
