"""Alignment of two modalities along one axis: Wasserstein distances, supports, consensus, assignment, transfer."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.operators.drift import matching


def wasserstein(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, w): distance of the distributions of (a, x) and (b, x), for every pair of categories of the two tables.

    The pairs of categories are few; values are counted first, so equal ones travel once. W = integral of |F - G|.
    """
    la = left.where("x is not null").groupBy("a", "x").agg(F.count("*").alias("n")).withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    rb = right.where("x is not null").groupBy("b", "x").agg(F.count("*").alias("n")).withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("b")))
    a, b = la.select("a").distinct(), rb.select("b").distinct()
    both = la.join(b, how="inner", on=F.lit(True)).select("a", "b", "x", "n").unionByName(rb.join(a, how="inner", on=F.lit(True)).select("a", "b", "x", (-F.col("n")).alias("n")))
    steps = both.groupBy("a", "b", "x").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("a", "b").orderBy("x")
    gap = F.abs(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.withColumns({"g": gap, "next": F.lead("x").over(by)}).groupBy("a", "b").agg(F.coalesce(F.sum(F.col("g") * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("w"))


def interval(df: DataFrame, category: str) -> DataFrame:
    """(category, n, mean, low, high): the 10-90 % range."""
    return df.where("x is not null").groupBy(category).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", 0.1).alias("low"), F.percentile("x", 0.9).alias("high"))


def normalised(df: DataFrame, value: str) -> DataFrame:
    """The value over its row a's sum, uniform where that is 0."""
    by = Window.partitionBy("a")
    return df.withColumn(value, F.coalesce(F.try_divide(F.col(value), F.sum(value).over(by)), 1 / F.count("*").over(by)))


def consensus(left: DataFrame, right: DataFrame, least: int = 10, tau: float | None = None) -> DataFrame:
    """(a, b, w, consensus): row-normalised mean of three row-normalised supports: exp(-W / tau) where both categories have at least
    `least` rows, 1 / (1 + difference of mean ranks), and the overlap of the 10-90 % ranges. tau: by default the median W."""
    w = wasserstein(left, right)
    ia = interval(left, "a").withColumn("ra", F.rank().over(Window.orderBy("mean")) + (F.count("*").over(Window.partitionBy("mean")) - 1) / 2)
    ib = interval(right, "b").withColumn("rb", F.rank().over(Window.orderBy("mean")) + (F.count("*").over(Window.partitionBy("mean")) - 1) / 2)
    joined = w.join(ia.select("a", F.col("n").alias("na"), "ra", F.col("low").alias("la"), F.col("high").alias("ha")), "a").join(ib.select("b", F.col("n").alias("nb"), "rb", F.col("low").alias("lb"), F.col("high").alias("hb")), "b")
    scale = F.lit(tau) if tau else F.percentile("w", 0.5).over(Window.partitionBy())
    both, span = F.greatest(F.lit(0.0), F.least("ha", "hb") - F.greatest("la", "lb")), F.greatest("ha", "hb") - F.least("la", "lb")
    out = joined.withColumns({
        "s1": F.when((F.col("na") >= least) & (F.col("nb") >= least), F.coalesce(F.exp(-F.try_divide(F.col("w"), scale)), F.lit(1.0))).otherwise(0.0),
        "s2": 1 / (1 + F.abs(F.col("ra") - F.col("rb"))), "s3": F.coalesce(F.try_divide(both, span), F.lit(0.0)),
    })
    for s in ("s1", "s2", "s3"):
        out = normalised(out, s)
    return normalised(out.withColumn("consensus", (F.col("s1") + F.col("s2") + F.col("s3")) / 3), "consensus").select("a", "b", "w", "consensus")


def assign(w: DataFrame) -> DataFrame:
    """(a, b, w) of the assignment of least total w; unknown w count as 1.1 times the largest. For tables of categories."""
    rows = w.toPandas()
    a, b = sorted(rows["a"].unique()), sorted(rows["b"].unique())
    cost = np.full((len(a), len(b)), np.nan)
    for x, y, v in zip(rows["a"], rows["b"], rows["w"]):
        cost[a.index(x), b.index(y)] = v
    top = np.nanmax(cost) if np.isfinite(cost).any() else 1.0
    cost = np.where(np.isnan(cost), 1.1 * top, cost)
    pairs = matching(cost.max() + 1 - cost)
    schema = w.select("a", "b", "w").schema
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return w.sparkSession.createDataFrame([(plain(a[i]), plain(b[j]), float(cost[i, j])) for i, j in pairs], schema)


def _consensus_of(x: np.ndarray, counts: np.ndarray, split: int, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(W, consensus) as wasserstein() and consensus() give them, of counts (categories, positions) over the sorted positions x; the
    first `split` rows are the categories a. Categories without a row are NaN."""
    n = counts.sum(1)
    w, out = np.full((2, split, len(n) - split), np.nan)
    a, b = np.flatnonzero(n[:split]), split + np.flatnonzero(n[split:])
    if not len(a) or not len(b):
        return w, out
    below = counts.cumsum(1)
    share, step = below[:, :-1] / np.maximum(n, 1)[:, None], np.diff(x)
    d = np.array([[np.abs(share[i] - share[j]) @ step for j in b] for i in a])

    def quantile(i: int, q: float) -> float:
        at = q * (n[i] - 1)
        low, high = x[np.searchsorted(below[i], [np.floor(at), np.ceil(at)], side="right")]
        return low + (high - low) * (at - np.floor(at))

    mean = counts @ x / np.maximum(n, 1)
    rank = lambda m: (m[:, None] > m).sum(1) + ((m[:, None] == m).sum(1) + 1) / 2
    low, high = (np.array([quantile(i, q) if n[i] else np.nan for i in range(len(n))]) for q in (0.1, 0.9))
    both = np.maximum(0, np.minimum(high[a][:, None], high[b]) - np.maximum(low[a][:, None], low[b]))
    span = np.maximum(high[a][:, None], high[b]) - np.minimum(low[a][:, None], low[b])
    tau = np.median(d)
    s1 = np.where((n[a][:, None] >= least) & (n[b] >= least), np.exp(-d / tau) if tau > 0 else 1.0, 0.0)
    supports = [s1, 1 / (1 + np.abs(rank(mean[a])[:, None] - rank(mean[b]))), np.divide(both, span, out=np.zeros_like(both), where=span > 0)]
    scaled = lambda s: np.where((t := s.sum(1, keepdims=True)) > 0, s / np.where(t > 0, t, 1), 1 / s.shape[1])
    w[np.ix_(a, b - split)], out[np.ix_(a, b - split)] = d, scaled(sum(scaled(s) for s in supports) / 3)
    return w, out


def bootstrap_alignment(left: DataFrame, right: DataFrame, times: int = 300, seed: int = 0, tasks: int = 24) -> DataFrame:
    """(run, a, b, w, consensus, matched, tau) of Poisson resamples of (a, x) and (b, x); tau is the run's median w.

    Rows are counted by category and position first, and Poisson counts drawn for the counts. A task holds all counts for its runs.
    """
    kinds = {**dict(left.dtypes), **dict(right.dtypes)}
    counted = left.where("x is not null").groupBy("a", "x").agg(F.count("*").alias("n")).withColumn("b", F.lit(None).cast(kinds["b"]))
    counted = counted.unionByName(right.where("x is not null").groupBy("b", "x").agg(F.count("*").alias("n")).withColumn("a", F.lit(None).cast(kinds["a"])))
    names = ["run", "a", "b", "w", "consensus", "matched", "tau"]

    def some(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b", "x"])
        a, b = np.unique(rows["a"].dropna()), np.unique(rows["b"].dropna())
        first = rows["a"].notna().to_numpy()
        code = np.where(first, np.searchsorted(a, rows["a"].where(first, a[0] if len(a) else 0)), len(a) + np.searchsorted(b, rows["b"].where(~first, b[0] if len(b) else 0)))
        x, place = np.unique(rows["x"], return_inverse=True)
        size, out = len(a) + len(b), []
        for run in range(key[0], times, tasks):
            drawn = np.random.default_rng([seed, run]).poisson(rows["n"].to_numpy())
            counts = np.bincount(code * len(x) + place, drawn, size * len(x)).reshape(size, -1)
            w, weight = _consensus_of(x, counts, len(a))
            fine = np.isfinite(w)
            if not fine.any():
                continue
            cost = np.where(fine, w, 1.1 * w[fine].max())
            pairs = set(matching(cost.max() + 1 - cost))
            out += [(run, a[i], b[j], w[i, j], weight[i, j], int((i, j) in pairs), np.median(w[fine])) for i in range(len(a)) for j in range(len(b))]
        return pd.DataFrame(out, columns=names)

    schema = f"run int, a {kinds['a']}, b {kinds['b']}, w double, consensus double, matched int, tau double"
    held = counted.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(min(tasks, times) - 1))))
    return held.groupBy("task").applyInPandas(some, schema)


def transfer(weights: DataFrame, means: DataFrame) -> DataFrame:
    """(a, feature, value): consensus-weighted means of the b categories' features (b, feature, mean)."""
    return weights.join(means, "b").groupBy("a", "feature").agg(F.sum(F.col("consensus") * F.col("mean")).alias("value"))


def expected_position(weights: DataFrame, positions: DataFrame) -> DataFrame:
    """(a, expected): consensus-weighted mean position (b, mean) of each a."""
    return weights.join(positions, "b").groupBy("a").agg(F.sum(F.col("consensus") * F.col("mean")).alias("expected"))


def mean_over_set(df: DataFrame, keys: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """(keys, name, score): row mean over the columns of each named set that exist; null values and missing columns don't count."""
    have = set(df.columns)
    parts = []
    for name, columns in sets.items():
        values = F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in columns if c in have]) if have & set(columns) else F.array().cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v))
        parts.append(F.struct(F.lit(name).alias("name"), F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values)).alias("score")))
    return df.select(*keys, F.explode(F.array(*parts)).alias("r")).select(*keys, "r.*")


def rank_agreement(pairs: int) -> float:
    """Standard error of a rank correlation over so many pairs."""
    return math.nan if pairs < 2 else 1 / math.sqrt(pairs - 1)


def unit_wasserstein(left: DataFrame, right: DataFrame, most: int = 500, seed: int = 1) -> DataFrame:
    """(a, b, support, w): mean distance between the distributions of category a in one unit of left and category b in one of right, over
    all pairs of units that have them, or over `most` pairs drawn with replacement where there are more; support: the number of pairs.

    left (a, unit, x), right (b, unit, x). Draws come from hashed numbers, so they don't depend on partitioning. Only drawn pairs meet.
    """
    from lobule.operators.ranking import scatter

    def units(df: DataFrame, c: str) -> DataFrame:
        by = Window.partitionBy(c)
        return df.select(c, "unit").distinct().select(c, F.col("unit").alias(f"u{c}"), (F.row_number().over(by.orderBy("unit")) - 1).alias(f"i{c}"), F.count("*").over(by).alias(f"n{c}"))

    known = lambda df, c: df.where(F.col(c).isNotNull() & F.col("unit").isNotNull() & F.col("x").isNotNull())
    left, right = known(left, "a"), known(right, "b")
    ua, ub = units(left, "a"), units(right, "b")
    sizes = ua.select("a", "na").distinct().join(ub.select("b", "nb").distinct(), how="inner", on=F.lit(True))  # pairs of categories
    drawn = sizes.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("na") * F.col("nb"), F.lit(most)) - 1)))
    every = F.col("na") * F.col("nb") <= most
    pick = lambda s, n: (scatter(F.col("t"), s) / 64).cast("long") % n
    drawn = drawn.withColumns({"ia": F.when(every, F.floor(F.col("t") / F.col("nb"))).otherwise(pick(seed, F.col("na"))), "ib": F.when(every, F.col("t") % F.col("nb")).otherwise(pick(seed + 1, F.col("nb")))})
    pairs = drawn.join(ua.drop("na"), ["a", "ia"]).join(ub.drop("nb"), ["b", "ib"]).select("a", "b", "t", "ua", "ub")
    share = lambda df, c, sign: df.groupBy(c, F.col("unit").alias(f"u{c}"), "x").agg(F.count("*").alias("n")).withColumn("n", sign * F.col("n") / F.sum("n").over(Window.partitionBy(c, f"u{c}")))
    both = pairs.join(share(left, "a", 1), ["a", "ua"]).select("a", "b", "t", "x", "n").unionByName(pairs.join(share(right, "b", -1), ["b", "ub"]).select("a", "b", "t", "x", "n"))
    steps = both.groupBy("a", "b", "t", "x").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("a", "b", "t").orderBy("x")
    gap = F.abs(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = steps.withColumns({"g": gap, "next": F.lead("x").over(by)}).groupBy("a", "b", "t").agg(F.coalesce(F.sum(F.col("g") * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("w"))
    return each.groupBy("a", "b").agg(F.count("*").alias("support"), F.avg("w").alias("w"))


def reconstruction_error(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, w): distance of category a's distribution from the mixture of the b categories by their weights (a, b, consensus), exactly, by
    weighted cumulative curves. Categories without rows on either side are left out."""
    share = lambda df, c: df.where("x is not null").groupBy(c, "x").agg(F.count("*").alias("n")).withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy(c)))
    whole = F.sum("consensus").over(Window.partitionBy("a"))
    mix = weights.withColumn("weight", F.try_divide("consensus", whole)).join(share(right, "b"), "b").groupBy("a", "x").agg((-F.sum(F.col("weight") * F.col("n"))).alias("n"))
    steps = share(left, "a").unionByName(mix).groupBy("a", "x").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("a").orderBy("x")
    gap = F.abs(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.withColumns({"g": gap, "next": F.lead("x").over(by)}).groupBy("a").agg(F.coalesce(F.sum(F.col("g") * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("w")).join(weights.select("a").distinct(), "a", "left_semi")


def tau_sensitivity(left: DataFrame, right: DataFrame, times: tuple) -> DataFrame:
    """(a, times, corr): correlation over b of the consensus with that at `times` tau, both without the mask of small categories; null where
    one of them doesn't vary."""
    base = consensus(left, right, 0)
    tau = base.agg(F.percentile("w", 0.5)).first()[0] or 1.0
    out = None
    for t in times:
        other = consensus(left, right, 0, tau * t).select("a", "b", F.col("consensus").alias("other"))
        part = base.join(other, ["a", "b"]).groupBy("a").agg(F.when((F.stddev_pop("consensus") > 1e-15) & (F.stddev_pop("other") > 1e-15), F.corr("consensus", "other")).alias("corr")).withColumn("times", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out.select("a", "times", "corr")


def transfer_intervals(weights: DataFrame, rows: DataFrame, key: str, names: list[str], times: int = 500, buckets: int = 512, seed: int = 0) -> DataFrame:
    """(a, feature, value, low, high): consensus-weighted feature means and their 95 % bootstrap limits.

    rows (key, b, names): one pass brings every category down to sums over `buckets` hashed groups of rows; a resample draws Poisson copies
    of these groups, so limits are those of a bootstrap by groups, exact where a category has no more rows than buckets, and nothing but
    categories x buckets sums is resampled. Unknown values take no part.
    """
    bucket = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)).cast("int")
    sums = rows.groupBy("b", bucket.alias("bucket")).agg(*[x for i, c in enumerate(names) for x in (F.sum(F.col(f"`{c}`")).alias(f"s{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}"))]).toPandas().sort_values(["b", "bucket"])
    w = weights.select("a", "b", "consensus").toPandas()
    cats = sorted(set(sums["b"]) & set(w["b"]))
    matrix = w[w["b"].isin(cats)].pivot_table(index="a", columns="b", values="consensus", fill_value=0.0)
    rng = np.random.default_rng(seed)
    boot, value = np.zeros((times, len(matrix), len(names))), np.zeros((len(matrix), len(names)))
    for b in matrix.columns:
        mine = sums[sums["b"] == b]
        s, n = mine[[f"s{i}" for i in range(len(names))]].fillna(0.0).to_numpy(float), mine[[f"n{i}" for i in range(len(names))]].to_numpy(float)
        copies = rng.poisson(1.0, size=(times, len(mine)))
        with np.errstate(invalid="ignore", divide="ignore"):
            boot += matrix[b].to_numpy()[None, :, None] * ((copies @ s) / (copies @ n))[:, None, :]
            value += np.outer(matrix[b].to_numpy(), s.sum(0) / n.sum(0))
    low, high = np.nanpercentile(boot, 2.5, axis=0), np.nanpercentile(boot, 97.5, axis=0)
    plain = lambda v: v.item() if hasattr(v, "item") else v
    out = [(plain(a), f, float(value[i, j]), float(low[i, j]), float(high[i, j])) for i, a in enumerate(matrix.index) for j, f in enumerate(names)]
    return weights.sparkSession.createDataFrame(out, f"a {dict(weights.dtypes)['a']}, feature string, value double, low double, high double")
