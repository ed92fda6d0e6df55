"""Group comparisons, correlation, regression and mixed models. Big tables are reduced to moments by aggregates; only those are solved
on the driver, and tables of p-values are filled by vectorised functions over a few rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions import special
from lobule.functions.cleaning import col, finite
from lobule.operators.ranking import average_rank


def long_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, x) of the finite values of the columns; rows without a key stay out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(col(c).cast("double")).alias("x")) for c in columns])).alias("f")
    return df.select(*keys, pairs).select(*keys, "f.*").where("x is not null").na.drop(subset=keys)


def moments(long: DataFrame, group: str) -> DataFrame:
    return long.groupBy("feature", F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.var_pop("x").alias("vp"))


def anova(long: DataFrame, group: str) -> DataFrame:
    """(feature, k, n, f, eta2) of one-way analysis of variance; null where there are fewer than two groups or no variance within."""
    each = moments(long, group)
    grand = each.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("vp")).alias("within"))
    between = each.join(grand.select("feature", "gm"), "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("between"))
    out = grand.join(between, "feature").withColumn("f", F.when(F.col("k") > 1, F.try_divide(F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k")))))
    return out.select("feature", "k", "n", "f", F.when(F.col("k") > 1, F.try_divide("between", F.col("between") + F.col("within"))).alias("eta2"))


def levene(long: DataFrame, group: str) -> DataFrame:
    """anova() of the distances from the group's exact median (Brown-Forsythe)."""
    centre = long.groupBy("feature", group).agg(F.percentile("x", 0.5).alias("centre"))
    return anova(long.join(centre, ["feature", group]).withColumn("x", F.abs(F.col("x") - F.col("centre"))), group)


def welch(long: DataFrame, group: str) -> DataFrame:
    """(feature, k, f, df1, df2, status) of Welch's analysis of variance over groups of at least two values with some variance."""
    every = moments(long, group)
    each = every.where("n > 1 and v > 0").withColumn("w", F.col("n") / F.col("v"))
    total = each.groupBy("feature").agg(F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mu"))
    parts = each.join(total, "feature").groupBy("feature", "k").agg(F.sum(F.col("w") * (F.col("m") - F.col("mu")) ** 2).alias("a"), F.sum((1 - F.col("w") / F.col("sw")) ** 2 / (F.col("n") - 1)).alias("c"))
    k = F.col("k")
    f = F.when(k > 1, F.col("a") / F.greatest(k - 1, F.lit(1)) / (1 + F.try_divide(2 * (k - 2), k * k - 1) * F.col("c")))
    parts = parts.select("feature", "k", f.alias("f"), (k - 1).cast("double").alias("df1"), F.when(k > 1, F.try_divide(k * k - 1, 3 * F.col("c"))).alias("df2"))
    found = every.select("feature").distinct().join(parts, "feature", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return found.withColumn("status", F.when(F.col("k") < 2, "skipped: fewer than two usable groups").otherwise("ok"))


def pairwise(long: DataFrame, group: str) -> DataFrame:
    """(feature, a, b, diff, t, df, q) of Games-Howell comparisons of each pair of groups a < b; self join of the few moments."""
    each = moments(long, group).where("n > 1")
    left, right = each.select("feature", *[F.col(c).alias(f"{c}1") for c in "gnmv"]), each.select("feature", *[F.col(c).alias(f"{c}2") for c in "gnmv"])
    both = left.join(right, "feature").where("g1 < g2")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(e1 + e2))
    df = F.try_divide((e1 + e2) ** 2, e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))
    return both.select("feature", F.col("g1").alias("a"), F.col("g2").alias("b"), (F.col("m1") - F.col("m2")).alias("diff"), t.alias("t"), df.alias("df"), (t * math.sqrt(2)).alias("q"))


def tukey(long: DataFrame, group: str) -> DataFrame:
    """(feature, a, b, k, diff, q, df) of Tukey-Kramer comparisons with the pooled variance."""
    each = moments(long, group)
    pooled = each.groupBy("feature").agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"), F.sum(F.col("n") * F.col("vp")).alias("within"))
    left, right = each.select("feature", *[F.col(c).alias(f"{c}1") for c in "gnm"]), each.select("feature", *[F.col(c).alias(f"{c}2") for c in "gnm"])
    both = left.join(right, "feature").where("g1 < g2").join(pooled, "feature")
    error = F.sqrt(F.try_divide("within", "df") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return both.select("feature", F.col("g1").alias("a"), F.col("g2").alias("b"), "k", (F.col("m1") - F.col("m2")).alias("diff"), F.try_divide(F.abs(F.col("m1") - F.col("m2")), error).alias("q"), "df")


def with_p(df: DataFrame, name: str, function: Callable, arguments: list[str]) -> DataFrame:
    """Adds a column of the special function of other columns; meant for tables of results, a few rows each."""

    @F.pandas_udf("double")
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else function(*row) for row in zip(*columns)], dtype="float64")

    return df.withColumn(name, apply(*[F.col(a).cast("double") for a in arguments]))


def anova_p(df: DataFrame) -> DataFrame:
    return with_p(df.withColumns({"df1": F.col("k") - 1, "df2": F.col("n") - F.col("k")}), "p", special.f_tail, ["f", "df1", "df2"])


def range_p(q: float, k: float, df: float) -> float | None:
    return special.range_tail(q, int(k), df)


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, n, rho): rank correlation of each column with the target over rows where both are finite; null under 3 rows or if constant."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(col(c).cast("double")).alias("x")) for c in columns])).alias("f")
    both = df.select(finite(col(target).cast("double")).alias("y"), pairs).select("y", "f.*").where("x is not null and y is not null")
    ranked = both.select("feature", average_rank(F.col("x"), ["feature"]).alias("rx"), average_rank(F.col("y"), ["feature"]).alias("ry"))
    spread = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0) & (F.count("*") >= 3)
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), F.when(spread, F.corr("rx", "ry")).alias("rho"))


def pearson(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, n, r) over rows where both are finite."""
    y = finite(col(target).cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(col(c).cast("double")).alias("x")) for c in columns])).alias("f")
    both = df.select(y.alias("y"), pairs).select("y", "f.*").where("x is not null and y is not null")
    return both.groupBy("feature").agg(F.count("*").alias("n"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")).alias("r"))


def correlation_p(df: DataFrame, r: str) -> DataFrame:
    """Adds p of a correlation over n rows, by the t distribution."""
    return with_p(df, "p", lambda rho, n: special.t_two_sided(rho * math.sqrt((n - 2) / max(1e-300, 1 - rho * rho)), n - 2) if n > 2 else None, [r, "n"])


def benjamini_hochberg(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Adds `q`, the false-discovery-adjusted p; null p take no part. For tables of results: one window over all rows."""
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    by = Window.partitionBy(valid)
    m, rank = F.count("*").over(by), F.row_number().over(by.orderBy(p, tie))
    raw = df.withColumn("_raw", F.when(valid, F.col(p) * m / rank)).withColumn("_rank", rank)
    later = Window.partitionBy(F.col("_raw").isNull()).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.when(F.col("_raw").isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(later)))).drop("_raw", "_rank")


def mann_whitney(df: DataFrame, value: str, group: str, control: str) -> DataFrame:
    """(group, n, n_control, u, z) of each other group against the control, z with tie correction."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    others = known.where(F.col(group) != control).select(F.col(group).alias("other")).distinct()
    pool = known.where(F.col(group) != control).select(F.col(group).alias("other"), F.col(value).alias("x"), F.lit(1).alias("mine"))
    pool = pool.unionByName(others.join(known.where(F.col(group) == control).select(F.col(value).alias("x"), F.lit(0).alias("mine")), how="inner", on=F.lit(True)).select("other", "x", "mine"))
    at = pool.groupBy("other", "x").agg(F.count("*").alias("t"), F.sum("mine").alias("m"))
    by = Window.partitionBy("other").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = at.withColumn("rank", F.sum("t").over(by) - (F.col("t") - 1) / 2)
    s = ranked.groupBy("other").agg(F.sum("m").alias("n"), (F.sum("t") - F.sum("m")).alias("n_control"), F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n, c = F.col("n").cast("double"), F.col("n_control").cast("double")
    u = F.col("r") - n * (n + 1) / 2
    sd = F.sqrt(n * c / 12 * ((n + c + 1) - F.col("ties") / ((n + c) * (n + c - 1))))
    return s.select(F.col("other").alias("group"), "n", "n_control", u.alias("u"), F.try_divide(u - n * c / 2, sd).alias("z"))


def ols(df: DataFrame, y: str, terms: dict[str, Column]) -> pd.DataFrame:
    """(term, coef, se, t, p, low, high) of least squares with intercept; the normal equations are one aggregate row.

    Rows with a null term take no part. A singular design raises numpy.linalg.LinAlgError.
    """
    names = ["intercept", *terms]
    rows = df.select(F.lit(1.0).alias("t0"), *[c.cast("double").alias(f"t{i}") for i, c in enumerate(terms.values(), 1)], col(y).cast("double").alias("y")).na.drop()
    k = len(names)
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"t{i}") * F.col("y")) for i in range(k)] + [F.sum(F.col("y") * F.col("y")), F.count("*")]
    got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    xx = np.zeros((k, k))
    at = iter(got)
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = next(at)
    xy = np.array([next(at) for _ in range(k)])
    yy, n = next(at), next(at)
    beta = np.linalg.solve(xx, xy)
    df_left = n - k
    variance = (yy - beta @ xy) / df_left
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(xx)) * variance, 0))
    width = special.t_quantile(0.975, df_left)
    return pd.DataFrame({"term": names, "coef": beta, "se": se, "t": beta / se, "p": [special.t_two_sided(b / s, df_left) for b, s in zip(beta, se)], "low": beta - width * se, "high": beta + width * se})


def group_regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """(keys, n, slope, intercept, r2) of simple regression in each group."""
    fine = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return fine.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def kfold_regression(df: DataFrame, keys: list[str], y: str, x: str, fold: str) -> DataFrame:
    """(keys, n, r2): pooled out-of-fold R2 of simple regression."""
    total = F.sum("syy") - F.sum("sy") ** 2 / F.sum("n")
    return _fold_errors(df, keys, y, x, fold).groupBy(*keys).agg(F.sum("n").alias("n"), (1 - F.try_divide(F.sum("e"), total)).alias("r2"))


def _fold_errors(df: DataFrame, keys: list[str], y: str, x: str, fold: str) -> DataFrame:
    """Each fold's sums and its squared error `e` under the regression fitted on the other folds: the group's sums less the fold's own."""
    fine = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumns({"_x": F.col(x), "_y": F.col(y)})
    part = fine.groupBy(*keys, fold).agg(F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"), F.sum(F.col("_y") * F.col("_y")).alias("syy"))
    by = Window.partitionBy(*keys)
    rest = {c: F.sum(c).over(by) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    trained = part.withColumns({f"r_{c}": v for c, v in rest.items()})
    slope = F.try_divide(F.col("r_n") * F.col("r_sxy") - F.col("r_sx") * F.col("r_sy"), F.col("r_n") * F.col("r_sxx") - F.col("r_sx") ** 2)
    trained = trained.withColumn("b", slope).withColumn("a", F.try_divide(F.col("r_sy") - F.col("b") * F.col("r_sx"), "r_n"))
    b, a = F.col("b"), F.col("a")
    error = F.col("syy") + a * a * F.col("n") + b * b * F.col("sxx") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + 2 * a * b * F.col("sx")
    return trained.withColumn("e", error)


def mixed_model(df: DataFrame, y: str, terms: dict[str, Column], group: str, nested: str | None = None) -> tuple[pd.DataFrame, dict[str, float], np.ndarray]:
    """Restricted maximum likelihood of y = X b + group effect (+ effect of `nested` within group) + error.

    Every group (or nested cell) is reduced to its cross products by one aggregate; likelihoods are then evaluated from them alone, so
    the driver holds a small matrix per group. Rows with a null take no part. Returns (term, coef, se, z, p), the variances, and the covariance matrix of the coefficients.
    """
    names = ["intercept", *terms]
    k = len(names)
    cell = [group, *([nested] if nested else [])]
    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cell)], F.lit(1.0).alias("t0"), *[c.cast("double").alias(f"t{i}") for i, c in enumerate(terms.values(), 1)], col(y).cast("double").alias(f"t{k}")).na.drop()
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    got = rows.groupBy(*[f"_{i}" for i in range(len(cell))]).agg(*sums).toPandas().sort_values([f"_{i}" for i in range(len(cell))])
    cross = np.zeros((len(got), k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            cross[:, i, j] = cross[:, j, i] = got[f"s{i}_{j}"].to_numpy(float)
    owner = got["_0"].factorize()[0]
    n = float(cross[:, 0, 0].sum())

    def weighted(a: float, b: float) -> tuple[np.ndarray, float]:
        """Sum over groups of Z' V^-1 Z and log |V|, Z = [X y], V = I + a J_group + b J_cell; cell sums are Z' 1."""
        ones, size = cross[:, 0, :], cross[:, 0, 0]
        within = cross - (b / (1 + b * size))[:, None, None] * ones[:, :, None] * ones[:, None, :]
        log = np.log1p(b * size).sum()
        shrunk, mass = ones / (1 + b * size)[:, None], size / (1 + b * size)
        group_ones = np.zeros((owner.max() + 1, k + 1))
        np.add.at(group_ones, owner, shrunk)
        group_mass = np.bincount(owner, mass)
        log += np.log1p(a * group_mass).sum()
        return within.sum(0) - np.einsum("g,gi,gj->ij", a / (1 + a * group_mass), group_ones, group_ones), log

    def criterion(logs: np.ndarray) -> float:
        a, b = math.exp(logs[0]), math.exp(logs[1]) if nested else 0.0
        m, log = weighted(a, b)
        sign, det = np.linalg.slogdet(m[:k, :k])
        rss = m[k, k] - m[:k, k] @ np.linalg.solve(m[:k, :k], m[:k, k])
        return (n - k) * math.log(max(rss, 1e-300) / (n - k)) + log + det

    best = np.array([-2.0, -2.0 if nested else -50.0])
    step = 2.0
    value = criterion(best)
    while step > 1e-5:  # compass search over one or two variance ratios
        tries = [best + step * np.array(d) for d in ([1, 0], [-1, 0], *([[0, 1], [0, -1]] if nested else []))]
        scores = [criterion(np.clip(t, -25, 12)) for t in tries]
        i = int(np.argmin(scores))
        best, value, step = (np.clip(tries[i], -25, 12), scores[i], step) if scores[i] < value - 1e-12 else (best, value, step / 2)
    a, b = math.exp(best[0]), math.exp(best[1]) if nested else 0.0
    m, _ = weighted(a, b)
    beta = np.linalg.solve(m[:k, :k], m[:k, k])
    residual = (m[k, k] - m[:k, k] @ beta) / (n - k)
    covariance = np.linalg.inv(m[:k, :k]) * residual
    se = np.sqrt(np.diag(covariance))
    table = pd.DataFrame({"term": names, "coef": beta, "se": se, "z": beta / se, "p": [special.normal_two_sided(x) for x in beta / se]})
    return table, {"residual": residual, "group": a * residual, "nested": b * residual}, covariance


def contrast(estimate: np.ndarray, covariance: np.ndarray, weights: np.ndarray) -> dict[str, float]:
    """Wald test of a linear combination: estimate, se, z, p and the 95 % interval."""
    value, se = float(weights @ estimate), float(np.sqrt(weights @ covariance @ weights))
    return {"estimate": value, "se": se, "z": value / se, "p": special.normal_two_sided(value / se), "low": value - 1.96 * se, "high": value + 1.96 * se}


def signed_score(df: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
    """(key, score): z-scores (ddof 0) of the columns, weighted by their correlation with the target over the sum of its absolute values.

    Rows with a null column have no score. Means, deviations and correlations are one aggregate row.
    """
    fine = df.select(key, *[finite(col(c).cast("double")).alias(c) for c in columns], finite(col(target).cast("double")).alias("_t")).na.drop(subset=columns)
    s = fine.agg(*[x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"), F.corr(col(c), F.col("_t")).alias(f"r{i}"))]).first()
    total = sum(abs(s[f"r{i}"] or 0.0) for i in range(len(columns))) or 1.0
    parts = [(col(c) - (s[f"m{i}"] or 0.0)) / ((s[f"s{i}"] or 0.0) or 1.0) * ((s[f"r{i}"] or 0.0) / total) for i, c in enumerate(columns)]
    return fine.select(key, sum(parts[1:], parts[0]).alias("score"))


def percent_pairs(long: DataFrame, group: str, intervals: bool = False, least: float = 1e-12) -> DataFrame:
    """(feature, a, b, percent, percent_se[, lower_error, upper_error]) of each pair of groups a < b: difference of means over the mean of
    both means, in percent, null where that mean is nearer to 0 than `least`. Limits are those of Games-Howell comparisons at 95 %."""
    means = moments(long, group).select("feature", "g", "m")
    both = pairwise(long, group).join(means.select("feature", F.col("g").alias("a"), F.col("m").alias("ma")), ["feature", "a"]).join(means.select("feature", F.col("g").alias("b"), F.col("m").alias("mb")), ["feature", "b"])
    middle = (F.col("ma") + F.col("mb")) / 2
    scale = F.when(F.abs(middle) >= least, 100 / middle)
    out = both.withColumns({"percent": F.col("diff") * scale, "percent_se": F.try_divide(F.abs("diff"), "t") * F.abs(scale)})
    if not intervals:
        return out.select("feature", "a", "b", "percent", "percent_se")
    k = long.select(group).distinct().count()
    wide = with_p(out.withColumn("k", F.lit(k)), "q95", lambda k, df: special.range_quantile(0.95, int(k), df), ["k", "df"])
    half = F.col("q95") / math.sqrt(2) * F.col("percent_se")
    return wide.select("feature", "a", "b", "percent", "percent_se", half.alias("lower_error"), half.alias("upper_error"))


def feature_counts(results: DataFrame, by: str, top: int) -> DataFrame:
    """(organelle, class, n) of the `top` features by a column of a result table; pairs that don't occur have 0."""
    from lobule.functions.cleaning import measure_class_of, organelle_of

    best = results.orderBy(F.desc_nulls_last(by), "feature").limit(top).select(organelle_of(F.col("feature")).alias("organelle"), measure_class_of(F.col("feature")).alias("class"))
    every = results.sparkSession.createDataFrame([(o, c) for o in ("mito", "peroxisome", "ld") for c in ("shape", "size", "position", "abundance", "other")], "organelle string, class string")
    counted = best.groupBy("organelle", "class").agg(F.count("*").alias("n"))
    return every.join(counted, ["organelle", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def violations(results: DataFrame, p: str, alpha: float) -> DataFrame:
    """One row (features, violated, percent) of a table of tests; unknown p are not counted."""
    known = results.where(F.col(p).isNotNull() & ~F.isnan(p))
    return known.agg(F.count("*").alias("features"), F.count_if(F.col(p) < alpha).alias("violated")).withColumn("percent", F.try_divide(F.col("violated") * 100.0, "features"))


def regression_bands(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """(keys, place, x, fit, se_mean, se_new, df) at the smallest, mean and largest x of each group's simple regression; groups of fewer
    than three rows or one x have no errors. All from one aggregate."""
    fine = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = fine.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    slope = F.try_divide("sxy", "sxx")
    variance = F.try_divide(F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy")), F.when(F.col("n") > 2, F.col("n") - 2))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(c).alias("x")) for p, c in (("low", "lo"), ("mean", "mx"), ("high", "hi"))])).alias("at")
    each = sums.select("*", slope.alias("slope"), variance.alias("variance"), at).select("*", "at.*")
    off = F.try_divide((F.col("x") - F.col("mx")) ** 2, "sxx")
    return each.select(
        *keys, "place", "x", (F.col("my") + F.col("slope") * (F.col("x") - F.col("mx"))).alias("fit"), F.sqrt(F.col("variance") * (1 / F.col("n") + off)).alias("se_mean"),
        F.sqrt(F.col("variance") * (1 + 1 / F.col("n") + off)).alias("se_new"), (F.col("n") - 2).alias("df"),
    )


def band_limits(bands: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds mean_low, mean_high, new_low and new_high by the t distribution."""
    wide = with_p(bands, "_t", lambda df: special.t_quantile((1 + level) / 2, df) if df > 0 else None, ["df"])
    return wide.withColumns({f"{n}_{side}": F.col("fit") + sign * F.col("_t") * F.col(f"se_{n}") for n in ("mean", "new") for side, sign in (("low", -1), ("high", 1))}).drop("_t")


def fold_scores(df: DataFrame, keys: list[str], y: str, x: str, fold: str) -> DataFrame:
    """(keys, folds, mean_r2, sd_r2): R squared of each held-out fold of simple regression, their mean and deviation (ddof 0)."""
    each = _fold_errors(df, keys, y, x, fold)
    score = 1 - F.try_divide("e", F.col("syy") - F.col("sy") ** 2 / F.col("n"))
    return each.withColumn("r2", score).groupBy(*keys).agg(F.count("r2").alias("folds"), F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("sd_r2"))


def kernel_density(df: DataFrame, group: str, value: str, low: float, high: float, points: int) -> DataFrame:
    """(group, place, density) on an even grid, Gaussian kernel, bandwidth 1.06 s n^-0.2; groups without spread have none. Equal values are
    counted first; a row meets the grid's points only, so the work is linear."""
    counted = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("x")).agg(F.count("*").alias("m"))
    spread = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (1.06 * F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2))).alias("h")).where("h > 0")
    step = (high - low) / (points - 1)
    wide = counted.join(F.broadcast(spread), group).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # one row per group
    z = (low + F.col("place") * step - F.col("x")) / F.col("h")
    return wide.groupBy(group, "place").agg((F.sum(F.col("m") * F.exp(-0.5 * z * z)) / F.max(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
