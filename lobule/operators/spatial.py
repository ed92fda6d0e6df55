"""Neighbours in the plane, Moran's I of residuals, category adjacency and their permutation tests, group by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobule.shared import stage


def radius_pairs(df: DataFrame, keys: list[str], id_column: str, x: str, y: str, radius: float, asking: DataFrame | None = None) -> DataFrame:
    """(keys, a, b, d) of rows of one group at most `radius` apart, both directions; a grid turns the range join into an equi-join.
    asking (keys, a): rows whose neighbours are wanted, by default all."""
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(id_column).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    fine = fine.withColumns({"gx": F.floor(F.col("x") / radius), "gy": F.floor(F.col("y") / radius)})
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    some = fine if asking is None else fine.join(asking.withColumnRenamed("a", "id"), [*keys, "id"], "left_semi")
    asks = some.select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.transform(near, lambda i: i + F.col("gx"))).alias("gx"), "gy")
    asks = asks.select(*keys, "a", "ax", "ay", "gx", F.explode(F.transform(near, lambda i: i + F.col("gy"))).alias("gy"))
    held = fine.select(*keys, "gx", "gy", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return asks.join(held, [*keys, "gx", "gy"]).where(F.col("a") != F.col("b")).withColumn("d", d).where(F.col("d") <= radius).select(*keys, "a", "b", "d")


def neighbours(df: DataFrame, keys: list[str], id_column: str, x: str, y: str, k: int, reach: float) -> DataFrame:
    """(keys, a, b, place, d): the k nearest rows of the same group within `reach`, ties by id."""
    pairs = radius_pairs(df, keys, id_column, x, y, reach)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("d", "b"))).where(F.col("place") <= k)


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair once, as (keys, i, j) with i < j."""
    return edges.select(*keys, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def residuals(df: DataFrame, keys: list[str], id_column: str, category: str, bin_name: str) -> DataFrame:
    """(keys, id, category, r): indicator of each category of the group less its share in the row's bin."""
    known = df.where(F.col(category).isNotNull() & F.col(bin_name).isNotNull()).select(*keys, F.col(id_column).alias("id"), F.col(category).alias("own"), F.col(bin_name).alias("bin"))
    classes = known.select(*keys, F.col("own").alias("category")).distinct()
    share = known.groupBy(*keys, "bin", F.col("own").alias("category")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "bin"))).drop("n")
    spread = known.join(classes, keys).join(share, [*keys, "bin", "category"], "left")
    return spread.select(*keys, "id", "category", ((F.col("own") == F.col("category")).cast("double") - F.coalesce("p", F.lit(0.0))).alias("r"))


def moran(edges: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, n, moran) over undirected edges (keys, i, j) of binary weight; values (keys, id, category, r) are centred here."""
    by = Window.partitionBy(*keys, "category")
    centred = values.withColumn("r", F.col("r") - F.avg("r").over(by))
    whole = centred.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    left = centred.select(*keys, "category", F.col("id").alias("i"), F.col("r").alias("ri"))
    right = centred.select(*keys, "category", F.col("id").alias("j"), F.col("r").alias("rj"))
    cross = edges.join(left, [*keys, "i"]).join(right, [*keys, "category", "j"]).groupBy(*keys, "category").agg(F.sum(F.col("ri") * F.col("rj")).alias("c"), F.count("*").alias("w"))
    return whole.join(cross, [*keys, "category"]).select(*keys, "category", "n", (F.col("n") / F.col("w") * F.try_divide("c", "ss")).alias("moran"))


def adjacency(edges: DataFrame, labels: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, ci, cj, n): both orders of each edge's categories are counted, so equal ones count twice."""
    left = labels.select(*keys, F.col("id").alias("i"), F.col(category).alias("ci"))
    right = labels.select(*keys, F.col("id").alias("j"), F.col(category).alias("cj"))
    pairs = edges.join(left, [*keys, "i"]).join(right, [*keys, "j"]).select(*keys, "ci", "cj")
    return pairs.unionByName(pairs.select(*keys, F.col("cj").alias("ci"), F.col("ci").alias("cj"))).groupBy(*keys, "ci", "cj").agg(F.count("*").alias("n"))


def _mixed(rng: np.random.Generator, labels: np.ndarray, strata: np.ndarray, times: int) -> np.ndarray:
    """(times, n) labels, in each row shuffled within the strata."""
    out = np.empty((times, len(labels)), labels.dtype)
    out[:, np.argsort(strata, kind="stable")] = labels[np.argsort(strata + rng.random((times, len(labels))), 1)]
    return out


def _rounds(times: int, width: int) -> list[int]:
    """Sizes of the blocks of permutations, each of about a million values."""
    size = max(1, 1_000_000 // max(1, width))
    return [min(size, times - at) for at in range(0, times, size)]


def _counts(labels: np.ndarray, i: np.ndarray, j: np.ndarray, c: int) -> np.ndarray:
    """(times, c, c): both orders of each edge's labels."""
    code = np.arange(len(labels))[:, None] * (c * c) + labels[:, i] * c + labels[:, j]
    m = np.bincount(code.ravel(), minlength=len(labels) * c * c).reshape(-1, c, c)
    return m + m.transpose(0, 2, 1)


def _two_sided(seen: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Share of permutations, with the seen one, at least as far from the null mean."""
    mean = null.mean(0)
    return (1 + (np.abs(null - mean) >= np.abs(seen - mean)).sum(0)) / (len(null) + 1)


def _group(cells: pd.DataFrame, edges: pd.DataFrame) -> tuple:
    """Category codes, categories, bin codes and the edges' places of one group, cells in the order of their ids."""
    cells = cells.sort_values("id")
    kinds, labels = np.unique(cells["_cat"], return_inverse=True)
    place = pd.Index(cells["id"])
    i, j = place.get_indexer(edges["i"]), place.get_indexer(edges["j"])
    return labels, kinds, np.unique(cells["_bin"], return_inverse=True)[1], i[(i >= 0) & (j >= 0)], j[(i >= 0) & (j >= 0)]


def _adjacency_null(rng: np.random.Generator, labels: np.ndarray, bins: np.ndarray, i: np.ndarray, j: np.ndarray, c: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    null = np.concatenate([_counts(_mixed(rng, labels, bins, n), i, j, c) for n in _rounds(times, len(labels) + len(i))])
    return _counts(labels[None], i, j, c)[0], null


def _both(edges: DataFrame, labels: DataFrame, keys: list[str], category: str, bin_name: str):
    known = labels.where(F.col(category).isNotNull() & F.col(bin_name).isNotNull())
    rows = known.select(*keys, "id", F.col(category).alias("_cat"), F.col(bin_name).alias("_bin"))
    own = {k: f"_{n}" for n, k in enumerate(keys)}  # edges may come from the same table
    return rows.groupBy(*keys).cogroup(edges.select(*[F.col(k).alias(v) for k, v in own.items()], "i", "j").groupBy(*own.values()))


def adjacency_test(edges: DataFrame, labels: DataFrame, keys: list[str], category: str, bin_name: str, times: int = 200, seed: int = 2468) -> DataFrame:
    """(keys, ci, cj, n, mean, p) of all pairs of a group's categories: two-sided permutation test around the null mean; categories are
    shuffled within the position bins of each group. A group, one image, is held by one task."""
    kinds = dict(labels.dtypes)

    def test(key: tuple, cells: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "ci", "cj", "n", "mean", "p"]
        if not len(cells) or not len(links):
            return pd.DataFrame(columns=names)
        labels, found, bins, i, j = _group(cells, links)
        seen, null = _adjacency_null(np.random.default_rng(seed), labels, bins, i, j, len(found), times)
        mean, p = null.mean(0), _two_sided(seen, null)
        return pd.DataFrame([(*key, found[a], found[b], seen[a, b], mean[a, b], p[a, b]) for a in range(len(found)) for b in range(len(found))], columns=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", ci {kinds[category]}, cj {kinds[category]}, n long, mean double, p double"
    return _both(edges, labels, keys, category, bin_name).applyInPandas(test, schema)


def niche_tests(edges: DataFrame, labels: DataFrame, keys: list[str], category: str, bin_name: str, adjacency_times: int = 200, moran_times: int = 200, fraction_times: int = 500, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """(keys, n, fraction_explained, fraction_p, moran, moran_p, pairs, categories) of each group of at least `least` rows.

    fraction_p: share of shuffles over the whole group that explain as much; moran: mean of the categories' residual Moran's I, moran_p
    two-sided with shuffles within bins; pairs: number of unordered pairs of categories whose adjacency has p < alpha. Without edges the
    last are null, as is the fraction where there is one category.
    """
    kinds = dict(labels.dtypes)
    names = [*keys, "n", "fraction_explained", "fraction_p", "moran", "moran_p", "pairs", "categories"]

    def h(counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
        return -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(-1)

    def test(key: tuple, cells: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if len(cells) < least:
            return pd.DataFrame(columns=names)
        labels, found, bins, i, j = _group(cells, links)
        n, c, b = len(labels), len(found), int(bins.max()) + 1
        table = lambda x: np.bincount(((np.arange(len(x))[:, None] * b + bins) * c + x).ravel(), minlength=len(x) * b * c).reshape(-1, b, c)
        whole = h(np.bincount(labels, minlength=c))
        fraction = fraction_p = moran = moran_p = pairs = None
        if whole > 0:
            explained = lambda x: 1 - (h(t := table(x)) * t.sum(2)).sum(1) / n / whole
            rng, fraction = np.random.default_rng(2025), float(explained(labels[None])[0])
            null = np.concatenate([explained(_mixed(rng, labels, np.zeros(n, int), k)) for k in _rounds(fraction_times, n)])
            fraction_p = (1 + int((null >= fraction - 1e-12).sum())) / (fraction_times + 1)
        if len(i) and n >= 3:
            counts = table(labels[None])[0]
            share = (counts / counts.sum(1, keepdims=True))[bins]
            one = np.eye(c)
            spread = ((one[labels] - share) ** 2).sum(0)  # residuals have mean 0, and shuffles within bins keep their squares
            fit = spread > 1e-9
            if fit.any():

                def mean_moran(x: np.ndarray) -> np.ndarray:
                    r = one[x] - share
                    return (n / len(i) * (r[:, i] * r[:, j]).sum(1)[:, fit] / spread[fit]).mean(1)

                rng, moran = np.random.default_rng(12345), float(mean_moran(labels[None])[0])
                null = np.concatenate([mean_moran(_mixed(rng, labels, bins, k)) for k in _rounds(moran_times, c * (n + len(i)))])
                moran_p = float(_two_sided(np.array(moran), null))
            seen, null = _adjacency_null(np.random.default_rng(2468), labels, bins, i, j, c, adjacency_times)
            pairs = int(np.triu(_two_sided(seen, null) < alpha).sum())
        return pd.DataFrame([(*key, n, fraction, fraction_p, moran, moran_p, pairs, c)], columns=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, fraction_explained double, fraction_p double, moran double, moran_p double, pairs int, categories int"
    return _both(edges, labels, keys, category, bin_name).applyInPandas(test, schema)


def neighbours_or_within(df: DataFrame, keys: list[str], id_column: str, x: str, y: str, k: int, radius: float, reach: float) -> DataFrame:
    """(keys, a, b, place, d): the k nearest rows of the same group however far they are, ties by id, and all others within `radius`.

    Rows that find fewer than k others within `reach` look again twice as far, until they have them or the group has no more, so the grid
    join stays local for all but lonely rows. place counts on beyond k by distance.
    """
    fine = stage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(id_column).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")), "rows")
    sizes = fine.groupBy(*keys).agg(F.count("*").alias("size"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    asking = fine.select(*keys, F.col("id").alias("a")).join(sizes, keys).withColumn("goal", F.least(F.lit(k), F.col("size") - 1))
    asking, out = stage(asking.where("goal > 0").select(*keys, "a", "goal", "span"), "asking"), None
    far = max(reach, radius)
    by = Window.partitionBy(*keys, "a")
    while not asking.isEmpty():
        pairs = radius_pairs(fine, keys, "id", "x", "y", far, asking.select(*keys, "a")).withColumns({"place": F.row_number().over(by.orderBy("d", "b")), "found": F.count("*").over(by)})
        met = stage(pairs.join(asking, [*keys, "a"]), "met")
        done = met.where("found >= goal").where((F.col("place") <= k) | (F.col("d") <= radius)).select(*keys, "a", "b", "place", "d")
        out = done if out is None else out.unionByName(done)
        asking = stage(asking.join(met.where("found >= goal").select(*keys, "a").distinct(), [*keys, "a"], "left_anti"), "asking")
        far *= 2
    return out if out is not None else radius_pairs(fine, keys, "id", "x", "y", far).withColumn("place", F.lit(0)).select(*keys, "a", "b", "place", "d")


def decision_scores(df: DataFrame, accuracy: str, fraction: str, categories: str, alpha: float = 0.05) -> DataFrame:
    """Adds accuracy_score and fraction_score, 0 at their thresholds 0.8 and 0.7 and 1 at 0.2 above, and pairs_by_chance, the number of
    category pairs that are significant at `alpha` by chance."""
    c = F.col(categories)
    return df.withColumns({"accuracy_score": (F.col(accuracy) - 0.8) / 0.2, "fraction_score": (F.col(fraction) - 0.7) / 0.2, "pairs_by_chance": alpha * c * (c + 1) / 2})


def pair_score(pairs: Column, chance: Column) -> Column:
    """(chance - pairs) / max(chance, 1): below 0 where more pairs are significant than chance makes so."""
    return (chance - pairs) / F.greatest(chance, F.lit(1.0))


def p_score(p: Column, alpha: float = 0.05) -> Column:
    """log10(p / alpha): below 0 where p is significant."""
    return F.log10(F.greatest(p, F.lit(1e-300)) / alpha)
