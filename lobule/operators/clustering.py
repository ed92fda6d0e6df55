"""Components, mixtures and measures of clusterings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions.cleaning import col
from lobule.operators.nearest import of, spread
from lobule.shared import free, stage

BLOCK, PART = 16384, 65536  # rows of a piece that meets other pieces, rows of a file of pieces
TILE, SINGLE = 512, 65536  # rows of a side whose distances are held at once; rows from which distances are of single precision


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross products) of complete rows, in one aggregate row."""
    d = len(columns)
    rows = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    got = list(rows.agg(F.count("*"), *[F.sum(f"c{i}") for i in range(d)], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(d) for j in range(i, d)]).first())
    n, sums, cross = got[0], np.array([v or 0.0 for v in got[1 : d + 1]]), np.zeros((d, d))
    at = iter(got[d + 1 :])
    for i in range(d):
        for j in range(i, d):
            cross[i, j] = cross[j, i] = next(at) or 0.0
    return n, sums, cross


def principal_components(df: DataFrame, columns: list[str], standardise: bool = True) -> dict[str, np.ndarray]:
    """mean, scale, loadings (columns are components, largest loading positive) and ratio of explained variance, from one aggregate pass."""
    n, sums, cross = gram(df, columns)
    mean = sums / n
    covariance = cross / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0)) if standardise else np.ones(len(columns))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    return {"mean": mean, "scale": scale, "loadings": vectors, "ratio": values / values.sum()}


def component_scores(df: DataFrame, columns: list[str], pca: dict[str, np.ndarray], n: int) -> DataFrame:
    """df with component_1..component_n, as plain expressions; rows with a null column get nulls."""
    scaled = [(col(c) - float(m)) / float(s) for c, m, s in zip(columns, pca["mean"], pca["scale"])]
    return df.withColumns({f"component_{k + 1}": sum((x * float(w) for x, w in zip(scaled[1:], pca["loadings"][1:, k])), scaled[0] * float(pca["loadings"][0, k])) for k in range(n)})


def components_for(ratio: np.ndarray, share: float = 0.9, low: int = 2, high: int = 50) -> int:
    """Number of components that explain the share, within [low, high]."""
    return int(np.clip(np.searchsorted(np.cumsum(ratio), share) + 1, low, min(high, len(ratio))))


def log_densities(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """log weight + log density of each row under each Gaussian."""
    (k, d), roots = model["means"].shape, np.linalg.cholesky(model["covariances"])
    inverse, middle = np.linalg.inv(roots), model["means"].mean(0)
    z = inverse.transpose(1, 0, 2).reshape(d * k, d) @ (x - middle).T
    z -= np.einsum("kij,kj->ik", inverse, model["means"] - middle).reshape(d * k, 1)
    z *= z
    square = sum((z[i * k : (i + 1) * k] for i in range(1, d)), z[:k].copy())
    top = np.log(np.maximum(model["weights"], 1e-300)) - 0.5 * d * math.log(2 * math.pi) - np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1)
    square *= -0.5
    square += top[:, None]
    return square.T


def mixture_moments(x: np.ndarray, model: dict[str, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, and the components' masses, weighted sums and weighted cross products."""
    r = log_densities(x, model).T
    top = r.max(0)
    r -= top
    np.exp(r, out=r)
    whole = r.sum(0)
    r /= whole
    d = x.shape[1]
    return float((top + np.log(whole)).sum()), r.sum(1), r @ x, (r @ (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)).reshape(-1, d, d)


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, starts: int = 3, rounds: int = 60, ridge: float = 1e-6, tolerance: float = 1e-3, seed: int = 0) -> dict:
    """Full-covariance mixture by expectation-maximisation; every round is one pass that returns k weighted moments.

    The starts come from a bounded sample of 4,096 rows, on which each is refined; the best goes on over all rows. Complete rows only.
    Returns weights, means, covariances, loglik (sum), n.
    """
    return gaussian_mixtures(df, columns, [(k, None)], None, starts, rounds, ridge, tolerance, seed)[0]


def gaussian_mixtures(df: DataFrame, columns: list[str], fits: list[tuple[int, int | None]], fold: Column | None = None, starts: int = 3, rounds: int = 60, ridge: float = 1e-6, tolerance: float = 1e-3, seed: int = 0) -> list[dict]:
    """A gaussian_mixture for each (k, fold left out or None); all that have not ended share the passes over the rows."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(*[col(c).cast("double").alias(n) for c, n in zip(columns, names)], (F.lit(None) if fold is None else fold).cast("long").alias("fold")).na.drop(subset=names)
    sizes, d = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}, len(columns)  # one row for each fold
    n, first, more = {}, {}, {}
    for out in {o for _, o in fits}:
        kept = rows if out is None else rows.where(F.col("fold") != out)
        n[out] = sum(c for f, c in sizes.items() if out is None or f not in (None, out))
        share = max(1, -(-n[out] // 4096))
        first[out] = kept.where(F.pmod(F.xxhash64(*names), F.lit(share)) == 0).select(*names).limit(8192).toPandas().to_numpy(float)
        if len(first[out]) < 10 * max(k for k, o in fits if o == out):
            more[out] = kept.select(*names).limit(8192).toPandas().to_numpy(float)

    def step(model: dict, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict:
        mass = np.maximum(mass, 1e-9)
        means = first / mass[:, None]
        covariances = second / mass[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(d)
        return {"weights": mass / mass.sum(), "means": means, "covariances": covariances}

    def start(k: int, sample: np.ndarray) -> dict:
        rng = np.random.default_rng(seed)
        best: tuple[float, dict] | None = None
        spread = np.cov(sample.T).reshape(d, d) + ridge * np.eye(d)
        for _ in range(starts):
            means = [sample[rng.integers(len(sample))]]
            for _ in range(k - 1):
                away = np.min([((sample - m) ** 2).sum(1) for m in means], axis=0)
                means.append(sample[rng.choice(len(sample), p=away / away.sum())] if away.sum() > 0 else sample[rng.integers(len(sample))])
            model = {"weights": np.full(k, 1 / k), "means": np.array(means), "covariances": np.array([spread / max(1, k)] * k)}
            last = -np.inf
            for _ in range(rounds):
                loglik, *parts = mixture_moments(sample, model)
                if loglik - last < tolerance * len(sample):
                    break
                last, model = loglik, step(model, *parts)
            if best is None or loglik > best[0]:
                best = (loglik, model)
        return best[1]

    models, left, last = [], [], [-np.inf] * len(fits)
    for k, out in fits:
        sample = first[out] if len(first[out]) >= 10 * k else more[out]
        models.append(start(k, sample[np.lexsort(sample.T[::-1])]))
        left.append(rounds if n[out] > len(sample) else 1)
    logliks = [0.0] * len(fits)
    while active := [i for i in range(len(fits)) if left[i] > 0]:

        def partial(batches: Iterator[pa.RecordBatch], now: dict = {i: models[i] for i in active}) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy() for c in names])
                at = b.column("fold").fill_null(-1).to_numpy()
                for out in {fits[i][1] for i in now}:
                    part = x if out is None else x[(at != out) & (at >= 0)]
                    for a in range(0, len(part), 4096):
                        for i in now:
                            if fits[i][1] == out:
                                loglik, *sums = mixture_moments(part[a : a + 4096], now[i])
                                total[i] = total.get(i, 0.0) + np.concatenate([[loglik], *[v.ravel() for v in sums]])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "m"])

        parts: dict[int, np.ndarray] = {}
        for r in rows.mapInArrow(partial, "i int, m array<double>").collect():  # one row for each fit and task
            parts[r["i"]] = parts.get(r["i"], 0.0) + np.array(r["m"])
        for i in active:
            k, out = fits[i]
            logliks[i], left[i] = float(parts[i][0]), left[i] - 1
            if logliks[i] - last[i] < tolerance * n[out]:
                left[i] = 0
            else:
                last[i], models[i] = logliks[i], step(models[i], parts[i][1 : k + 1], parts[i][k + 1 : k + 1 + k * d].reshape(k, d), parts[i][k + 1 + k * d :].reshape(k, d, d))
    return [m | {"loglik": v, "n": n[out]} for m, v, (_, out) in zip(models, logliks, fits)]


def information(model: dict) -> dict[str, float]:
    """bic and aic of a full-covariance mixture."""
    k, d = model["means"].shape
    p = k - 1 + k * d + k * d * (d + 1) / 2
    return {"bic": -2 * model["loglik"] + p * math.log(model["n"]), "aic": -2 * model["loglik"] + 2 * p}


def mixture_labels(df: DataFrame, columns: list[str], model: dict) -> DataFrame:
    """df with prediction (0-based), probability and the posterior array; rows with a null column get nulls."""
    names = [f"_c{i}" for i in range(len(columns))]
    k = len(model["weights"])

    @F.pandas_udf("array<double>")
    def posterior(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        fine = np.isfinite(x).all(1)
        logs = log_densities(np.where(fine[:, None], x, 0.0), model)
        r = np.exp(logs - logs.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        return pd.Series([v if f else None for v, f in zip(r.tolist(), fine)])

    out = df.withColumn("posterior", posterior(*[col(c).cast("double") for c in columns]))
    return out.withColumns({"probability": F.array_max("posterior"), "prediction": F.array_position("posterior", F.array_max("posterior")).cast("int") - 1})


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari) from the contingency counts; 1 where both are a single cluster."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n")
    joint = cells.agg(pairs(n).alias("i"), F.sum("n").alias("t"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(n).alias("x"))
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(n).alias("y"))
    total = F.col("t") * (F.col("t") - 1) / 2
    expected = F.try_divide(F.col("x") * F.col("y"), total)
    one = joint.join(left, how="inner", on=F.lit(True)).join(right, how="inner", on=F.lit(True))  # three single rows
    return one.select(F.col("t").cast("long").alias("n"), F.coalesce(F.try_divide(F.col("i") - expected, (F.col("x") + F.col("y")) / 2 - expected), F.lit(1.0)).alias("ari"))


def centroids(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, n, centre array)."""
    return df.na.drop(subset=[label, *columns]).groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.avg(col(c)) for c in columns]).alias("centre"))


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def scatter_within(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, n, centre, s, ss), staged: mean distance to, and sum of squared distances from, the cluster's centre. Each step is a stage
    table, so that the driver never plans the expressions over all columns together."""
    complete = df.na.drop(subset=[label, *columns])
    rows = stage(complete.select(label, F.array(*[col(c).cast("double") for c in columns]).alias("x")), "scatter")
    means = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(columns))])
    centre = stage(means.select(label, "n", F.array(*[f"m{i}" for i in range(len(columns))]).alias("centre")), "centres")
    apart = rows.join(centre.select(label, "centre"), label).select(label, distance("x", "centre").alias("d"))
    each = apart.groupBy(label).agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    out = stage(centre.join(each, label).select(label, "n", "centre", "s", "ss"), "scattered")
    free(rows)
    free(centre)
    return out


def davies_bouldin(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row (clusters, davies_bouldin); the self join is over the clusters' centres."""
    each = scatter_within(df, label, columns)
    a, b = each.select(F.col(label).alias("a"), F.col("s").alias("sa"), F.col("centre").alias("ca")), each.select(F.col(label).alias("b"), F.col("s").alias("sb"), F.col("centre").alias("cb"))
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), distance("ca", "cb"))).alias("r"))
    return worst.agg(F.count("*").alias("clusters"), F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row (n, clusters, calinski_harabasz)."""
    each = scatter_within(df, label, columns)
    whole = each.select("n", "centre").agg(F.sum("n").alias("whole"), *[F.sum(F.col("n") * F.col("centre")[i]).alias(f"g{i}") for i in range(len(columns))])
    grand = each.select("n", "centre", "ss").crossJoin(whole.select(F.array(*[F.col(f"g{i}") / F.col("whole") for i in range(len(columns))]).alias("g")))
    between = F.sum(F.col("n") * distance("centre", "g") ** 2)
    k, n = F.count("*"), F.sum("n")
    return grand.agg(n.alias("n"), k.alias("clusters"), (F.try_divide(between, k - 1) / F.try_divide(F.sum("ss"), n - k)).alias("calinski_harabasz"))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances by products; where these cancel, from the differences."""
    middle = np.median(y[:: len(y) // 32 + 1], axis=0)
    a, b = x - middle, y - middle
    one, two = (a * a).sum(1), (b * b).sum(1)
    d = np.column_stack([-2 * a, one, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), two]).T
    if not d.min(initial=np.inf) > 1e-5 * (one.max(initial=0) + two.max(initial=0)):
        near = np.flatnonzero(~(d > 1e-5 * (one[:, None] + two)))
        mend(d, near, x, y)
    return np.sqrt(d, out=d)


def mend(d: np.ndarray, near: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Put the sums of squared differences into the near places of d; into all, should these be many."""
    if len(near) <= d.size / 8:
        i, j = np.divmod(near, len(y))
        d.ravel()[near] = ((x[i] - y[j]) ** 2).sum(1)
        return
    whole = np.zeros(d.shape)
    for j in range(x.shape[1]):
        whole += (x[:, j : j + 1] - y[:, j]) ** 2
    d[:] = whole


def single(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of single precision whose product, the first of x by the second of y, are the squared distances. Sizes are held as two numbers,
    so that they add no error."""
    x = x.astype(np.float32)
    size = (x.astype(np.float64) ** 2).sum(1)
    high = size.astype(np.float32)
    low, one = (size - high).astype(np.float32), np.ones(len(x), np.float32)
    return np.column_stack([-2 * x, high, low, one, one]), np.ascontiguousarray(np.column_stack([x, one, one, high, low]).T)


def pieces(sizes: dict[int, int], most: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Each label's first piece and number of pieces, and the rows to expect in each piece: a label of more than `most` rows has pieces of its own,
    up to 64 smaller ones share a piece."""
    places, rows, held = [], [], 0
    for g, m in sorted(sizes.items()):
        if m > most:
            many = -(-m // most)
            places.append((g, len(rows), many))
            rows += [-(-m // many)] * many
            held = 64
        elif held < 64 and rows and rows[-1] + m <= most:
            places.append((g, len(rows) - 1, 1))
            rows[-1], held = rows[-1] + m, held + 1
        else:
            places.append((g, len(rows), 1))
            rows, held = [*rows, m], 1
    return places, rows


def silhouette(df: DataFrame, key: str, label: str, columns: list[str]) -> DataFrame:
    """One row (n, silhouette): the Euclidean mean silhouette, all rows against all rows. The cost is quadratic by definition.

    Rows are packed at once, in pieces of about BLOCK rows at most, into a stage table with a file for each PART rows or less. A task reads two
    files, and each two pieces meet once, for the rows of both. Shuffled are the rows, once, and for each row and file a sum for each label in
    it, never rows or sums for each piece. Of more than SINGLE rows, distances are taken in single precision, but in double where products cancel
    or sizes lie far apart: a row's sums are then exact to about 1e-8 of their value and the mean to 1e-10, as the errors have no direction.
    """
    spark, width = df.sparkSession, len(columns)
    rows = df.na.drop(subset=[label, *columns]).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("g"), F.array(*[col(c).cast("double") for c in columns]).alias("x"))
    sizes = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.count("*").alias("m")).where("g IS NOT NULL").collect()}
    n = sum(sizes.values())
    part = max(1024, min(PART, n // 12))
    places, expected = pieces(sizes, min(BLOCK, part))
    files, fast = (np.cumsum(expected) - 1) // part, n > SINGLE
    files = np.unique(files, return_inverse=True)[1] if n else np.zeros(1, int)
    count = int(files.max()) + 1

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("g").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        names, m = np.unique(t.column("g").to_numpy(), return_counts=True)
        x = np.ascontiguousarray(t.column("x").combine_chunks().flatten().to_numpy(), np.float64)
        return pa.table({"piece": pa.array([key[1].as_py()], pa.int32()), "names": pa.array([names.tolist()], pa.list_(pa.int64())), "m": pa.array([m.tolist()], pa.list_(pa.int64())), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary())})

    first = F.broadcast(spark.createDataFrame(places, "g long, first int, many int"))
    placed = rows.join(first, "g").select("id", "g", "x", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias("piece"))
    at = of(spread(spark, count), of(files, "piece"))
    packed = stage(placed.withColumn("at", at).repartition(count, "at").groupBy("at", "piece").applyInArrow(gather, "piece int, names array<long>, m array<long>, ids array<long>, x binary"), "pieces")

    def cuts(plain: int, end: int) -> list[tuple[int, int]]:
        return [(i, min(i + TILE, stop)) for start, stop in ((0, plain), (plain, end)) for i in range(start, stop, TILE)]

    def sums(x: np.ndarray, hot: np.ndarray, y: np.ndarray, heat: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x its distances to y summed for each column of heat, and if both are asked for each row of y those to x."""
        middle = np.median(y[:: len(y) // 1024 + 1], axis=0)
        x, y = x - middle, y - middle
        one, two = (x * x).sum(1), (y * y).sum(1)
        order, turn = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        x, y, one, two, hot, heat = x[order], y[turn], one[order], two[turn], hot[order], heat[turn]
        limit = 64 * np.median(two)
        p, q = (int(np.searchsorted(side, limit, "right")) for side in (one, two)) if fast and 1e-30 < limit < 1e30 else (0, 0)
        left, right, cold, chill = single(x[:p])[0], single(y[:q])[1], hot.astype(np.float32), heat.astype(np.float32)
        total, back, space = np.zeros((len(x), heat.shape[1])), np.zeros((len(y), hot.shape[1])), np.empty(TILE * TILE, np.float32)
        for i, u in cuts(p, len(x)):
            for j, v in cuts(q, len(y)):
                if plain := i < p and j < q:
                    d = np.matmul(left[i:u], right[:, j:v], out=space[: (u - i) * (v - j)].reshape(u - i, v - j))
                    least = 1e-3 * (one[u - 1] + two[v - 1])
                    if not d.min() > least:
                        mend(d, np.flatnonzero(~(d > least)), x[i:u], y[j:v])
                    np.sqrt(d, out=d)
                else:
                    d = distances(x[i:u], y[j:v])
                total[i:u] += d @ (chill if plain else heat)[j:v]
                if both:
                    back[j:v] += ((cold if plain else hot)[i:u].T @ d).T
        out, other = np.empty_like(total), np.empty_like(back)
        out[order], other[turn] = total, back
        return out, other

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def add(piece: int, names: list[int], total: np.ndarray) -> None:
            for other, t in zip(names, total.T):
                held[piece, other] = held[piece, other] + t if (piece, other) in held else t.copy()

        def pair(batch: pa.RecordBatch, k: int) -> None:
            side = []
            for s in ("", "2"):
                piece, names, m = (batch.column(c + s)[k].as_py() for c in ("piece", "names", "m"))
                side.append((piece, names, np.repeat(np.eye(len(names)), m, axis=0), np.frombuffer(batch.column("x" + s)[k].as_buffer()).reshape(-1, width)))
            (piece, names, hot, x), (piece2, names2, heat, y) = side
            total, back = sums(x, hot, y, heat, piece != piece2)
            add(piece, names2, total)
            if piece != piece2:
                add(piece2, names, back)

        for batch in batches:
            for k in range(batch.num_rows):
                pair(batch, k)
            del batch  # before the next is read
        for (piece, other), t in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([other], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["piece", "other", "total"])

    def score(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        """a and b of each id; rows of the same id and label count as one, whose sums are added, as in SQL."""
        g = np.repeat(own.column("names")[0].as_py(), own.column("m")[0].as_py())
        ids = own.column("ids")[0].values
        others, at = np.unique(found.column("other").to_numpy(), return_inverse=True)
        total = np.zeros((len(g), len(others)))
        for k, t in zip(at, found.column("total")):
            total[:, k] += np.frombuffer(t.as_buffer())
        _, heads, same = np.unique(np.column_stack([g, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()]), axis=0, return_index=True, return_inverse=True)
        added = np.zeros((len(heads), len(others)))
        np.add.at(added, same.ravel(), total)
        mine, m = g[heads, None] == others, np.array([sizes[o] for o in others.tolist()], np.float64)
        lone = m[np.argmax(mine, 1)] == 1
        with np.errstate(divide="ignore", invalid="ignore"):
            a = added[mine] / (m[np.argmax(mine, 1)] - 1)
            b = np.where(mine, np.inf, added / m).min(1)
        return pa.table({"id": ids.take(pa.array(heads)), "a": pa.array(a, mask=lone), "b": pa.array(b, mask=np.full(len(b), len(others) == 1))})

    one, two = packed.select("piece", "names", "m", "x"), packed.select(*[F.col(c).alias(f"{c}2") for c in ("piece", "names", "m", "x")])
    found = one.hint("shuffle_replicate_nl").join(two, F.col("piece") <= F.col("piece2")).mapInArrow(meet, "piece int, other long, total binary")
    scored = packed.select("piece", "names", "m", "ids").groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(score, "id long, a double, b double")
    each = scored.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return each.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def balance(df: DataFrame, label: str) -> DataFrame:
    """One row (clusters, effective, least_share): 1 / sum p^2 and the smallest share."""
    each = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    p = each.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    return p.agg(F.count("*").alias("clusters"), (1 / F.sum(F.col("p") * F.col("p"))).alias("effective"), F.min("p").alias("least_share"))


def overlap(df: DataFrame, posteriors: list[str]) -> DataFrame:
    """(i, j, overlap): mean of the smaller posterior of each pair of components; one pass."""
    pairs = [(i, j) for i in range(len(posteriors)) for j in range(i + 1, len(posteriors))]
    row = df.agg(*[F.avg(F.least(col(posteriors[i]), col(posteriors[j]))).alias(f"p{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("overlap")) for i, j in pairs])).alias("r")).select("r.*")


def membership_entropy(posteriors: list[str]) -> Column:
    """Entropy of a row's posteriors over ln k."""
    terms = [-col(p) * F.ln(col(p) + 1e-12) for p in posteriors]
    return sum(terms[1:], terms[0]) / math.log(max(2, len(posteriors)))


def mahalanobis_least(model: dict) -> float:
    """Smallest distance of two component means under their average covariance."""
    k = len(model["weights"])
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            d = model["means"][i] - model["means"][j]
            out.append(float(np.sqrt(d @ np.linalg.solve((model["covariances"][i] + model["covariances"][j]) / 2 + 1e-6 * np.eye(len(d)), d))))
    return min(out, default=math.nan)


def composite(robustness: Column, overlap_: Column, separation: Column, silhouette_: Column, db: Column, entropy: Column, resolution: Column) -> Column:
    """Weighted mean of seven qualities in 0..1 (six of weight .15, the last .10), over those that are known."""
    parts = [(robustness, 0.15), (1 - overlap_, 0.15), (1 - F.exp(-separation), 0.15), ((silhouette_ + 1) / 2, 0.15), (1 / (1 + db), 0.15), (1 - entropy, 0.15), (resolution, 0.10)]
    known = [(F.coalesce(p * w, F.lit(0.0)), F.when(p.isNotNull(), w).otherwise(0.0)) for p, w in parts]
    return F.try_divide(sum((a for a, _ in known[1:]), known[0][0]), sum((b for _, b in known[1:]), known[0][1]))


def order_along_axis(df: DataFrame, label: str, columns: list[str], position: str, tie: str, share: float = 0.1) -> DataFrame:
    """(label, n, projection, estimated_position, new_label): clusters ordered by their centre's projection on the axis from the mean of
    the top `share` of rows by position to that of the bottom; new labels count from 1."""
    from lobule.operators.ranking import extreme_share

    ends = extreme_share(df.na.drop(subset=columns), position, tie, share).groupBy("side").agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    at = {r["side"]: np.array([r[f"c{i}"] for i in range(len(columns))], float) for r in ends}
    axis = at["bottom"] - at["top"]
    length = float(np.linalg.norm(axis)) or 1.0
    unit = axis / length
    each = centroids(df, label, columns)
    projection = sum(((F.col("centre")[i] - float(at["top"][i])) * float(unit[i]) for i in range(len(columns))), F.lit(0.0))
    out = each.withColumn("projection", projection).withColumn("estimated_position", 1 - 2 * F.col("projection") / length)
    return out.select(label, "n", "projection", "estimated_position", F.row_number().over(Window.orderBy("projection", label)).alias("new_label"))


def top_variance(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(feature, variance, rank) of the k columns with the largest population variance."""
    row = df.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])).alias("r")).select("r.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("variance"), "feature"))).where(F.col("rank") <= k)


def library_normalise(df: DataFrame, columns: list[str], total: float = 1e4) -> DataFrame:
    """Rows scaled to a common sum, then log(1 + x); rows that sum to 0 become 0."""
    whole = sum((F.coalesce(col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(col(columns[0]), F.lit(0.0)))
    return df.withColumns({c: F.log1p(F.coalesce(F.try_divide(F.coalesce(col(c), F.lit(0.0)) * total, whole), F.lit(0.0))) for c in columns})


def median_normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """log2 of rows divided by the median of their positive values and multiplied by the median of those medians; values of 0 or less are null."""
    positive = F.array_sort(F.filter(F.array(*[col(c).cast("double") for c in columns]), lambda v: v > 0))
    n = F.size(positive)
    middle = F.when(n > 0, (F.get(positive, ((n - 1) / 2).cast("int")) + F.get(positive, (n / 2).cast("int"))) / 2)
    with_median = df.withColumn("_median", middle)
    grand = with_median.agg(F.percentile("_median", 0.5)).first()[0] or 1.0
    return with_median.withColumns({c: F.when(col(c) > 0, F.log2(col(c) / F.col("_median") * float(grand))) for c in columns}).drop("_median")


def mirrored(column: str) -> Column:
    """The coordinate with its sign turned."""
    return -col(column)


def half_turn(first: str, second: str) -> tuple[Column, Column]:
    """Both coordinates after a turn by 180 degrees."""
    return -col(first), -col(second)


def _profile(df: DataFrame, columns: list[str], extra: dict) -> DataFrame:
    """(feature, ...) with one row per column, of aggregates {name: function of a Column}; one pass."""
    row = df.agg(*[f(col(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in extra.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in extra]) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def stable_features(df: DataFrame, columns: list[str], size: int, ladder: tuple = (1.0, 0.995, 0.99, 0.98, 0.97, 0.95, 0.9)) -> DataFrame:
    """(feature, place): the `size` features of least deviation over median, among those positive in the largest share of rows on the ladder
    that enough features reach (or in the last). Unknown and negative values count as 0; ties by name."""
    fixed = df.select(*[F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    spread = {"positive": lambda x: F.count_if(x > 0), "median": lambda x: F.percentile(x, 0.5), "n": lambda x: F.count(x)}
    each = _profile(fixed, columns, spread).join(_profile(df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns, {"sd": F.stddev_samp}), "feature")
    rows = each.withColumn("cv", F.try_divide("sd", "median")).collect()  # one row per feature
    n = rows[0]["n"] if rows else 0
    share = next((s for s in ladder if sum(x["positive"] >= s * n for x in rows) >= size), ladder[-1])
    fine = sorted((x["cv"] if x["cv"] is not None else math.inf, x["feature"]) for x in rows if x["positive"] >= share * n)[:size]
    return df.sparkSession.createDataFrame([(f, i) for i, (_, f) in enumerate(fine, 1)], "feature string, place int")


def variable_features(df: DataFrame, columns: list[str], k: int, total: float = 1e4) -> DataFrame:
    """(feature, log_dispersion, place): the k features of largest variance over mean, once rows are scaled to a common total."""
    fixed = df.select(*[F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    whole = sum((col(c) for c in columns[1:]), col(columns[0]))
    scaled = fixed.select(*[F.coalesce(F.try_divide(col(c) * total, whole), F.lit(0.0)).alias(c) for c in columns])
    each = _profile(scaled, columns, {"mean": F.avg, "variance": F.var_samp}).withColumn("dispersion", F.try_divide("variance", "mean"))
    ranked = each.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("dispersion"), "feature"))).where(F.col("place") <= k)  # one row per feature
    return ranked.select("feature", F.ln("dispersion").alias("log_dispersion"), "place")


def weighted_scores(loglik: tuple, bic: tuple, aic: tuple, cv: tuple, silhouette_: tuple) -> np.ndarray:
    """Weighted score of each number of clusters: 0.05 log-likelihood, 0.25 and 0.20 for low BIC and AIC, 0.35 held-out log-likelihood and
    0.15 silhouette, each scaled to 0..1 over the numbers tried. A number without a silhouette (one cluster) has none."""

    def scaled(values: tuple) -> np.ndarray:
        x = np.array([np.nan if v is None else v for v in values], float)
        return (x - np.nanmin(x)) / (np.nanmax(x) - np.nanmin(x) + 1e-10)

    return 0.05 * scaled(loglik) + 0.25 * (1 - scaled(bic)) + 0.2 * (1 - scaled(aic)) + 0.15 * scaled(silhouette_) + 0.35 * scaled(cv)
