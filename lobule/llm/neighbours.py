"""Most similar vectors by adaptive dimension scan over an inverted-list index.

Every row is indexed. Centroids are fitted on a bounded sample; vectors are turned by a random rotation, so the share of a distance
that the first s of D coordinates hold follows the beta distribution with s / 2 and (D - s) / 2. Within a probed list, candidates are
scanned in column blocks: after each block a hypothesis test compares the partial distance with the query's bound and abandons the
candidates for which a distance below the bound is implausible at level ALPHA. Each query keeps its k best, and its bound is the k-th of
them: it is first searched in its nearest lists, then, with the bound found there, in the others that can hold a nearer row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions.special import beta_share
from lobule.shared import join_one_row_each, pack, runs, slots, stage, unpack

SAMPLE = 65_536  # rows, about, that centroids are fitted on
MOST_LISTS = 16_384  # most centroids; lists beyond it grow and are cut into blocks
BLOCK_ROWS = 16_384  # most rows of a list in one block; a longer list is cut into several, each scanned for all its queries
ALPHA = 0.002  # chance that one test abandons a row lying exactly at the bound; nearer rows run less
COLUMNS = 4  # width of a column block
FIRST_LISTS = 2  # nearest lists, at least, that a query sees first; more until they hold FIRST_ROWS times as many rows as it wants
FIRST_ROWS = 4
RINGS = 16  # distances from a centroid, in steps that grow, whose occupied range is known for each list
ROWS_AT_ONCE = 512  # rows that a scan compares before it tightens the bounds


def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def turned(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """rows @ turn, summed in the same order for every row, so that equal rows stay equal whatever batch they are in."""
    out = np.zeros((len(rows), turn.shape[1]))
    for j in range(len(turn)):
        out += rows[:, j : j + 1] * turn[j]
    return out


@lru_cache(1024)
def plausible(seen: int, width: int, alpha: float = ALPHA) -> float:
    """The 1 - alpha quantile of the share of a squared distance that `seen` of `width` randomly turned coordinates hold."""
    if seen >= width:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if beta_share(seen / 2, (width - seen) / 2, x) < 1 - alpha else (low, x)
    return high


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means on the sample; emptied centroids keep their place. Fewer distinct rows give fewer centroids."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)[0]
        count = np.bincount(near, minlength=len(centroids))
        for j in range(sample.shape[1]):
            total = np.bincount(near, sample[:, j], len(centroids))
            centroids[:, j] = np.where(count > 0, total / np.maximum(count, 1), centroids[:, j])
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest centroid of each row."""
    norms = (centroids**2).sum(1)
    at, dist = np.empty(len(rows), np.int64), np.empty(len(rows))
    for a in range(0, len(rows), chunk):
        part = rows[a : a + chunk]
        score = norms - 2 * part @ centroids.T
        at[a : a + chunk] = best = score.argmin(1)
        dist[a : a + chunk] = np.sqrt(((part - centroids[best]) ** 2).sum(1))
    return at, dist


def scan(queries: np.ndarray, bounds: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, alpha: float = ALPHA, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The k nearest rows of each query among those within its bound, ties by id, up to the test's rare errors: (query, row, squared
    distance, counts). counts: pairs looked at, abandoned by the test alone, abandoned by the bound itself, finished.

    Rows come in chunks; after each the bound of a query falls to the k-th of its best. The first column block of a chunk is one matrix
    product; later blocks are computed only for the pairs that are left.
    """
    width = rows.shape[1]
    head = min(columns, width)
    square = np.asarray(bounds, float) ** 2
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    counts = [0, 0, 0, 0]
    sums = (queries[:, :head] ** 2).sum(1)[:, None]

    def keep(dist: np.ndarray, limit: np.ndarray, seen: int, extra: float) -> np.ndarray:
        by_bound = dist <= limit * (1 + 1e-9) + 1e-12 + extra
        left = by_bound & (dist <= limit * plausible(seen, width, alpha) * (1 + 1e-9) + 1e-12 + extra)
        kept, fine = int(left.sum()), int(by_bound.sum())
        counts[1] += fine - kept
        counts[2] += left.size - fine
        return left

    for c in range(0, len(rows), ROWS_AT_ONCE):
        x = rows[c : c + ROWS_AT_ONCE]
        counts[0] += len(queries) * len(x)
        partial = sums + (x[:, :head] ** 2).sum(1) - 2 * queries[:, :head] @ x[:, :head].T
        a, b = np.nonzero(keep(partial, square[:, None], head, 1e-6))  # the product rounds; what stays is computed anew
        dist = ((queries[a, :head] - x[b, :head]) ** 2).sum(1)
        seen = head
        while seen < width:
            upto = min(seen + columns, width)
            dist = dist + ((queries[a, seen:upto] - x[b, seen:upto]) ** 2).sum(1)
            seen = upto
            left = keep(dist, square[a], seen, 0.0)
            a, b, dist = a[left], b[left], dist[left]
        counts[3] += len(a)
        if len(a):
            held = best(np.r_[held[0], a], np.r_[held[1], b + c], np.r_[held[2], dist], ids, k)
            full = np.bincount(held[0], minlength=len(queries)) >= k
            last = np.zeros(len(queries))
            np.maximum.at(last, held[0], held[2])
            square = np.where(full, np.minimum(square, last), square)
    return *held, counts


def best(a: np.ndarray, b: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest of each query a, ties by id."""
    order = np.lexsort((ids[b], dist, a))
    a, b, dist = a[order], b[order], dist[order]
    if len(a) == 0:
        return a, b, dist
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    take = rank < k
    return a[take], b[take], dist[take]


def nearest_vectors(vectors: DataFrame, id_column: str, features: list[str], queries: DataFrame | None = None, k: int = 10, alpha: float = ALPHA, sample: int = SAMPLE, counters: list | None = None) -> DataFrame:
    """The k nearest other rows of each query row, by Euclidean distance: (query_id, neighbour_id, place, distance).

    vectors: id_column (long, unique) and finite double features; rows with a null, NaN or infinite feature or a null id take no part.
    queries: a table with the column id_column naming rows of `vectors`; None means every row. Ids that name no row are left out.
    A row is never its own neighbour, but an exact copy under another id is one, at distance 0. Ties go to the smaller id. Fewer than
    k other rows give fewer neighbours; an empty table gives an empty result. Other columns are ignored. Of equal rows only the k + 1
    with the smallest ids are indexed, as no others can be among anyone's k nearest, and equal queries are searched once, so groups of
    copies cost no more than single rows. counters: four accumulators that get the counts of scan().
    """
    spark = vectors.sparkSession
    width, want = len(features), k + 1  # a query finds itself too
    schema = "query_id long, neighbour_id long, place int, distance double"
    clean = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), *[(F.col(f"`{f}`").cast("double") + 0.0).alias(f"v{i}") for i, f in enumerate(features)])
    for i in range(width):
        clean = clean.where(F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") & (F.abs(f"v{i}") != float("inf")))
    clean = clean.where(F.col("id").isNotNull())
    names = [f"v{i}" for i in range(width)]
    key = [F.xxhash64(*names).alias("h1"), F.xxhash64(*names, F.lit(1)).alias("h2")]  # 128 bits stand for a vector
    n = clean.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    lists = int(np.clip(2 * np.sqrt(n), 1, MOST_LISTS))
    share = max(1, -(-n // sample))
    taken = clean.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(share)) == 0).drop("id").limit(2 * sample).toPandas().to_numpy(np.float64)
    if len(taken) <= k:
        taken = clean.drop("id").limit(sample).toPandas().to_numpy(np.float64)
    turn = rotation(width)
    taken = turned(taken, turn)
    centroids = fit_centroids(taken[:: max(1, len(taken) // (32 * lists))], lists)
    step = float(np.median(nearest(taken[:4096], centroids)[1])) or 1.0
    fitted = spark.sparkContext.broadcast((turn, centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centroids = fitted.value
        for batch in batches:
            rows = turned(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]), turn)
            at, dist = nearest(rows, centroids)
            ring = np.minimum(RINGS - 1, 2 * np.log2(dist / step + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h1"), batch.column("h2"), pa.array(at, pa.int32()), pa.array(ring), pa.array(dist), pack(rows)], ["id", "h1", "h2", "list", "ring", "off", "vec"])

    marked = clean.select("id", *names, *key)
    spare = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    index = stage(marked.withColumn("n", spare).where(F.col("n") <= want).drop("n").mapInArrow(assign, "id long, h1 long, h2 long, list int, ring int, off double, vec binary"), "vectors")
    rings = index.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).toPandas()  # at most MOST_LISTS x RINGS rows
    size, low, high = np.zeros(len(centroids), np.int64), np.full((len(centroids), RINGS), np.inf), np.full((len(centroids), RINGS), -np.inf)
    np.add.at(size, rings["list"], rings["n"])
    low[rings["list"], rings["ring"]], high[rings["list"], rings["ring"]] = rings["low"], rings["high"]
    blocks = -(-size // BLOCK_ROWS)
    probes = spark.sparkContext.broadcast((size, low, high, blocks))

    asked = marked if queries is None else marked.join(queries.select(F.col(f"`{id_column}`").cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = stage(asked.select("id", "h1", "h2"), "asked")
    classes = asked.groupBy("h1", "h2").agg(F.count("*").alias("asking"))
    least = index.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "vec"), "id").alias("r")).select("h1", "h2", "r.*")
    reps = stage(classes.join(least, ["h1", "h2"]).select("h1", "h2", "asking", "id", "vec"), "queries")  # one row per distinct query vector

    def seen_first(away: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mask of the nearest lists of each query, that together hold enough rows."""
        order = np.argsort(away, 1, kind="stable")
        upto = np.cumsum(size[order], 1)
        take = (upto - size[order] < FIRST_ROWS * want) | (np.arange(len(size)) < FIRST_LISTS)
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, take, 1)
        return out & (size > 0)

    def route(first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query to all blocks of its nearest lists, or of the other lists that have a ring within its bound."""
            size, low, high, blocks = probes.value
            centroids = fitted.value[1]
            own = (centroids**2).sum(1)
            floor, ceiling = low.min(1), high.max(1)
            for batch in batches:
                rows, ids = unpack(batch.column("vec"), width), batch.column("id").to_numpy(zero_copy_only=False)
                limits = np.full(len(rows), np.inf) if first else batch.column("bound").to_numpy(zero_copy_only=False)
                for a in range(0, len(rows), 256):
                    q, bound = rows[a : a + 256], limits[a : a + 256]
                    away = np.sqrt(np.maximum((q**2).sum(1)[:, None] + own - 2 * q @ centroids.T, 0))
                    mask = seen_first(away, size)
                    if not first:
                        slack = bound[:, None] * (1 + 1e-9) + 1e-6 * (1 + away)
                        mask = ~mask & (size > 0) & (away - slack <= ceiling) & (away + slack >= floor)
                    i, c = np.nonzero(mask)
                    if not first and len(i):
                        near = slack[i, c][:, None]
                        some = ((away[i, c][:, None] - near <= high[c]) & (away[i, c][:, None] + near >= low[c])).any(1)
                        i, c = i[some], c[some]
                    times = blocks[c]
                    i, c = np.repeat(i, times), np.repeat(c, times)
                    part = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(i), np.int32)), pa.array(ids[a : a + 256][i]), pa.array(bound[i]), pack(q[i])], ["list", "part", "kind", "id", "off", "vec"])

        return work

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted: first their rows, which are kept, in the order of their distance from the centroid; then their queries, which
        stream by. A batch of queries sees only the rows whose distance from the centroid differs from theirs by no more than the bound."""
        at, held, rows = None, [], None
        for (lst, part, kind), piece in runs(batches, ["list", "part", "kind"]):
            if (lst, part) != at:
                at, held, rows = (lst, part), [], None
            if kind == 0:
                held.append(piece)
                continue
            if not held:
                continue
            if rows is None:
                off = np.concatenate([p.column("off").to_numpy(zero_copy_only=False) for p in held])
                order = np.argsort(off, kind="stable")
                off = off[order]
                rows = np.concatenate([unpack(p.column("vec"), width) for p in held])[order]
                ids = np.concatenate([p.column("id").to_numpy(zero_copy_only=False) for p in held])[order]
            asking, bound, q = piece.column("id").to_numpy(zero_copy_only=False), piece.column("off").to_numpy(zero_copy_only=False), unpack(piece.column("vec"), width)
            away = np.sqrt(((q - fitted.value[1][lst]) ** 2).sum(1))
            order = np.argsort(away, kind="stable")
            for a in range(0, len(q), 1024):
                some = order[a : a + 1024]
                slack = 1e-6 * (1 + away[some]) + bound[some]
                x, y = np.searchsorted(off, (away[some] - slack).min(), "left"), np.searchsorted(off, (away[some] + slack).max(), "right")
                i, j, dist, counts = scan(q[some], bound[some], rows[x:y], ids[x:y], want, alpha)
                for counter, c in zip(counters or (), counts):
                    counter.add(c)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(asking[some][i]), pa.array(ids[x:y][j]), pa.array(np.sqrt(dist))], ["query_id", "neighbour_id", "distance"])

    hot = {i: int(b) for i, b in enumerate(blocks) if b > 1}
    shares = F.coalesce(F.element_at(F.create_map(*[x for i, s in hot.items() for x in (F.lit(i), F.lit(s))]), F.col("list")), F.lit(1)) if hot else F.lit(1)
    held = index.select("list", F.pmod(F.xxhash64("id", F.lit(5)), shares).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "off", "vec")
    routed = "list int, part int, kind int, id long, off double, vec binary"

    def find(asks: DataFrame, first: bool) -> DataFrame:
        met = held.unionByName(asks.mapInArrow(route(first), routed)).repartition(slots(spark), "list", "part").sortWithinPartitions("list", "part", "kind", "id")
        return met.mapInArrow(search, "query_id long, neighbour_id long, distance double")

    def top(found: DataFrame) -> DataFrame:
        """At most `want` entries come from one block, so a query's array stays small."""
        return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, want).alias("near"))

    near = stage(top(find(reps.select("id", "vec"), True)), "near")
    bounded = near.select(F.col("query_id").alias("id"), F.when(F.size("near") == want, F.element_at("near", -1)["distance"]).otherwise(float("inf")).alias("bound"))
    others = find(reps.select("id", "vec").join(bounded, "id", "left").select("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), False)
    every = near.select("query_id", F.explode("near").alias("r")).select("query_id", "r.neighbour_id", "r.distance").unionByName(others)
    answers = reps.select("h1", "h2", "asking", F.col("id").alias("query_id")).join(top(every), "query_id").drop("query_id")
    out = join_one_row_each(asked, stage(answers, "answers"), ["h1", "h2"], "asking")
    own = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(own).alias("place", "r"))
    return out.select("query_id", F.col("r.neighbour_id").alias("neighbour_id"), (F.col("place") + 1).alias("place"), F.col("r.distance").alias("distance"))
