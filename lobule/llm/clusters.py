"""Similarity clusters: neighbour descent, modularity communities, and their most typical members.

The work goes in levels. On each level a random-projection tree, fitted on a bounded sample, cuts the points into blocks of bounded
size. A block builds its approximate nearest-neighbour graph by neighbour descent, drops edges longer than the radius, and divides
the graph into communities by greedy modularity. Each community is stood for by its medoid, the member of highest internal weighted
degree; the medoids, with the weights of their communities, are the points of the next level, until one block holds them all or the
levels no longer shrink. At last communities whose medoids lie within the radius are joined: in the block, or, where there are more
medoids than a block holds, by a join over Voronoi cells with halos and connected components. No level sends more than a bounded
sample to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.llm.neighbours import nearest
from lobule.operators.graph import connected_components
from lobule.operators.nearest import halves
from lobule.shared import groups, join_one_row_each, pack, runs, slots, stage, unpack

BLOCK = 4096  # points that a block aims at; a leaf beyond four times this is cut further by hash
SAMPLE = 65_536  # rows, about, that a tree is fitted on
NEIGHBOURS = 10
SHRINK = 0.9  # a level that leaves more than this share of its points is idle; the next tries another tree
IDLE = 2  # after so many idle levels in a row the medoids are joined
CANDIDATES = 32  # members of highest degree of a cluster that are marked as its candidates
MEET = 32_768  # points of one side, at most about, that meet for their degrees
LEAF = 512  # points compared at once
FADED = 80.0  # terms of less than exp(-80) are no part of a degree


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of equal length as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_tree(sample: np.ndarray, leaves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of median splits along random directions: directions and cuts by node, children of i at 2i+1 and 2i+2."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    nodes = 2**depth - 1
    lines, cuts = rng.normal(size=(nodes, sample.shape[1])), np.zeros(nodes)
    held = {0: np.arange(len(sample))}
    for i in range(nodes):
        rows = held.pop(i)
        if len(rows) > 1:
            a, b = sample[rows[rng.integers(len(rows), size=2)]]
            if (a != b).any():
                lines[i] = a - b
        at = sample[rows] @ lines[i]
        cuts[i] = np.median(at) if len(rows) else 0.0
        if 2 * i + 2 < nodes:
            held[2 * i + 1], held[2 * i + 2] = rows[at <= cuts[i]], rows[at > cuts[i]]
    return lines, cuts


def leaf_of(rows: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    lines, cuts = tree
    at = np.zeros(len(rows), np.int64)
    for _ in range(int(np.log2(len(cuts) + 1))):
        right = np.einsum("ij,ij->i", rows, lines[at]) > cuts[at]
        at = 2 * at + 1 + right
    return at - len(cuts)


def neighbour_descent(x: np.ndarray, k: int = NEIGHBOURS, seed: int = 0, rounds: int = 12, stop: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest neighbours (index, distance) of each row, missing ones -1 and infinite.

    Starts from rows that are near on random lines; each round tries the neighbours of neighbours in both directions and stops once
    fewer than `stop` of the entries change.
    """
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 0), -1), np.full((n, 0), np.inf)
    rng = np.random.default_rng(seed)
    start = []
    for _ in range(2):
        order = np.argsort(x @ rng.normal(size=x.shape[1]), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        steps = np.r_[-(k // 2 + 1) : 0, 1 : k // 2 + 2]
        start.append(order[np.clip(place[:, None] + steps, 0, n - 1)])
    near, dist = keep_nearest(x, np.concatenate(start, 1), k)
    width = max(3, k // 2 + 1)
    for _ in range(rounds):
        back = reverse(near, n, width, rng)
        joined = np.concatenate([near[:, :width], back], 1)
        hop = joined[np.where(joined >= 0, joined, 0)]
        hop[joined < 0] = -1
        tried = hop.reshape(n, -1)
        tried = tried[:, rng.permutation(tried.shape[1])[: 6 * k]]
        after, away = keep_nearest(x, np.concatenate([near, back, tried], 1), k)
        changed = (after != near).mean()
        near, dist = after, away
        if changed < stop:
            break
    return near, dist


def reverse(near: np.ndarray, n: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """Up to `width` random rows that hold each row as neighbour, -1 where there are fewer."""
    to, source = near.ravel(), np.repeat(np.arange(n), near.shape[1])
    fine = to >= 0
    to, source = to[fine], source[fine]
    mixed = rng.permutation(len(to))
    to, source = to[mixed], source[mixed]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    first = np.searchsorted(to, np.arange(n))
    place = np.arange(len(to)) - first[to]
    out = np.full((n, width), -1)
    use = place < width
    out[to[use], place[use]] = source[use]
    return out


def keep_nearest(x: np.ndarray, candidates: np.ndarray, k: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct candidates of each row, the row itself and -1 left out."""
    n = len(x)
    near, dist = np.full((n, k), -1), np.full((n, k), np.inf)
    for a in range(0, n, chunk):
        c = np.sort(candidates[a : a + chunk], 1)
        rows = np.arange(a, a + len(c))[:, None]
        bad = (c < 0) | (c == rows)
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        away = np.zeros(c.shape)
        for j in range(x.shape[1]):
            column = x[:, j]
            away += (column[c] - column[rows]) ** 2
        away[bad] = np.inf
        if c.shape[1] > k:
            pick = np.argpartition(away, k - 1, 1)[:, :k]
            c, away = np.take_along_axis(c, pick, 1), np.take_along_axis(away, pick, 1)
        order = np.argsort(away, 1, kind="stable")
        away = np.take_along_axis(away, order, 1)
        got = np.take_along_axis(c, order, 1)
        got[~np.isfinite(away)] = -1
        near[a : a + chunk, : got.shape[1]], dist[a : a + chunk, : got.shape[1]] = got, np.sqrt(away)
    return near, dist


def similarity_graph(near: np.ndarray, dist: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of each distinct edge within the radius, weight exp(-(distance / (radius / 2))^2)."""
    n = len(near)
    a, b, d = np.repeat(np.arange(n), near.shape[1]), near.ravel(), dist.ravel()
    fine = (b >= 0) & (d <= radius)
    a, b, d = a[fine], b[fine], d[fine]
    low, high = np.minimum(a, b), np.maximum(a, b)
    key, first = np.unique(low * n + high, return_index=True)
    low, high = key // max(n, 1), key % max(n, 1)
    w = np.exp(-((2 * d[first] / radius) ** 2)) + 1e-9
    return np.r_[low, high], np.r_[high, low], np.r_[w, w]


def communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, weight: np.ndarray, seed: int = 0, resolution: float = 1.0) -> np.ndarray:
    """Community of each node by greedy modularity: local moves until none gains, then the communities become nodes, and again.

    a, b, w: both directions of each edge. `weight` (points a node stands for) multiplies the edges' weights at both ends.
    """
    n = len(weight)
    label = np.arange(n)
    if not len(a):
        return label
    a, b, w = a.copy(), b.copy(), w * weight[a] * weight[b]
    rng = np.random.default_rng(seed)
    nodes = n
    while True:
        degree = np.bincount(a, w, nodes)
        total = degree.sum()
        own = np.arange(nodes)
        plain = a != b
        ea, eb, ew = a[plain], b[plain], w[plain]
        for step in range(16):
            inside = np.bincount(own, degree, nodes)
            key = ea * nodes + own[eb]
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.array([], int)
            links = np.add.reduceat(ew[order], start) if len(start) else np.array([])
            node, target = key[order][start] // nodes, key[order][start] % nodes
            gain = links - resolution * degree[node] * (inside[target] - np.where(target == own[node], degree[node], 0)) / total
            stay = np.where(own[node] == target, gain, -np.inf)
            now = np.full(nodes, 0.0) - resolution * degree * (inside[own] - degree) / total
            np.maximum.at(now, node[np.isfinite(stay)], stay[np.isfinite(stay)])
            sort = np.lexsort((target, -gain, node))
            lead = sort[np.flatnonzero(np.r_[True, np.diff(node[sort]) != 0])] if len(sort) else sort
            better = gain[lead] > now[node[lead]] + 1e-12 * total
            move = lead[better & (rng.random(len(lead)) < 0.5)]
            if not better.any():
                break
            own[node[move]] = target[move]
        names, own = np.unique(own, return_inverse=True)
        label = own[label]
        if len(names) == nodes:
            return label
        key = own[a] * len(names) + own[b]
        key, at = np.unique(key, return_inverse=True)
        w = np.bincount(at, w, len(key))
        a, b, nodes = key // len(names), key % len(names), len(names)


def connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def divide(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, radius: float, k: int, last: bool) -> np.ndarray:
    """Of one block: for each point the id of its community's medoid, the member of highest weighted degree inside the community."""
    near, dist = neighbour_descent(x, k)
    a, b, w = similarity_graph(near, dist, radius)
    label = communities(a, b, w, weight.astype(float))
    inner = label[a] == label[b]
    degree = np.bincount(a[inner], w[inner] * weight[b[inner]], len(ids)).astype(float) + weight - 1  # copies that a point stands for lie at distance 0
    order = np.lexsort((ids, -degree, label))
    first = order[np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])]
    name = np.arange(len(first))
    if last:
        y = x[first]
        links = [np.nonzero(((y[c : c + 256, None, :] - y[None, :, :]) ** 2).sum(2) <= radius**2) for c in range(0, len(y), 256)]
        name = connected(np.concatenate([p + 256 * i for i, (p, _) in enumerate(links)]), np.concatenate([q for _, q in links]), len(y))
        mass = np.bincount(label, weight, len(first))
        for c in np.unique(name):  # a joined cluster is named by the medoid of its heaviest community
            inside = np.flatnonzero(name == c)
            name[inside] = inside[mass[inside].argmax()]
    return ids[first[name[label]]]


def join_medoids(nodes: DataFrame, count: int, width: int, radius: float, block: int, sample: int) -> DataFrame:
    """(medoid, cluster) of the nodes (id, vec, weight) with a node within the radius: the heaviest node of each component of that relation.

    Every node belongs to the Voronoi cell of its nearest pivot and is copied to each cell whose pivot is at most two radii further away,
    so any two nodes within the radius meet in the cell of either. Cells beyond a block are cut by hash; a cut meets all the cell's own
    nodes. Of the pairs a task finds it passes on a spanning forest only, at most one edge a node.
    """
    spark = nodes.sparkSession
    cells = min(max(1, -(-2 * count // block)), sample // 4)
    share = max(1, count // (4 * cells))
    pivots = matrix(nodes.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(share)) == 0).select("vec").limit(cells).toArrow().column("vec"), width)
    if not len(pivots):
        pivots = matrix(nodes.select("vec").limit(cells).toArrow().column("vec"), width)
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (sent.value**2).sum(1)
        for batch in batches:
            x, ids = matrix(batch.column("vec"), width), batch.column("id").to_numpy()
            for a in range(0, len(x), 1024):
                part = x[a : a + 1024]
                own, least = nearest(part, sent.value)
                away = np.sqrt(np.maximum(norms - 2 * part @ sent.value.T + (part**2).sum(1)[:, None], 0))
                away[np.arange(len(part)), own] = least
                i, c = np.nonzero(away <= least[:, None] + 2 * radius + 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(c == own[i]), pa.array(ids[a : a + 1024][i]), pack(part[i])], ["cell", "own", "id", "vec"])

    placed = stage(nodes.mapInArrow(place, "cell int, own boolean, id long, vec binary"), "placed")
    sizes = placed.groupBy("cell").count().where(F.col("count") > 2 * block).collect()  # at most one row per pivot
    parts = F.lit(1)
    if sizes:
        parts = F.coalesce(F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["cell"]), F.lit(-(-r["count"] // block)))]), F.col("cell")), F.lit(1))
    held = placed.select("cell", F.pmod(F.xxhash64("id", F.lit(13)), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "vec")
    asking = placed.where("own").select("cell", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, ids, y = None, [], None, None
        for (cell, part, kind), piece in runs(batches, ["cell", "part", "kind"]):
            if (cell, part) != at:
                at, known, y = (cell, part), [], None
            if kind == 0:
                known.append(piece)
                continue
            if not known:
                continue
            if y is None:
                y = np.concatenate([unpack(p.column("vec"), width) for p in known])
                ids = np.concatenate([p.column("id").to_numpy() for p in known])
            x, own = unpack(piece.column("vec"), width), piece.column("id").to_numpy()
            names, spot = np.unique(np.r_[own, ids], return_inverse=True)
            label = np.arange(len(names))
            for a in range(0, len(x), 256):
                i, j = np.nonzero(((x[a : a + 256, None, :] - y[None, :, :]) ** 2).sum(2) <= radius**2)
                label = label[connected(label[spot[: len(x)][a : a + 256][i]], label[spot[len(x) :][j]], len(names))[label]]
            linked = label != np.arange(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[label[linked]])], ["src", "dst"])

    met = held.unionByName(asking).repartition(slots(spark), "cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
    forest = stage(met.mapInArrow(meet, "src long, dst long"), "forest")
    found = connected_components(stage(forest.unionByName(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links"))
    named = found.withColumnRenamed("node", "id").join(nodes.select("id", "weight"), "id")
    heaviest = named.groupBy("component").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("cluster"))
    return named.join(heaviest, "component").select(F.col("id").alias("medoid"), "cluster")


def kernel_sums(x: np.ndarray, of_x: np.ndarray, y: np.ndarray | None, of_y: np.ndarray | None, radius: float) -> tuple[np.ndarray, np.ndarray | None]:
    """For each row of x the sum of weight * exp(-(2 distance / radius)^2) over the rows of y, and for each of y that over x; without y among
    the rows of x, a row's own term included. Each two rows meet once. Leaves so far apart that no term reaches exp(-FADED) are left out."""
    scale = 2 / radius
    sides = []
    for z, weight in ((x, of_x), *([(y, of_y)] if y is not None else [])):
        order, starts = halves(z, LEAF)
        z = z[order]
        sides.append((order, starts, np.r_[starts[1:], len(z)], z, weight[order].astype(float), np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts), np.zeros(len(z))))
    _, starts, ends, z, mass, low, high, sums = sides[0]
    _, begins, stops, other, weights, floor, top, back = sides[-1]
    for i, (a, b) in enumerate(zip(starts, ends)):
        apart = ((scale * np.maximum(0, np.maximum(floor - high[i], low[i] - top))) ** 2).sum(1)
        leaves = np.flatnonzero(apart <= FADED)
        middle = (low[i] + high[i]) / 2
        p = (z[a:b] - middle) * scale
        left = np.column_stack([2 * p, -(p * p).sum(1), np.ones(b - a)])
        for j in leaves[leaves >= i] if y is None else leaves:
            c, d = begins[j], stops[j]
            q = (other[c:d] - middle) * scale
            size = (q * q).sum(1)
            if -left[:, -2].min() + size.max() < 1e3:
                near = left @ np.column_stack([q, np.ones(d - c), -size]).T
            else:  # products would cancel
                near = np.zeros((b - a, d - c))
                for k in range(z.shape[1]):
                    near -= (scale * (z[a:b, k : k + 1] - other[c:d, k])) ** 2
            np.exp(near, out=near)
            sums[a:b] += near @ weights[c:d]
            if y is not None or j != i:
                back[c:d] += mass[a:b] @ near
    out = [np.empty(len(side[0])) for side in sides]
    for found, side in zip(out, sides):
        found[side[0]] = side[-1]
    return out[0], out[1] if y is not None else None


def member_degrees(points: DataFrame, width: int, radius: float) -> DataFrame:
    """(id, degree, is_candidate) of points (id, cluster, vec, weight): every point's weighted degree within its whole cluster, the sum of
    weight * exp(-(2 distance / radius)^2) over all members, and whether it is one of the CANDIDATES of highest degree (to six digits, ties by id).

    All members of a cluster meet, each two once. Clusters of more than MEET points are cut by hash into blocks; every two blocks meet
    in a group of their own. The cost is quadratic in a cluster's points by definition.
    """
    spark = points.sparkSession
    big = {r["cluster"]: -(-r["count"] // MEET) for r in points.groupBy("cluster").count().where(F.col("count") > MEET).collect()}  # at most points / MEET rows
    parts = F.lit(1)
    if big:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in big.items() for x in r]), F.col("cluster")), F.lit(1))
    tagged = points.withColumn("parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(29)), F.col("parts")).cast("int"))
    tagged = tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = tagged.select("cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "id", "vec", "weight")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, first, second), t in groups(batches, ["cluster", "first", "second"]):
            x, weight, at = matrix(t.column("vec"), width), t.column("weight").to_numpy(), t.column("block").to_numpy()
            total = weight.astype(float)
            sides = [np.flatnonzero(at == s) for s in (first, second)]
            if first == second and len(x) > 1:
                total, _ = kernel_sums(x, weight, None, None, radius)
            elif first != second:
                total = np.zeros(len(x))
                if all(len(s) for s in sides):
                    for s, found in zip(sides, kernel_sums(*[v for s in sides for v in (x[s], weight[s])], radius)):
                        total[s] = found
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(np.full(len(x), cluster)), pa.array(total)], ["id", "cluster", "degree"])

    meetings = sum(n * (n + 1) // 2 for n in big.values())
    met = sent.repartition(slots(spark, min(2 * meetings, 100_000)), "cluster", "first", "second").sortWithinPartitions("cluster", "first", "second", "id")
    found = met.mapInArrow(meet, "id long, cluster long, degree double").groupBy("id", "cluster").agg((F.sum("degree") - 1).alias("degree"))
    degrees = stage(found, "degrees")
    by = Window.partitionBy("cluster").orderBy(F.desc(F.round("degree", 6)), "id")
    best = degrees.withColumn("n", F.row_number().over(by)).where(F.col("n") <= CANDIDATES).select("id", F.lit(True).alias("best"))
    return degrees.join(best, "id", "left").select("id", "degree", F.col("best").isNotNull().alias("is_candidate"))


def similarity_clusters(vectors: DataFrame, id_column: str, features: list[str], radius: float, k: int = NEIGHBOURS, block: int = BLOCK, sample: int = SAMPLE, degrees: bool = True) -> DataFrame:
    """Every row's cluster: (id, cluster[, degree, is_candidate]), cluster being the id of one of its typical members.

    Rows are similar if their distance is at most `radius`; clusters are the communities of that similarity, joined where their medoids
    are similar. Where similarity never contradicts itself (it is transitive), the clusters are exactly its classes, whatever their number.
    degree: weighted degree of the row within its whole cluster, see member_degrees; exact copies share it. The most typical members are
    the candidates of highest degree.
    Rows with a null, NaN or infinite feature or a null id take no part; exact copies are handled once, whatever their number.
    A row with no similar one is a cluster of its own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    width = len(features)
    values = [F.col(f"`{f}`").cast("double") + 0.0 for f in features]
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.array(*values).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    key = [F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")]  # 128 bits stand for a vector in the last join
    nodes = points = stage(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "points")
    count, idle, level = points.count(), 0, 0
    if count == 0:
        return spark.createDataFrame([], "id long, cluster long" + (", degree double, is_candidate boolean" if degrees else ""))
    chain = points.select("id", F.col("id").alias("cluster"))
    while True:
        last = count <= block
        if not last and idle == IDLE:
            joined = join_medoids(nodes, count, width, radius, block, sample)
            chain = follow(chain, joined)
            break
        leaves = 1 if last else -(-count // block)
        tree = None
        if not last:
            share = max(1, -(-count // sample))
            taken = nodes.where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(share)) == 0).select("vec").limit(2 * sample).toArrow()
            tree = fit_tree(matrix(taken.column("vec"), width), min(leaves, sample // 8), seed=level)
        sent = spark.sparkContext.broadcast(tree)

        def cut(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"), width)
                leaf = np.zeros(len(x), np.int64) if sent.value is None else leaf_of(x, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("id"), pack(x), batch.column("weight")], ["leaf", "id", "vec", "weight"])

        placed = nodes.select("id", "vec", "weight").mapInArrow(cut, "leaf long, id long, vec binary, weight long").withColumn("part", F.lit(0))
        if not last:
            # a leaf that the sample misjudged is cut further by hash; its communities meet again on the next level
            sizes = placed.groupBy("leaf").count().where(F.col("count") > 4 * block).collect()
            if sizes:
                parts = F.create_map(*[x for r in sizes for x in (F.lit(r["leaf"]), F.lit(-(-r["count"] // (2 * block))))])
                placed = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce(F.element_at(parts, F.col("leaf")), F.lit(1))).cast("int"))

        def work(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            for _, t in groups(batches, ["leaf", "part"]):
                ids, weight, x = t.column("id").to_numpy(), t.column("weight").to_numpy(), unpack(t.column("vec"), width)
                medoid = divide(ids, x, weight, radius, k, last)
                names, at = np.unique(medoid, return_inverse=True)
                mass, lead = np.bincount(at, weight, len(names)).astype(np.int64)[at], medoid == ids
                vec = pa.array([v if m else None for v, m in zip(x.tolist(), lead)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(medoid), pa.array(mass), vec], ["id", "medoid", "weight", "vec"])

        tasks = 1 if last else slots(spark, min(leaves, 100_000))
        schema = "id long, medoid long, weight long, vec array<double>"
        done = stage(placed.repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "id").mapInArrow(work, schema), "level")
        step = done.select(F.col("id").alias("medoid"), F.col("medoid").alias("cluster"))
        chain = step.select(F.col("medoid").alias("id"), "cluster") if level == 0 else follow(chain, step)
        if last:
            break
        nodes = done.where("id = medoid").select("id", "vec", "weight")
        before, count, level = count, nodes.count(), level + 1
        idle = idle + 1 if count > SHRINK * before else 0
    found = stage(points.join(chain, "id"), "found")  # one row per distinct vector
    of_point = found.select(*key, "cluster", "weight", "id")
    if degrees:
        of_point = of_point.join(member_degrees(found, width, radius), "id")
    return join_one_row_each(rows.select("id", *key), of_point.drop("id"), ["h1", "h2"], "weight").drop("h1", "h2")


def follow(chain: DataFrame, step: DataFrame) -> DataFrame:
    """The chain (id, cluster) one step (medoid, cluster) on; clusters without a step stay. A medoid may stand for very many points, so
    steps are joined to the distinct clusters first and sent to the points of heavy ones."""
    sizes = chain.groupBy("cluster").agg(F.count("*").alias("size"))
    named = sizes.join(step.select(F.col("medoid").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left")
    moved = join_one_row_each(chain, stage(named.select("cluster", F.coalesce("next", "cluster").alias("next"), "size"), "steps"), ["cluster"], "size")
    return stage(moved.select("id", F.col("next").alias("cluster")), "chain")
