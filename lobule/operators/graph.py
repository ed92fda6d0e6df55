"""Neighbour graphs, components, shortest paths, Markov chains on them, absorption and routes; edges are DataFrames (src, dst, w).

Iterations are joins that stop when nothing changes; each round is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions.cleaning import col
from lobule.operators.nearest import nearest
from lobule.shared import free, stage

BLOCK = 4096
HELD = 5_000_000  # edges of a chain that one task holds
DENSE = 6_000  # nodes up to which a chain is solved directly
LEAST_STEP = 1e-9  # steps less likely than this are not followed: what they carry is beyond the precision of the sums


def knn(df: DataFrame, key: str, columns: list[str], k: int, metric: str = "euclidean", spent: DataFrame | None = None) -> DataFrame:
    """(src, dst, place, d): the exact k nearest other rows of every complete row with finite values, ties by key.

    metric: euclidean, searched by cells (nearest.py), or cosine (1 - cosine), where blocks of rows meet in pairs, which is quadratic; a block
    pair sends only its k best on. spent: see nearest(); not used for cosine.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.array(*[col(c).cast("double") + 0.0 for c in columns]).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    if metric == "euclidean":
        return nearest(rows, len(columns), k, spent=spent)
    blocks = max(1, -(-rows.count() // BLOCK))
    tagged = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asks, held = tagged.withColumn("q", F.col("block")).withColumn("h", every), tagged.withColumn("h", F.col("block")).withColumn("q", every)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id")
            y, ids = np.stack(right["x"].to_numpy()), right["id"].to_numpy()
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            for c in range(0, len(left), 512):
                x, own = np.stack(left["x"].to_numpy()[c : c + 512]), left["id"].to_numpy()[c : c + 512]
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                d = 1 - x @ y.T
                d[own[:, None] == ids] = np.inf
                near = np.argsort(d, 1, kind="stable")[:, :k] if len(ids) <= 4 * k else None
                if near is None:  # the k smallest, then all that tie with the last of them
                    last = np.partition(d, k - 1, 1)[:, k - 1 : k]
                    i, j = np.nonzero(d <= last)
                else:
                    i, j = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
                fine = np.isfinite(d[i, j])
                out.append(pd.DataFrame({"src": own[i[fine]], "dst": ids[j[fine]], "d": d[i[fine], j[fine]]}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "d": []})

    found = asks.groupBy("q", "h").cogroup(held.groupBy("q", "h")).applyInPandas(meet, "src long, dst long, d double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("place") <= k)


def affinity(near: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): exp(-d^2 / (2 s_src s_dst)) with s the k-th distance + 1e-8, both directions added, so mutual neighbours count twice."""
    return both_ways(pair_weights(near))


def pair_weights(near: DataFrame, time: DataFrame | None = None) -> DataFrame:
    """(a, b, w), a < b: the weights of affinity(), each pair once; with `time` (node, pseudotime) also a_time and b_time, null where there is none.

    Pairs are shuffled by a and by b only; times travel with the scales."""
    ends = near.groupBy("src").agg((F.max("d") + 1e-8).alias("s")).withColumnRenamed("src", "node")
    if time is not None:
        ends = ends.join(time.select("node", F.col("pseudotime").alias("time")), "node", "left")
    end = lambda side: ends.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in ends.columns])
    pairs = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "d").repartition("a").groupBy("a", "b").agg(F.first("d").alias("d"), F.count("*").alias("times"))
    w = F.col("times") * F.exp(-F.col("d") ** 2 / (2 * F.col("a_s") * F.col("b_s")))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", w.alias("w"), *[f"{side}_time" for side in "ab" if time is not None])


def both_ways(pairs: DataFrame) -> DataFrame:
    """The edges (src, dst, w, and src_time and dst_time if there are times) of pair_weights(), in both directions."""
    names = [n for n in ("", "_time") if f"a{n}" in pairs.columns]
    way = lambda a, b: F.struct(*[F.col(f"{side}{n}").alias(f"{end}{n}") for n in names for end, side in (("src", a), ("dst", b))])
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "w").select("e.src", "e.dst", "w", *[f"e.{end}_time" for end in ("src", "dst") if len(names) > 1])


def _held(rows: DataFrame, work, names: list[str], schema: str) -> DataFrame:
    """What `work` makes of all rows in one task (columns as arrays in, arrays out), staged."""

    given = rows.columns

    def one(part: pa.Table) -> pa.Table:
        out = work(*[part.column(c).to_numpy() for c in given])
        return pa.Table.from_arrays([pa.array(x) for x in out], names)

    return stage(rows.groupBy(F.lit(0).alias("all")).applyInArrow(one, schema), "held")


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b):
            np.minimum.at(after, label[side], low)
        while (further := after[after]).tobytes() != after.tobytes():
            after = further
        label = after
        open_edges = label[a] != label[b]
        a, b = a[open_edges], b[open_edges]
    return ids, ids[label]


def _waves(src: np.ndarray, dst: np.ndarray, length: np.ndarray, start: np.ndarray, most_rounds: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, distance) of all nodes reached from the start nodes: only nodes whose distance fell send it on. once: a node that is reached
    keeps its distance."""
    ids, at = np.unique(np.concatenate([src, dst, start]), return_inverse=True)
    order = np.argsort(at[: len(src)], kind="stable")
    a, b, length = at[: len(src)][order], at[len(src) : 2 * len(src)][order], length[order]
    first = np.searchsorted(a, np.arange(len(ids) + 1))
    dist, front = np.full(len(ids), np.inf), np.unique(at[2 * len(src) :])
    dist[front] = 0
    for _ in range(most_rounds):
        count = first[front + 1] - first[front]
        edge = np.repeat(first[front] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        to, new = b[edge], np.repeat(dist[front], count) + length[edge]
        fell = new < (np.where(np.isinf(dist[to]), np.inf, -np.inf) if once else dist[to])
        to, new = to[fell], new[fell]
        if not len(to):
            return ids[np.isfinite(dist)], dist[np.isfinite(dist)]
        np.minimum.at(dist, to, new)
        front = np.unique(to)
    raise RuntimeError(f"new nodes or shorter ways are still found after {most_rounds} rounds")


def _from(edges: DataFrame, length, start: DataFrame, most_rounds: int, once: bool) -> DataFrame:
    """(node, dist) by _waves() in one task; a start node is a row without destination."""
    kind = dict(edges.dtypes)["src"]
    rows = edges.select("src", "dst", length.cast("double").alias("len"), F.lit(False).alias("start"))
    rows = rows.unionByName(start.select(F.col("node").cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"), F.lit(0.0).alias("len"), F.lit(True).alias("start")))

    def work(src: np.ndarray, dst: np.ndarray, length: np.ndarray, is_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        way = ~is_start.astype(bool)
        return _waves(src[way], dst[way], length[way], src[~way], most_rounds, once)

    try:
        return _held(rows, work, ["node", "dist"], f"node {kind}, dist double")
    except PythonException as e:
        raise RuntimeError(str(e)) from e


def connected_components(edges: DataFrame, most_rounds: int = 100, held: int = HELD) -> DataFrame:
    """(node, component): the smallest node of each component of an undirected graph given in both directions. Up to HELD edges are held by
    one task, more go round by round."""
    if edges.count() <= held:
        return _held(edges.select("src", "dst"), _components, ["node", "component"], f"node {dict(edges.dtypes)['src']}, component {dict(edges.dtypes)['src']}")
    labels = stage(edges.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "components")
    for _ in range(most_rounds):
        sent = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        met = labels.join(sent, labels["node"] == sent["src"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        after = stage(met.join(up, "component", "left").select("node", F.least("component", F.coalesce("higher", "component")).alias("component"), "old"), "components")
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components still change")


def shortest_paths(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000, held: int = HELD) -> DataFrame:
    """(node, dist) from the nearest root (node), edge length 1 / (w + 1e-12); only nodes whose distance fell send it on. Up to `held` edges
    are held by one task, more go round by round."""
    if edges.count() <= held:
        return _from(edges, 1 / (F.col("w") + 1e-12), roots, most_rounds, False)
    lengths = stage(edges.select("src", "dst", (1 / (F.col("w") + 1e-12)).alias("len")), "lengths")
    dist, before = stage(roots.select("node", F.lit(0.0).alias("dist"), F.lit(True).alias("open")), "dist"), None
    for _ in range(most_rounds):
        sent = dist.where("open").join(lengths, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("len")).alias("dist"))
        best = sent.groupBy("node").agg(F.min("dist").alias("new"))
        joined = dist.drop("open").join(best, "node", "full")
        last, dist = dist, stage(joined.select("node", F.least(F.coalesce("dist", "new"), F.coalesce("new", "dist")).alias("dist"), F.coalesce(F.col("new") < F.col("dist"), F.col("dist").isNull()).alias("open")), "dist")
        if dist.where("open").isEmpty():
            return dist.select("node", "dist")
        free(before)
        before = last
    raise RuntimeError(f"distances still fall after {most_rounds} rounds")


def pseudotime(nodes: DataFrame, dist: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, pseudotime): 0 for roots, 1 for unreachable nodes, else distances scaled to 0..1 over the others."""
    known = dist.join(roots.select("node"), "node", "left_anti")
    low, high = known.agg(F.min("dist"), F.max("dist")).first()
    width = (high - low) if high is not None and high > low else None
    scaled = (F.col("dist") - (low or 0.0)) / width if width else F.lit(0.0)
    marked = nodes.select("node").join(dist, "node", "left").join(roots.select("node", F.lit(True).alias("root")), "node", "left")
    return marked.select("node", F.when(F.col("root"), 0.0).when(F.col("dist").isNull(), 1.0).otherwise(scaled).alias("pseudotime"))


def markov(edges: DataFrame, time: DataFrame | None = None, slack: float = 1e-3, both: bool = False) -> DataFrame:
    """(src, dst, p): row-normalised weights; with `time` (node, pseudotime), or edges that have src_time and dst_time, only edges that don't go
    back by more than `slack`. Nodes without an edge left stay where they are. both: the edges come in both directions, so each node is a src.

    Edges are shuffled by src once; those that are left out only say that their node is there."""
    ends = edges.select(F.col("dst").alias("src"), F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("to"), F.lit(None).cast("double").alias("w"))
    if time is not None:
        a, b = time.select(F.col("node").alias("src"), F.col("pseudotime").alias("src_time")), time.select(F.col("node").alias("dst"), F.col("pseudotime").alias("dst_time"))
        edges = edges.join(b, "dst", "left").join(a, "src", "left")
    fine = F.col("w") > 0
    if "dst_time" in edges.columns:
        fine = fine & (F.col("dst_time") + slack >= F.col("src_time"))
    rows = edges.select("src", F.when(fine, F.col("dst")).alias("to"), F.when(fine, F.col("w")).alias("w"))
    if not both:
        rows = rows.unionByName(ends)
    node = Window.partitionBy("src").orderBy(F.col("to").asc_nulls_last())
    total = F.sum("w").over(node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = rows.select("src", "to", (F.col("w") / total).alias("p"), F.row_number().over(node).alias("at"))
    stays = F.col("to").isNull()  # as the first row: no edge is left
    return known.where(~stays | (F.col("at") == 1)).select("src", F.coalesce("to", "src").alias("dst"), F.when(stays, 1.0).otherwise(F.col("p")).alias("p"))


def reachable(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000, held: int = HELD) -> DataFrame:
    """(node, steps): nodes that can be reached from the start nodes, with the least number of edges. Up to `held` edges are held by one task,
    more go round by round."""
    if edges.count() <= held:
        return _from(edges, F.lit(1.0), start, most_rounds, True).select("node", F.col("dist").cast("int").alias("steps"))
    seen = stage(start.select("node").distinct().withColumn("steps", F.lit(0)), "reached")
    for step in range(1, most_rounds + 1):
        front = seen.where(F.col("steps") == step - 1)
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = stage(new.withColumn("steps", F.lit(step)), "reached")
        if new.isEmpty():
            return seen
        seen = stage(seen.unionByName(new), "reached")
    raise RuntimeError(f"new nodes are still reached after {most_rounds} rounds")


def first_hits(p: DataFrame, start: DataFrame, targets: DataFrame, tolerance: float = 1e-9, most_rounds: int = 20_000, held: int = HELD) -> DataFrame:
    """(target, via, prob): chance that a walk from `start` (node, mass) enters the target set (node) first at that target, by the node it
    came from. Steps of a chance below LEAST_STEP are not followed; nodes without a way to a target are sinks, and walks that enter them hit
    nothing. A chain of up to `held` edges is solved in one task; in a larger one mass is moved
    step by step with joins. If `tolerance` or more is still on its way after `most_rounds` steps, a RuntimeError says how much."""
    goal = targets.select(F.col("node").alias("dst"), F.lit(True).alias("is_target")).distinct()
    open_steps = p.where(F.col("p") >= LEAST_STEP).join(targets.select(F.col("node").alias("src")), "src", "left_anti").join(goal, "dst", "left")
    steps = stage(open_steps.select("src", "dst", "p", F.coalesce("is_target", F.lit(False)).alias("is_target")), "steps")
    mass = stage(start.join(targets.select("node"), "node", "left_anti").groupBy("node").agg(F.sum("mass").alias("mass")), "mass")
    walk = _walk_held if steps.count() <= held else _walk_joined
    visits, left = walk(steps, mass, tolerance, most_rounds)
    if left >= tolerance:
        raise RuntimeError(f"{left:.3g} of the mass is still on its way after {most_rounds} steps")
    hits = steps.where("is_target").join(visits, F.col("src") == F.col("node"))
    return hits.groupBy(F.col("dst").alias("target"), F.col("src").alias("via")).agg(F.sum(F.col("mass") * F.col("p")).alias("prob"))


def _solve(src: np.ndarray, dst: np.ndarray, chance: np.ndarray, start: np.ndarray, tolerance: float, most_rounds: int) -> tuple[np.ndarray, float]:
    """Expected visits x = start + x Q, directly for small chains, else by stabilised biconjugate gradients, and what is still on its way: the absolute
    sum of start + x Q - x, which bounds the error of all hits together."""
    if len(start) <= min(DENSE, most_rounds):  # elimination counts as a round a node
        matrix = np.eye(len(start))
        np.subtract.at(matrix, (dst, src), chance)
        x = np.linalg.solve(matrix, start)
        for _ in range(3):  # refinement
            rest = start - x + np.bincount(dst, x[src] * chance, len(x))
            x = x + np.linalg.solve(matrix, rest)
        return x, float(np.abs(start - x + np.bincount(dst, x[src] * chance, len(x))).sum())
    x, rounds, left = start.copy(), 0, np.inf
    lack = lambda y: y - np.bincount(dst, y[src] * chance, len(y))
    while True:
        rest = start - lack(x)
        left = float(np.abs(rest).sum())
        if not left >= tolerance or rounds >= most_rounds:
            return x, left if np.isfinite(left) else np.inf
        shadow, way, dot = rest.copy(), rest.copy(), float(rest @ rest)
        while rounds < most_rounds:
            v = lack(way)
            a = dot / float(shadow @ v)
            half = rest - a * v
            t = lack(half)
            w = float(t @ half) / (float(t @ t) or 1.0)
            x, rest, rounds = x + a * way + w * half, half - w * t, rounds + 2
            before, dot = dot, float(shadow @ rest)
            if not np.abs(rest).sum() >= tolerance / 2 or not abs(dot) > 1e-30 * abs(before) or w == 0:
                break  # done, or to be started anew from what is left
            way = rest + dot / before * (a / w) * (way - w * v)


def _visits(edges: pd.DataFrame, first: pd.DataFrame, tolerance: float, most_rounds: int) -> pd.DataFrame:
    """(node, mass, is_left): expected visits before a target is entered, and in one row the mass still on its way."""
    ids, at = np.unique(np.concatenate([edges["src"], edges["dst"]]), return_inverse=True)
    src, dst, chance, goal = at[: len(edges)], at[len(edges) :], edges["p"].to_numpy(), edges["is_target"].to_numpy(bool)
    near = np.zeros(len(ids), bool)  # nodes with a way to a target
    near[src[goal]] = True
    inner, known = ~goal, 0
    while known < (known := int(near.sum())):
        near[src[inner & near[dst]]] = True
    kept = inner & near[src] & near[dst]
    place = np.cumsum(near) - 1
    src, dst, chance = place[src[kept]], place[dst[kept]], chance[kept]
    ids = ids[near]
    place = pd.Index(ids).get_indexer(first["node"])
    now = np.zeros(len(ids))
    now[place[place >= 0]] = first["mass"].to_numpy()[place >= 0]
    visits, left = _solve(src, dst, chance, now, tolerance, most_rounds)
    seen = visits > 0
    left = pd.DataFrame({"node": ids[:1], "mass": [left] * len(ids[:1]), "is_left": True})
    return pd.concat([pd.DataFrame({"node": ids[seen], "mass": visits[seen], "is_left": False}), left])


def _walk_held(steps: DataFrame, mass: DataFrame, tolerance: float, most_rounds: int) -> tuple[DataFrame, float]:
    """Expected visits (node, mass) before a target is entered, and the mass still on its way; the edges are held by one task."""

    def walk(edges: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        return _visits(edges, first, tolerance, most_rounds)

    key = F.lit(0).alias("all")
    found = steps.groupBy(key).cogroup(mass.groupBy(key)).applyInPandas(walk, f"node {dict(steps.dtypes)['src']}, mass double, is_left boolean")
    found = stage(found, "visits")
    return found.where("not is_left").select("node", "mass"), found.where("is_left").agg(F.sum("mass")).first()[0] or 0.0


def _walk_joined(steps: DataFrame, mass: DataFrame, tolerance: float, most_rounds: int) -> tuple[DataFrame, float]:
    """The same by joins."""
    inner = steps.where("not is_target")
    near = new = stage(steps.where("is_target").select(F.col("src").alias("node")).distinct(), "near")
    while not new.isEmpty():
        new = stage(inner.join(new, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct().join(near, "node", "left_anti"), "near")
        near = stage(near.unionByName(new), "near")
    inner = stage(inner.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi"), "inner")
    state = stage(mass.join(near, "node", "left_semi").select("node", "mass", F.col("mass").alias("visits")), "visits")
    for rounds in range(most_rounds + 1):
        left = state.agg(F.sum("mass")).first()[0] or 0.0
        if left < tolerance or rounds == most_rounds:
            return state.select("node", F.col("visits").alias("mass")), left
        moved = state.where("mass > 0").join(inner, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("moved"))
        joined = state.join(moved, "node", "full").withColumn("moved", F.coalesce("moved", F.lit(0.0)))
        state = stage(joined.select("node", F.col("moved").alias("mass"), (F.coalesce("visits", F.lit(0.0)) + F.col("moved")).alias("visits")), "visits")


def first_hits_of(p: DataFrame, starts: DataFrame, targets: DataFrame, tolerance: float = 1e-9, most_rounds: int = 20_000, held: int = HELD) -> DataFrame:
    """(start, target, via, prob): first_hits() of several starts (start, node, mass) into one target set. A chain of up to `held` edges is
    solved for all starts in one task; in a larger one the starts, of which there are few, follow each other."""
    names = [x[0] for x in starts.select("start").distinct().orderBy("start").collect()]
    goal = targets.select(F.col("node").alias("dst"), F.lit(True).alias("is_target")).distinct()
    open_steps = p.where(F.col("p") >= LEAST_STEP).join(targets.select(F.col("node").alias("src")), "src", "left_anti").join(goal, "dst", "left")
    steps = stage(open_steps.select("src", "dst", "p", F.coalesce("is_target", F.lit(False)).alias("is_target")), "steps")
    if not names or steps.count() > held:
        out = None
        for n in names:
            part = first_hits(p, starts.where(F.col("start") == n).select("node", "mass"), targets, tolerance, most_rounds, held).withColumn("start", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else p.select(F.lit(None).cast("string").alias("start"), F.col("dst").alias("target"), F.col("src").alias("via"), F.col("p").alias("prob")).limit(0)
    mass = stage(starts.join(targets.select("node"), "node", "left_anti").groupBy("start", "node").agg(F.sum("mass").alias("mass")), "mass")

    def walk(edges: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        parts = [_visits(edges, one, tolerance, most_rounds).assign(start=name) for name, one in first.groupby("start")]
        return pd.concat(parts)[["start", "node", "mass", "is_left"]] if parts else pd.DataFrame({"start": [], "node": [], "mass": [], "is_left": []})

    key = F.lit(0).alias("all")
    kinds = dict(starts.dtypes)
    found = stage(steps.groupBy(key).cogroup(mass.groupBy(key)).applyInPandas(walk, f"start {kinds['start']}, node {dict(steps.dtypes)['src']}, mass double, is_left boolean"), "visits")
    left = found.where("is_left").agg(F.max("mass")).first()[0] or 0.0
    if left >= tolerance:
        raise RuntimeError(f"{left:.3g} of a start's mass is still on its way after {most_rounds} steps")
    hits = steps.where("is_target").join(found.where("not is_left"), F.col("src") == F.col("node"))
    return hits.groupBy("start", F.col("dst").alias("target"), F.col("src").alias("via")).agg(F.sum(F.col("mass") * F.col("p")).alias("prob"))


def hub_of(breakdown: DataFrame) -> tuple:
    """(start, set, prob) of the largest entry of a breakdown (start, name, prob), ties by start and name; Nones where nothing is hit."""
    row = breakdown.where("prob > 0").orderBy(F.desc("prob"), "start", "name").first()
    return (row["start"], row["name"], row["prob"]) if row else (None, None, 0.0)


def default_routes(start: str, finals: list[str]) -> list[list[str]]:
    """The start followed by each final set, then by each ordered pair of them."""
    return [[start, s] for s in finals] + [[start, a, b] for a in finals for b in finals if a != b]


def root_component(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of the component that holds most of the roots (node), ties by the smallest component."""
    labels = connected_components(edges)
    best = labels.join(roots.select("node").distinct(), "node", "left_semi").groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def k_step_flow(p: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, mass) after k steps of the chain from `start` (node, mass)."""
    mass = start
    for _ in range(k):
        mass = mass.join(p, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
    return mass


def route_probability(p: DataFrame, nodes: DataFrame, category: str, route: list, start: DataFrame) -> list[float]:
    """Chances of the legs of a route of categories: at each leg the walk may enter any category of the route not visited yet, and what
    arrives at the next one goes on, renormalised."""
    out, mass = [], start
    finals = list(route)
    for i, step in enumerate(finals):
        goals = nodes.where(F.col(category).isin(finals[i:])).select("node")
        hits = first_hits(p, mass, goals).groupBy(F.col("target").alias("node")).agg(F.sum("prob").alias("mass"))
        here = stage(hits.join(nodes.where(F.col(category) == step).select("node"), "node", "left_semi"), "leg")
        total = here.agg(F.sum("mass")).first()[0] or 0.0
        out.append(float(total))
        if total == 0:
            break
        mass = here.withColumn("mass", F.col("mass") / total)
    return out
