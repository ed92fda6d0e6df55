"""Communities of a weighted graph by modularity, their stability, sweeps of settings, and intrinsic dimension.

Edges (src, dst, w) come in both directions. Local moves are joins and aggregates over the edges; half of the nodes, chosen by hash, may
move in a round, which keeps neighbours from swapping for ever. Each level's communities become the next level's nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobule.operators import clustering, graph, ranking
from lobule.shared import stage


def local_moves(edges: DataFrame, resolution: float, rounds: int, least_moves: float = 0.002) -> DataFrame:
    """(node, community) after moving nodes to the neighbouring community of largest modularity gain."""
    degrees = stage(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "degrees")
    total, nodes = degrees.agg(F.sum("k"), F.count("*")).first()
    labels = stage(degrees.select("node", "k", F.col("node").alias("community")), "labels")
    for step in range(rounds):
        inside = labels.groupBy("community").agg(F.sum("k").alias("mass"))
        links = edges.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("links"))
        own = labels.select(F.col("node").alias("src"), "k", F.col("community").alias("own"))
        scored = links.join(own, "src").join(inside, "community")
        gain = F.col("links") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)) / total
        best = scored.withColumn("gain", gain).groupBy("src").agg(F.max_by(F.struct("community", "gain"), F.struct("gain", -F.col("community"))).alias("b"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
        alone = labels.join(inside, "community").select(F.col("node").alias("src"), (-resolution * F.col("k") * (F.col("mass") - F.col("k")) / total).alias("none"))
        turn = F.pmod(F.xxhash64("src", F.lit(step)), F.lit(2)) == 0
        moves = best.join(alone, "src").where(turn & (F.col("b.gain") > F.coalesce("stay", "none") + 1e-9 * total)).select(F.col("src").alias("node"), F.col("b.community").alias("to"))
        after = labels.join(moves, "node", "left")
        labels = stage(after.select("node", "k", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")), "labels")
        moved = labels.where("moved").count()
        labels = labels.drop("moved")
        if moved <= least_moves * nodes and step:
            break
    return labels.select("node", "community")


def _levels_held(src: np.ndarray, dst: np.ndarray, w: np.ndarray, turns: np.ndarray, resolution: float, rounds: int, levels: int, least_moves: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """modularity_communities() of edges held in memory; bit `step` of turns, given with each edge's src, says whether the node may move then."""
    ids, first, a = np.unique(src, return_index=True, return_inverse=True)
    turns, b, n = turns[first], np.searchsorted(ids, dst), len(ids)
    names, label = np.arange(n), np.arange(n)  # of a level's nodes; of the graph's
    for _ in range(levels):
        k = np.bincount(a, w, n)
        total, own = k.sum(), np.arange(n)
        other = a != b
        ea, eb, ew = a[other], b[other], w[other]
        for step in range(rounds):
            mass = np.bincount(own, k, n)
            key = ea * n + own[eb]
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.array([], int)
            links = np.add.reduceat(ew[order], start) if len(start) else np.array([])
            node, to = key[order][start] // n, key[order][start] % n
            gain = links - resolution * k[node] * (mass[to] - np.where(to == own[node], k[node], 0)) / total
            stay = -resolution * k * (mass[own] - k) / total
            here = to == own[node]
            stay[node[here]] = gain[here]
            sort = np.lexsort((names[to], -gain, node))
            best = sort[np.flatnonzero(np.r_[True, np.diff(node[sort]) != 0])] if len(sort) else sort
            may = (turns[names[node[best]]] >> step) & 1 == 1
            move = best[may & (gain[best] > stay[node[best]] + 1e-9 * total)]
            own[node[move]] = to[move]
            if len(move) <= least_moves * n and step:
                break
        kept, place = np.unique(own, return_inverse=True)
        label = place[label]
        alone = (own == np.arange(n)).all()
        names = names[kept]
        key, at = np.unique(place[a] * len(kept) + place[b], return_inverse=True)
        w, a, b, n = np.bincount(at, w, len(key)), key // len(kept), key % len(kept), len(kept)
        if alone:
            break
    return ids, ids[names[label]]


def modularity_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 3, held: int = graph.HELD) -> DataFrame:
    """(node, community), communities named by one of their nodes. Nodes without edges are not in it. An empty graph gives none. Up to `held`
    edges are held by one task, more go round by round; both do the same moves."""
    if rounds < 63 and edges.count() <= held:
        turns = [F.shiftleft(F.when(F.pmod(F.xxhash64("src", F.lit(step)), F.lit(2)) == 0, 1).otherwise(0).cast("long"), step) for step in range(rounds)]
        rows = edges.select("src", "dst", "w", sum(turns[1:], turns[0]).alias("turns"))
        kind = dict(edges.dtypes)["src"]
        return graph._held(rows, lambda *c: _levels_held(*c, resolution, rounds, levels), ["node", "community"], f"node {kind}, community {kind}")
    current, labels = edges.select("src", "dst", "w"), None
    for _ in range(levels):
        found = local_moves(current, resolution, rounds)
        if labels is None:
            labels = found
        else:
            labels = stage(labels.join(found.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "communities")
        if found.where("node <> community").isEmpty():
            break
        a, b = found.select(F.col("node").alias("src"), F.col("community").alias("a")), found.select(F.col("node").alias("dst"), F.col("community").alias("b"))
        current = stage(current.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "contracted")
    return labels


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (node, community)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("a")), labels.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    joined = edges.join(a, "src").join(b, "dst")
    inner, total = joined.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    masses = joined.groupBy("a").agg(F.sum("w").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0]
    return float(inner / total - resolution * masses / total**2) if total else 0.0


def stability(df: DataFrame, key: str, cluster: Callable[[DataFrame], DataFrame], runs: int, share: float = 0.8) -> list[float]:
    """Adjusted Rand indices of all pairs of runs; `cluster` maps rows to (key, label), each run sees its own hashed share of the rows."""
    found = [stage(cluster(ranking.fraction_sample(df, key, share, seed)).select(key, F.col("label").alias(f"l{seed}")), "run") for seed in range(runs)]
    return [float(clustering.adjusted_rand(found[i].join(found[j], key), f"l{i}", f"l{j}").first()["ari"]) for i, j in combinations(range(runs), 2)]


def summary(values: list[float]) -> dict[str, float]:
    """mean, std (ddof 0), q10 and q90; zeros where there is nothing."""
    v = np.array(values or [0.0])
    return {"mean": float(v.mean()), "std": float(v.std()), "q10": float(np.quantile(v, 0.1)), "q90": float(np.quantile(v, 0.9))}


def penalised(mean: float, std: float, k: int, weight: float = 1.0) -> float:
    """Stability less its spread, within 0..1; a single cluster scores 0."""
    return 0.0 if k < 2 else float(np.clip(mean - weight * std, 0, 1))


def granularity(effective: Column, k: Column, least_share: Column) -> Column:
    """Mean of how many of the clusters are effective, and whether the smallest holds a hundredth."""
    return (F.least(F.lit(1.0), effective / k) + F.least(F.lit(1.0), least_share / 0.01)) / 2


def intrinsic_dimension(near: DataFrame) -> DataFrame:
    """One row (n, dimension): maximum-likelihood dimension of neighbours (src, place, d), averaged over rows with positive distances."""
    last = near.where("d > 0").withColumn("top", F.max("d").over(Window.partitionBy("src")))
    each = last.where("d < top").groupBy("src").agg(F.avg(F.ln(F.col("top") / F.col("d"))).alias("m")).where("m > 0")
    return each.agg(F.count("*").alias("n"), F.avg(1 / F.col("m")).alias("dimension"))
