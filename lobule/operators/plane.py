"""Mean silhouettes of many labelings of points in the plane, all rows against all rows, without meeting each pair of rows.

Points are put into cells of a tree of halved boxes. Rows of near cells meet one by one. Distances between cells that lie apart by at least the
longest side of either are interpolated at P Chebyshev nodes an axis on both sides, which is exact to about 1e-9 of the distance; sums over the
points of a cell, for every cluster of every labeling, become sums at its nodes. The work is about in proportion to the rows up to CELLS * ROWS.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobule.operators.nearest import SAMPLE, of, spread
from lobule.shared import free, stage

P = 12  # nodes an axis
ROWS, CELLS = 512, 512  # rows that a cell aims at; cells at most, whose sums the driver holds
AT_ONCE = 2**18  # distances held at once
_NODES = np.cos(np.pi * (np.arange(P) + 0.5) / P)
_T = np.cos(np.outer(np.arange(P), np.arccos(_NODES)))


def basis(y: np.ndarray, middle: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The weight of each node of a box for each row inside."""
    sides = []
    for a in range(2):
        t = np.cos(np.arccos(np.clip((y[:, a] - middle[a]) / half[a], -1, 1))[:, None] * np.arange(P))
        t[:, 1:] *= 2
        sides.append(t @ _T / P)
    return (sides[0][:, :, None] * sides[1][:, None, :]).reshape(len(y), P * P)


def nodes(middle: np.ndarray, half: np.ndarray) -> np.ndarray:
    x, y = np.meshgrid(middle[0] + half[0] * _NODES, middle[1] + half[1] * _NODES, indexing="ij")
    return np.column_stack([x.ravel(), y.ravel()])


def box(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half sides, no side without a width."""
    middle, half = (low + high) / 2, (high - low) / 2
    return middle, np.maximum(half * (1 + 1e-12), max(1e-3 * half.max(), 1e-9 * np.abs(middle).max(), 1e-300))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt((x[:, :1] - y[:, 0]) ** 2 + (x[:, 1:] - y[:, 1]) ** 2)


def hot(code: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each code (labels of all labelings as digits of a number) ones in the columns of its clusters."""
    out, at = np.zeros((len(code), sum(sizes))), 0
    for k in sizes:
        out[np.arange(len(code)), at + code % k] = 1
        code, at = code // k, at + k
    return out


def fit_tree(sample: np.ndarray, rows: float) -> dict[str, np.ndarray]:
    """Boxes halved across their longest side, the fullest first, until none has more than `rows` rows of the sample or there are CELLS. Of each node:
    axis and cut, left and right child (-1: none), and the number of the cell it is (-1: none)."""
    tree: dict[str, list] = {"axis": [0], "cut": [0.0], "left": [-1], "right": [-1]}
    todo = [(-len(sample), 0, sample)]
    while len(todo) < CELLS and -todo[0][0] > rows:
        _, i, y = heapq.heappop(todo)
        low, high = y.min(0), y.max(0)
        axis = int((high - low).argmax())
        right = y[:, axis] > (low[axis] + high[axis]) / 2
        if not right.any() or right.all():  # equal rows
            heapq.heappush(todo, (0, i, y))
            continue
        tree["axis"][i], tree["cut"][i] = axis, (low[axis] + high[axis]) / 2
        for side, part in (("left", y[~right]), ("right", y[right])):
            tree[side][i] = len(tree["axis"])
            heapq.heappush(todo, (-len(part), len(tree["axis"]), part))
            for name, value in (("axis", 0), ("cut", 0.0), ("left", -1), ("right", -1)):
                tree[name].append(value)
    out = {k: np.array(v) for k, v in tree.items()}
    end = out["left"] < 0
    return out | {"cell": np.where(end, np.cumsum(end) - 1, -1)}


def cell_of(y: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    node, open_ = np.zeros(len(y), np.int64), np.arange(len(y))
    while len(open_ := open_[tree["left"][node[open_]] >= 0]):
        at = node[open_]
        node[open_] = np.where(y[open_, tree["axis"][at]] > tree["cut"][at], tree["right"][at], tree["left"][at])
    return tree["cell"][node]


def fields(tree: dict[str, np.ndarray], boxes: dict[int, tuple[np.ndarray, np.ndarray]], held: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, list[int]]]:
    """For each cell the sums of distances to all points of far cells, at its nodes, and the list of its near cells, itself among them."""
    at, sums, ends, young = {}, {}, {}, {}
    for i in range(len(tree["cell"]) - 1, -1, -1):  # children have larger numbers
        if (c := int(tree["cell"][i])) >= 0:
            young[i] = []
            if c in boxes:
                at[i], sums[i], ends[i] = box(*boxes[c]), held[c], boxes[c]
            continue
        young[i] = [j for j in (int(tree["left"][i]), int(tree["right"][i])) if j in at]
        if young[i]:
            # the nodes of a cell without width lie outside its points' box
            low, high = ([f(ends[j][s], at[j][0] + sign * at[j][1]) for j in young[i]] for s, (f, sign) in enumerate(((np.minimum, -1), (np.maximum, 1))))
            ends[i] = np.min(low, axis=0), np.max(high, axis=0)
            at[i] = box(*ends[i])
            sums[i] = sum(basis(nodes(*at[j]), *at[i]).T @ sums[j] for j in young[i])
    points, wide = {i: nodes(*at[i]) for i in at}, {i: 2 * at[i][1].max() for i in at}
    far: dict[int, list[int]] = {i: [] for i in at}
    near: dict[int, list[int]] = {c: [] for c in boxes}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        gap = np.maximum(0, np.abs(at[i][0] - at[j][0]) - at[i][1] - at[j][1])
        if (gap * gap).sum() >= max(wide[i], wide[j]) ** 2:
            far[i].append(j)
        elif young[j] and (wide[j] >= wide[i] or not young[i]):
            todo += [(i, y) for y in young[j]]
        elif young[i]:
            todo += [(y, j) for y in young[i]]
        else:
            near[int(tree["cell"][i])].append(int(tree["cell"][j]))
    local = {0: np.zeros_like(sums[0])}
    for i in sorted(at):
        for a in range(0, len(far[i]), 16):
            part = far[i][a : a + 16]
            local[i] += apart(points[i], np.concatenate([points[j] for j in part])) @ np.concatenate([sums[j] for j in part])
        for j in young[i]:
            local[j] = basis(points[j], *at[i]) @ local[i]
    return {int(tree["cell"][i]): local[i] for i in at if tree["cell"][i] >= 0}, near


def scores(total: np.ndarray, code: np.ndarray, counts: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each labeling the sum of the rows' silhouettes, from their sums of distances to each cluster; 0 where it is not defined."""
    out, at, rows = [], 0, np.arange(len(code))
    for k in sizes:
        own, m, t = code % k, counts[at : at + k], total[:, at : at + k]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = t[rows, own] / (m[own] - 1)
            other = np.where(m > 0, t / m, np.inf)
            other[rows, own] = np.inf
            b = other.min(1)
            s = (b - a) / np.maximum(a, b)
        out.append(s[np.isfinite(s)].sum())
        code, at = code // k, at + k
    return np.array(out)


def silhouettes(rows: DataFrame, sizes: list[int]) -> tuple[int, list[float]]:
    """Number of rows (x, y: finite doubles, code: long) and the mean silhouette of each labeling. The labels of a row, from 0 to size - 1, are the
    digits of its code, of the first labeling the lowest."""
    spark = rows.sparkSession
    rows = rows.select("x", "y", "code")
    n = rows.count()
    if not n or not sizes:
        return n, [math.nan] * len(sizes)
    share = max(1, n // SAMPLE)
    taken = rows.where(F.pmod(F.xxhash64("x", "y", "code"), F.lit(share)) == 0).select("x", "y").limit(2 * SAMPLE).toPandas().to_numpy()
    taken = taken if len(taken) else rows.select("x", "y").limit(1024).toPandas().to_numpy()
    tree = fit_tree(taken, ROWS * len(taken) / n)
    leaves, columns = int(tree["cell"].max()) + 1, sum(sizes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = cell_of(np.column_stack([b.column(c).to_numpy() for c in ("x", "y")]), tree)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("x"), b.column("y"), b.column("code")], ["cell", "x", "y", "code"])

    placed = stage(rows.mapInArrow(place, "cell long, x double, y double, code long"), "placed")

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        y = np.column_stack([t.column(c).to_numpy() for c in ("x", "y")])
        low, high = y.min(0), y.max(0)
        found, counts = np.zeros((P * P, columns)), np.zeros(columns)
        for a in range(0, len(y), 4096):
            marks = hot(t.column("code").to_numpy()[a : a + 4096], sizes)
            found += basis(y[a : a + 4096], *box(low, high)).T @ marks
            counts += marks.sum(0)
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()]), "ends": pa.array([[*low, *high]]), "sums": pa.array([found.tobytes()], pa.binary()), "counts": pa.array([counts.tolist()])})

    lone = lambda t, c: t.withColumn("at", of(spread(spark, leaves), c)).repartition(leaves, "at").groupBy("at")
    got = lone(placed, "cell").applyInArrow(gather, "cell long, ends array<double>, sums binary, counts array<double>").toArrow().to_pylist()  # one row for each cell
    ends = {r["cell"]: (np.array(r["ends"][:2]), np.array(r["ends"][2:])) for r in got}
    counts = np.sum([r["counts"] for r in got], axis=0)
    local, near = fields(tree, ends, {r["cell"]: np.frombuffer(r["sums"]).reshape(P * P, columns) for r in got})
    del got
    sent = spark.sparkContext.broadcast((ends, local))
    asking = spark.createDataFrame([(c, t) for t in near for c in near[t]], "cell long, target long")

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        target = t.column("target")[0].as_py()
        y, code = np.column_stack([t.column(c).to_numpy() for c in ("x", "y")]), t.column("code").to_numpy()
        own = np.flatnonzero(t.column("cell").to_numpy() == target)
        order = np.argsort(code, kind="stable")
        kinds, starts = np.unique(code[order], return_index=True)
        other, marks, out = np.ascontiguousarray(y[order]), hot(kinds, sizes), np.zeros(len(sizes))
        boxes, far = sent.value
        step = max(1, AT_ONCE // len(y))
        for a in range(0, len(own), step):
            x = y[own[a : a + step]]
            total = np.add.reduceat(apart(x, other), starts, axis=1) @ marks + basis(x, *box(*boxes[target])) @ far[target]
            out += scores(total, code[own[a : a + step]], counts, sizes)
        return pa.table({"s": pa.array([out.tolist()], pa.list_(pa.float64()))})

    parts = lone(placed.join(F.broadcast(asking), "cell"), "target").applyInArrow(meet, "s array<double>").toArrow().column("s").to_pylist()
    sent.destroy()
    free(placed)
    return n, (np.sum(parts, axis=0) / n).tolist()
