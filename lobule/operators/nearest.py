"""The exact k nearest rows of every row by cells: no pair of rows is left out that could be among them.

Rows are turned to their principal axes, which keeps distances, and cut into cells by a tree of medians fitted on a sample (it decides how
rows are grouped, never which are found). Each cell is searched for its own rows, which gives every row a bound; with it the row is sent
only to those other cells whose box, taken over all their rows, reaches within the bound. Inside a cell small leaves with boxes do the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobule.shared import free, pack, stage, unpack

CELL = 65_536  # rows of a cell, about: the larger, the fewer rows ask other cells; cells of twice as many are cut by hash
LEAF = 256  # rows of a leaf inside a cell
FIRST = 2048  # rows, about, that give a group of asking rows its first bounds
WIDE = 16  # leaves searched at once; a row is tested against the box around them
LARGEST, TINY = 1e30, 1e-30  # squares below and above which single precision is used, and what it may lose to underflow
SAMPLE = 65_536  # rows, about, that the tree is fitted on; more if there are many cells
ASKS = 131_072  # rows that are sent to one copy of a cell, about
PAIRS = 1_000_000  # pairs held before only the k best of each row are kept
SLACK = 1e-12  # of the squared norms: far more than what turning and products round


def halves(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where its pieces of at most `size` rows begin; each cut is the median of the widest axis."""
    todo, order, starts, at = [np.arange(len(y))], [], [], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            order.append(rows)
            starts.append(at)
            at += len(rows)
            continue
        low, high = np.quantile(y[rows[:: -(-len(rows) // 256)]], [0.1, 0.9], axis=0)
        half = len(rows) // 2
        parted = rows[np.argpartition(y[rows, (high - low).argmax()], half)]
        todo += [parted[half:], parted[:half]]
    return np.concatenate(order), np.array(starts)


def fit_tree(sample: np.ndarray, cells: int) -> dict[str, np.ndarray]:
    """middle and turn: the rotation to principal axes of the sample's rows without far outliers; axis and cut of the inner nodes of a complete tree."""
    low, middle, high = np.quantile(sample, [0.25, 0.5, 0.75], axis=0)
    wide = 5 * (high - low)
    usual = sample[((sample >= low - wide) & (sample <= high + wide)).all(1)]
    usual = usual if len(usual) > sample.shape[1] else sample
    turn = np.linalg.eigh(np.atleast_2d(np.cov(usual.T)))[1][:, ::-1] if len(usual) > 1 else np.eye(sample.shape[1])
    y, inner = (sample - middle) @ turn, max(0, 2 ** int(np.ceil(np.log2(max(1, cells)))) - 1)
    axis, cut, held = np.zeros(inner, np.int64), np.zeros(inner), {0: np.arange(len(y))}
    for node in range(inner):
        rows = held.pop(node)
        if len(rows):
            low, high = np.quantile(y[rows], [0.1, 0.9], axis=0)
            axis[node] = (high - low).argmax()
            cut[node] = np.median(y[rows, axis[node]])
        right = y[rows, axis[node]] > cut[node]
        held |= {2 * node + 1: rows[~right], 2 * node + 2: rows[right]}
    return {"middle": middle, "turn": turn, "axis": axis, "cut": cut}


def leaf_of(y: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The cell of each turned row."""
    node, rows = np.zeros(len(y), np.int64), np.arange(len(y))
    for _ in range(len(tree["axis"]).bit_length()):
        node = 2 * node + 1 + (y[rows, tree["axis"][node]] > tree["cut"][node])
    return node - len(tree["axis"])


def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the k pairs of least (d, id)."""
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.array([], int)
    fine = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[fine], j[fine], d[fine]


def gaps(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to a box."""
    return (np.maximum(0, np.maximum(low - z, z - high)) ** 2).sum(1)


def reached(z: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Of each row, a matrix row: the boxes within its squared limit. Rows are tested singly, as one that lies apart would open all boxes to the others."""
    return (np.maximum(0, np.maximum(low - z[:, None], z[:, None] - high)) ** 2).sum(2) <= limit[:, None]


def search(asked: np.ndarray, own: np.ndarray, bound: np.ndarray | None, held: np.ndarray, ids: np.ndarray, k: int, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, id, distance): the k nearest held rows, other than the row itself, within the bound; ties by id. Products in single
    precision, with a margin for what they round, only sort out pairs; the distances of the others are summed column by column in the given
    order, as SQL does."""
    q, y = (asked - tree["middle"]) @ tree["turn"], (held - tree["middle"]) @ tree["turn"]
    order, starts = halves(y, LEAF)
    held, y, ids = np.ascontiguousarray(held[order].T), y[order], ids[order]
    ends = np.r_[starts[1:], len(y)]
    wide, wide_ends = starts[::WIDE], np.r_[starts[::WIDE][1:], len(y)]
    low, high = np.minimum.reduceat(y, wide), np.maximum.reduceat(y, wide)
    middles = np.array([np.median(y[a:b], 0) for a, b in zip(starts, ends)]) if bound is None else None
    zz, yy = (q * q).sum(1), (y * y).sum(1)
    kind, margin = (np.float32, 1e-5) if max(zz.max(initial=0), yy.max()) < LARGEST else (np.float64, 1e-12)
    left, right = np.column_stack([-2 * q, np.ones(len(q))]).astype(kind), np.column_stack([y, yy * (1 - margin)]).astype(kind)
    slack = SLACK * (zz + yy.max())
    groups, begin = halves(q, LEAF)
    out = []
    for a, b in zip(begin, np.r_[begin[1:], len(q)]):
        g = groups[a:b]
        z, mine = q[g], own[g]
        if bound is None:
            near = np.argsort(((middles - np.median(z, 0)) ** 2).sum(1), kind="stable")  # boxes may be stretched by outliers, middles aren't
            upto = int(np.searchsorted(np.cumsum(ends[near] - starts[near]), max(FIRST, 2 * k + 2))) + 1
            first = np.concatenate([np.arange(starts[x], ends[x]) for x in near[:upto]])
            square = left[g] @ right[first].T + (2 * margin * yy[first]).astype(kind)
            square[mine[:, None] == ids[first]] = np.inf
            limit = np.partition(square, k - 1, 1)[:, k - 1].astype(float) + (1 + margin) * zz[g] + 2 * slack[g] if len(first) >= k else np.full(len(g), np.inf)
        else:
            limit = bound[g] ** 2 * (1 + 1e-12) + slack[g]
        limit = limit + slack[g]
        least = np.nextafter((limit - (1 - margin) * zz[g]).astype(kind), kind(np.inf)) + kind(TINY)
        found, pending = [], 0
        reach = reached(z, low, high, limit)
        for c in np.flatnonzero(reach.any(0)):
            part = np.flatnonzero(reach[:, c])
            i, j = np.divmod(np.flatnonzero(left[g[part]] @ right[wide[c] : wide_ends[c]].T <= least[part, None]), wide_ends[c] - wide[c])
            i, j = part[i], wide[c] + j
            other = mine[i] != ids[j]
            i, j = i[other], j[other]
            d, x = np.zeros(len(i)), asked[g].T
            for c_ in range(len(held)):
                d += (np.take(x[c_], i) - np.take(held[c_], j)) ** 2
            found.append((i, j, np.sqrt(d)))
            pending += len(i)
            if pending > PAIRS:
                found = [best(*(np.concatenate(p) for p in zip(*found)), ids, k)]
                pending = len(found[0][0])
        if found:
            i, j, d = best(*(np.concatenate(p) for p in zip(*found)), ids, k)
            if bound is not None:
                fine = d <= bound[g[i]]
                i, j, d = i[fine], j[fine], d[fine]
            out.append((g[i], ids[j], d))
    if not out:
        return np.array([], int), np.array([], np.int64), np.array([])
    return tuple(np.concatenate(p) for p in zip(*out))


def asks(x: np.ndarray, bound: np.ndarray, own: int, cells: np.ndarray, low: np.ndarray, high: np.ndarray, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the other cells whose boxes reach within the row's bound."""
    q, rows, to = (x - tree["middle"]) @ tree["turn"], [], []
    groups, begin = halves(q, LEAF)
    far = np.maximum((low * low).sum(1), (high * high).sum(1))
    for a, b in zip(begin, np.r_[begin[1:], len(q)]):
        g = groups[a:b]
        z = q[g]
        limit = bound[g] ** 2 * (1 + 1e-12) + SLACK * (z * z).sum(1)
        apart = (np.maximum(0, np.maximum(low - z.max(0), z.min(0) - high)) ** 2).sum(1)
        for c in np.flatnonzero((apart <= limit.max() + SLACK * far) & (cells != own)):
            hit = g[gaps(z, low[c], high[c]) <= limit + SLACK * far[c]]
            rows.append(hit)
            to.append(np.full(len(hit), cells[c]))
    return (np.concatenate(rows), np.concatenate(to)) if rows else (np.array([], int), np.array([], np.int64))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An array<double> column without nulls as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [np.array([])]).reshape(-1, width)


def of(values: np.ndarray, place: Column | str) -> Column:
    """The long of the array at a place counted from 0."""
    return F.element_at(F.lit(values.astype(np.int64)), (F.col(place) if isinstance(place, str) else place).cast("int") + 1)


def spread(spark: SparkSession, tasks: int) -> np.ndarray:
    """For each of `tasks` partitions a long that repartition() sends there, so that no two groups meet in one task; should one not be found
    among the first 32 for each, an unused number, whose group shares a task."""
    where = spark.range(32 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("at")).agg(F.min("id").alias("id")).toArrow()
    out = -1 - np.arange(tasks)
    out[where.column("at").to_numpy()] = where.column("id").to_numpy()
    return out


def nearest(rows: DataFrame, width: int, k: int, cell: int | None = None, spent: DataFrame | None = None) -> DataFrame:
    """(src, dst, place, d), staged, of rows (id, x: array of `width` finite doubles): the k nearest other rows of each, ties by id. spent: a
    stage table behind the rows that nothing else reads; it is freed as soon as the search doesn't need it."""
    cell = cell or CELL
    spark, extra, kept = rows.sparkSession, None, None
    if not rows.groupBy(F.xxhash64("x")).count().where(F.col("count") > k + 1).isEmpty():
        # of equal rows the k + 1 of least id suffice: the nearest rows of all others are the first k of these
        ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("x").orderBy("id")))
        kept = stage(ranked.where(F.col("copy") <= k + 1), "kept")
        full = kept.where(F.col("copy") == k + 1).select("x")
        heads = kept.where(F.col("copy") <= k).join(full, "x").select("x", F.col("id").alias("dst"))
        rest = rows.join(kept.select("id"), "id", "left_anti")
        extra = rest.join(heads, "x").select(F.col("id").alias("src"), "dst", F.lit(0.0).alias("d"))
        rows = kept.select("id", "x")
    n = rows.count()
    wanted = max(1, -(-n // cell))
    share = max(1, n // max(SAMPLE, 16 * wanted))
    taken = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(share)) == 0).select("x").toArrow() if n else None
    if not n or not taken.num_rows:
        taken = rows.select("x").limit(1024).toArrow()
    tree = fit_tree(matrix(taken.column("x"), width), wanted) if taken.num_rows else fit_tree(np.zeros((1, width)), 1)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            at = leaf_of((x - sent.value["middle"]) @ sent.value["turn"], sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("id"), pack(x)], ["cell", "id", "x"])

    whole = placed = stage(rows.mapInArrow(place, "cell long, id long, x binary"), "placed")
    if extra is None:  # copies of equal rows are read from the rows at the end
        free(spent)
    big = {r["cell"]: -(-r["count"] // cell) for r in placed.groupBy("cell").count().where(F.col("count") > 2 * cell).collect()}
    parts = np.array([big.get(c, 1) for c in range(len(tree["axis"]) + 1)])
    if big:
        part = F.pmod(F.xxhash64("id", F.lit(12)), of(parts, "cell"))
        placed = placed.withColumn("cell", of(np.cumsum(parts) - parts, "cell") + part)

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            y, at = (unpack(b.column("x"), width) - sent.value["middle"]) @ sent.value["turn"], b.column("cell").to_numpy()
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            for c, lo, hi in zip(names.tolist(), np.minimum.reduceat(y[order], first), np.maximum.reduceat(y[order], first)) if len(at) else ():
                low[c], high[c] = np.minimum(low.get(c, lo), lo), np.maximum(high.get(c, hi), hi)
        sides = np.array([*low.values()]).reshape(-1, width), np.array([*high.values()]).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), *[pa.array(s[:, c]) for s in sides for c in range(width)]], ["cell", *[f"{s}{c}" for s in "lh" for c in range(width)]])

    sides = [f"{s}{c}" for s in "lh" for c in range(width)]
    boxes = placed.mapInArrow(box, "cell long, " + ", ".join(f"{s} double" for s in sides)).groupBy("cell").agg(*[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides]).toArrow()
    corners = np.column_stack([boxes.column(s).to_numpy() for s in sides]) if boxes.num_rows else np.zeros((0, 2 * width))
    known = spark.sparkContext.broadcast((boxes.column("cell").to_numpy(), corners[:, :width], corners[:, width:]))

    def inside(key: tuple, held: pa.Table) -> pa.Table:
        x, ids = unpack(held.column("x"), width), held.column("id").to_numpy()
        i, found, d = search(x, ids, None, x, ids, k, sent.value)
        order = np.lexsort((found, d, i))
        i, found, d = i[order], found[order], d[order]
        count = np.bincount(i, minlength=len(x))
        ends = np.cumsum(count)
        bound = np.where(count == k, d[np.maximum(ends - 1, 0)], np.inf) if len(d) else np.full(len(x), np.inf)
        row, to = asks(x, bound, held.column("cell")[0].as_py(), *known.value, sent.value)
        order = np.argsort(row, kind="stable")
        offsets = lambda c: pa.array(np.r_[0, np.cumsum(c)].astype(np.int32))
        asking = np.bincount(row, minlength=len(x))
        lists = [pa.ListArray.from_arrays(offsets(count), pa.array(v)) for v in (found, d)] + [pa.ListArray.from_arrays(offsets(asking), pa.array(to[order]))]
        sent_on = pack(x[asking > 0]).take(pa.array(np.cumsum(asking > 0) - 1, mask=asking == 0))  # the vectors of the others aren't needed any more
        return pa.Table.from_arrays([pa.array(ids), sent_on, pa.array(bound), *lists], ["id", "x", "bound", "dst", "d", "to"])

    own = stage(placed.withColumn("at", of(spread(spark, int(parts.sum())), "cell")).repartition(int(parts.sum()), "at").groupBy("at").applyInArrow(inside, "id long, x binary, bound double, dst array<long>, d array<double>, to array<long>"), "own")
    alone = F.size("to") == 0  # rows that ask no other cell: their lists are final, and in order
    final = own.where(alone).select(F.col("id").alias("src"), F.posexplode(F.arrays_zip("dst", "d")).alias("at", "n")).select("src", "n.dst", (F.col("at") + 1).alias("place"), "n.d")
    found = own.where(~alone).select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "d")).alias("n")).select("src", "n.dst", "n.d")
    crossing = own.select(F.explode("to").alias("cell"), "id", "x", "bound")
    asked = {r["cell"]: -(-r["count"] // ASKS) for r in crossing.groupBy("cell").count().collect()}
    if asked:
        copies = np.array([asked.get(c, 0) for c in range(int(parts.sum()))])
        tasks = int(copies.sum())
        at = lambda part: of(spread(spark, tasks), of(np.cumsum(copies) - copies, "cell") + part).alias("at")
        crossing = crossing.select(at(F.pmod(F.xxhash64("id", F.lit(13)), of(copies, "cell"))), "id", "x", "bound")
        held = placed.where(of(copies, "cell") > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), of(copies, "cell") - 1))).select(at(F.col("part")), "id", "x")

        def across(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["src", "dst", "d"]
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
            ids = left.column("id").to_numpy()
            i, dst, d = search(unpack(left.column("x"), width), ids, left.column("bound").to_numpy(), unpack(right.column("x"), width), right.column("id").to_numpy(), k, sent.value)
            return pa.Table.from_arrays([pa.array(ids[i]), pa.array(dst), pa.array(d)], names)

        left, right = (t.repartition(tasks, "at").groupBy("at") for t in (crossing, held))
        found = found.unionByName(left.cogroup(right).applyInArrow(across, "src long, dst long, d double"))
    if extra is not None:
        found = found.unionByName(extra)
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("place") <= k)
    out = stage(ranked.select("src", "dst", "place", "d").unionByName(final), "knn")
    for table in (kept, whole, own, spent):
        free(table)
    return out
