import numpy as np
from pyspark.sql import functions as F

from lobule.operators import graph, nearest


def brute(ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    out = []
    for i in range(len(ids)):
        d = np.zeros(len(ids))
        for c in range(x.shape[1]):
            d += (x[i, c] - x[:, c]) ** 2
        d = np.sqrt(d)
        d[i] = np.inf
        out += [(int(ids[i]), int(ids[j]), place + 1, float(d[j])) for place, j in enumerate(np.lexsort((ids, d))[: min(k, len(ids) - 1)])]
    return out


def test_knn_over_many_cells_is_exact_with_ties_copies_and_outliers(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 64)
    monkeypatch.setattr(nearest, "LEAF", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(500, 3)), rng.integers(0, 5, (300, 3)), np.full((30, 3), 2.0), rng.normal(size=(20, 3)) * [1, 1, 9999]]).astype(float)
    ids = rng.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)] + [(9998, 1.0, None, 1.0), (9999, 1.0, float("nan"), 1.0)], "id long, a double, b double, c double")
    got = sorted(map(tuple, graph.knn(df, "id", ["a", "b", "c"], 5).select("src", "dst", "place", "d").collect()))
    assert got == sorted(brute(ids, x, 5))


def test_equal_rows_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 8)
    same = spark.range(100).select("id", F.lit(1.5).alias("a"))
    got = graph.knn(same, "id", ["a"], 2).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("n")).collect()
    assert len(got) == 100 and all(r["n"] == [i for i in range(3) if i != r["src"]][:2] for r in got)
    assert sorted(map(tuple, graph.knn(same.limit(2), "id", ["a"], 5).select("src", "dst").collect())) == [(0, 1), (1, 0)]
    assert graph.knn(same.limit(0), "id", ["a"], 5).isEmpty()


def test_rows_ask_few_other_cells():
    # before, every block of rows met every other block
    x = np.random.default_rng(5).normal(size=(20_000, 3))
    tree = nearest.fit_tree(x, 64)
    y = (x - tree["middle"]) @ tree["turn"]
    at = nearest.leaf_of(y, tree)
    cells = np.unique(at)
    low, high = (np.array([f(y[at == c], 0) for c in cells]) for f in (np.min, np.max))
    one = at == cells[7]
    ids = np.flatnonzero(one)
    i, _, d = nearest.search(x[one], ids, None, x[one], ids, 5, tree)
    bound = np.zeros(len(ids))
    np.maximum.at(bound, i, d)
    rows, _ = nearest.asks(x[one], bound, cells[7], cells, low, high, tree)
    assert len(cells) == 64 and len(rows) < 6 * len(ids)


def test_every_group_has_a_task_of_its_own(spark):
    from lobule.operators.nearest import of, spread

    for n in (1, 16, 25):
        rows = spark.range(40 * n).select((F.col("id") % n).alias("cell")).withColumn("at", of(spread(spark, n), "cell"))
        tasks = rows.repartition(n, "at").select("cell", F.spark_partition_id().alias("task")).distinct().collect()
        assert len(tasks) == n == len({r["task"] for r in tasks}) == len({r["cell"] for r in tasks})


def test_single_precision_loses_no_pair():
    from lobule.operators.nearest import fit_tree, search

    rng = np.random.default_rng(5)
    for scale, away in ((1.0, 0.0), (1.0, 1e4), (1e-20, 0.0), (1e18, 0.0), (1.0, 1e20)):
        x = rng.normal(size=(3000, 6)) * scale
        x[:5] += away
        tree, ids = fit_tree(x, 1), np.arange(len(x)) * 7
        d = np.zeros((len(x), len(x)))
        for c in range(6):
            d += (x[:, c : c + 1] - x[:, c]) ** 2
        d = np.sqrt(d)
        np.fill_diagonal(d, np.inf)
        for bound in (None, np.partition(d, 4, 1)[:, 4]):
            i, found, got = search(x, ids, bound, x, ids, 5, tree)
            order = np.lexsort((found, got, i))
            near = np.argsort(d, 1, kind="stable")[:, :5]
            assert (found[order].reshape(-1, 5) == ids[near]).all() and (got[order].reshape(-1, 5) == np.take_along_axis(d, near, 1)).all()


def test_rows_that_lie_apart_open_no_boxes_to_the_others(monkeypatch):
    # before, a group of 256 rows met all rows that any of its usual rows could reach, and its box was stretched by outliers
    met, plain = [0, 0], nearest.reached

    def counted(*given):
        found = plain(*given)
        met[0] += found.sum()
        met[1] += found.size
        return found

    monkeypatch.setattr(nearest, "reached", counted)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 3))
    x[::40, 2] += rng.normal(size=150) * 1e3  # some in each group
    ids, tree = np.arange(len(x)) * 3, nearest.fit_tree(x, 1)
    monkeypatch.setattr(nearest, "LEAF", 32)
    i, found, d = nearest.search(x, ids, None, x, ids, 5, tree)
    assert met[0] < met[1] / 3
    order = np.lexsort((found, d, i))
    assert list(zip((i * 3)[order].tolist(), found[order].tolist(), d[order].tolist())) == [(a, b, c) for a, b, _, c in brute(ids, x, 5)]


def test_the_vectors_are_freed_before_the_search(spark, monkeypatch):
    # before, they lay on the disk beside the cells until the end of the search, or of the session
    import os

    from lobule.shared import stage

    x = np.random.default_rng(9).normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    v, seen, plain = stage(df, "vectors"), {}, nearest.stage
    path = v.staged_at.removeprefix("file:")
    assert os.path.exists(path)

    def watched(df, hint):
        seen[hint] = os.path.exists(path)
        return plain(df, hint)

    monkeypatch.setattr(nearest, "stage", watched)
    assert graph.knn(v, "id", ["a", "b"], 3, spent=v).count() == 900
    assert seen == {"placed": True, "own": False, "knn": False}
    twice = stage(df.union(df.selectExpr("id + 1000", "1.0", "2.0")), "vectors")  # copies of equal rows are read once more at the end
    assert graph.knn(twice, "id", ["a", "b"], 3, spent=twice).count() == 1800 and not os.path.exists(twice.staged_at.removeprefix("file:"))
