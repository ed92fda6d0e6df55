import numpy as np
from pyspark.sql import functions as F

from lobule.operators import clustering, plane


def points(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [3, 1] + rng.integers(0, 3, (n, 1)) * 4
    x[:5] *= 50
    x[10:60] = x[10]
    x[60:200, 1] = 0
    return x


def test_far_cells_give_the_sums_of_all_distances(monkeypatch):
    x = points(6000)
    monkeypatch.setattr(plane, "CELLS", 200)
    tree = plane.fit_tree(x, 40)
    at, code, sizes = plane.cell_of(x, tree), np.random.default_rng(1).integers(0, 6, len(x)), [2, 3]
    boxes = {c: (x[at == c].min(0), x[at == c].max(0)) for c in np.unique(at).tolist()}
    held = {c: plane.basis(x[at == c], *plane.box(*boxes[c])).T @ plane.hot(code[at == c], sizes) for c in boxes}
    local, near = plane.fields(tree, boxes, held)
    for c in boxes:
        y, far = x[at == c], ~np.isin(at, near[c])
        want = plane.apart(y, x[far]) @ plane.hot(code[far], sizes)
        assert np.abs(plane.basis(y, *plane.box(*boxes[c])) @ local[c] - want).max() <= 1e-9 * max(1, want.max())
    # before, every row met every other row
    sizes_of = np.bincount(at)
    assert sum(sizes_of[c] * sizes_of[near[c]].sum() for c in boxes) < 0.2 * len(x) ** 2


def test_silhouettes_of_several_labelings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(plane, "ROWS", 32)
    x, rng = points(1500, 3), np.random.default_rng(2)
    labels = [(x[:, 0] > 2).astype(int), np.r_[2, 2 * rng.integers(0, 2, len(x) - 1)], np.zeros(len(x), int)]  # one of the second's clusters is empty
    labels[1][7] = 1  # and one has one row
    code = labels[0] + 2 * labels[1] + 6 * labels[2]
    df = spark.createDataFrame([(i, *map(float, p), int(c), *map(int, g)) for i, (p, c, *g) in enumerate(zip(x, code, *labels))], "id long, x double, y double, code long, g0 int, g1 int, g2 int")
    n, got = plane.silhouettes(df, [2, 3, 1])
    assert n == len(x)
    for i in range(3):
        assert abs(got[i] - clustering.silhouette(df, "id", f"g{i}", ["x", "y"]).first()["silhouette"]) < 1e-9
    same = df.where("id < 50").withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    assert plane.silhouettes(same, [2, 3, 1])[1] == [0.0, 0.0, 0.0]
    assert plane.silhouettes(df.limit(0), [2])[0] == 0


def test_mixtures_fitted_together_are_those_fitted_alone(spark):
    # before, each of the fits had passes of its own
    x = np.random.default_rng(5).normal(size=(9000, 2)) * [1, 0.3] + np.repeat([[0, 0], [3, 1], [9, 9]], 3000, 0)
    df = spark.createDataFrame([(i % 3, *map(float, p)) for i, p in enumerate(x)], "fold int, a double, b double")
    fits = [(1, None), (3, None), (3, 1)]
    for (k, out), m in zip(fits, clustering.gaussian_mixtures(df, ["a", "b"], fits, F.col("fold"))):
        alone = clustering.gaussian_mixture(df if out is None else df.where(F.col("fold") != out), ["a", "b"], k)
        assert m["n"] == alone["n"] and abs(m["loglik"] - alone["loglik"]) < 1e-6 and np.allclose(m["means"], alone["means"])
