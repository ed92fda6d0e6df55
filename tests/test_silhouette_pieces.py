import numpy as np

from lobule.operators import clustering


def table(spark, x, g, ids=None):
    names = [f"v{i}" for i in range(x.shape[1])]
    rows = [(None if i is None else int(i), int(h), *map(float, r)) for i, h, r in zip(range(len(x)) if ids is None else ids, g, x)]
    return spark.createDataFrame(rows, "id long, g int, " + ", ".join(f"{c} double" for c in names)), names


def plain(x, g):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    names, m = np.unique(g, return_counts=True)
    means = np.stack([d[:, g == h].sum(1) for h in names], 1)
    own = g[:, None] == names
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = means[own] / (m[np.searchsorted(names, g)] - 1), np.where(own, np.inf, means / m).min(1)
        s = (b - a) / np.maximum(a, b)
    return np.where(np.isfinite(s), s, 0).mean()


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_are_shuffled_once_and_not_for_each_block(spark, monkeypatch):
    # before, each row was sent to every block, 33 times here, and the disk was full at 0.09 GB
    monkeypatch.setattr(clustering, "BLOCK", 64)
    rng = np.random.default_rng(8)
    x, g = rng.normal(size=(2100, 8)), rng.integers(0, 3, 2100)
    df, names = table(spark, x, g)
    before = shuffled(spark)
    row = clustering.silhouette(df, "id", "g", names).first()
    assert row["n"] == 2100 and abs(row["silhouette"] - plain(x, g)) < 1e-10
    assert shuffled(spark) - before < 5 * x.nbytes


def test_single_precision_with_marks_for_missing_values_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 700)
    monkeypatch.setattr(clustering, "SINGLE", 0)
    rng = np.random.default_rng(9)
    x, g = rng.normal(size=(2300, 5)) * [1, 1, 0.1, 0.01, 2] + [3, 0, 9, 0, 0], rng.integers(0, 4, 2300)
    x[:40, 1], x[30:60, 3], x[60:400] = 9999, -999, x[60]
    x[400:900] = x[400] + rng.normal(size=(500, 5)) * 1e-5
    df, names = table(spark, x, g)
    assert abs(clustering.silhouette(df, "id", "g", names).first()["silhouette"] - plain(x, g)) < 1e-8
    far = x[:300] * 1e-25
    assert abs(clustering.silhouette(table(spark, far, g[:300])[0], "id", "g", names).first()["silhouette"] - plain(far, g[:300])) < 1e-8


def test_small_labels_share_pieces_and_equal_ids_are_one_row(spark, monkeypatch):
    places, rows = clustering.pieces({5: 100, 1: 7, 2: 30, 9: 4, **{g: 1 for g in range(20, 150)}}, 40)
    assert places[:4] == [(1, 0, 1), (2, 0, 1), (5, 1, 3), (9, 4, 1)] and rows[:4] == [37, 34, 34, 34] and max(rows) <= 40
    rng = np.random.default_rng(10)
    x, g = rng.normal(size=(90, 2)), np.r_[np.zeros(50, int), np.arange(40) // 3 + 1]  # the last label has one row
    df, names = table(spark, x, g)
    assert abs(clustering.silhouette(df, "id", "g", names).first()["silhouette"] - plain(x, g)) < 1e-12
    twice, _ = table(spark, np.r_[x, x[:1]], np.r_[g, g[:1]], [*range(1, 90), None, 1])
    assert clustering.silhouette(twice, "id", "g", names).first()["n"] == 90
    assert clustering.silhouette(df.where("g = 0"), "id", "g", names).first()["silhouette"] == 0
    assert tuple(clustering.silhouette(df.limit(0), "id", "g", names).first()) == (0, None)
