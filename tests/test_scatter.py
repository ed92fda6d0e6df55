import numpy as np

from lobule.operators import clustering


def test_calinski_harabasz_equals_numpy_and_is_planned_in_steps(spark):
    x = np.random.default_rng(4).normal(size=(90, 2)) + np.repeat([[0, 0], [3, 1], [9, 9]], 30, 0)
    df = spark.createDataFrame([(i // 30, float(a), float(b)) for i, (a, b) in enumerate(x)], "g int, a double, b double")
    parts = np.split(x, 3)
    within = sum(((p - p.mean(0)) ** 2).sum() for p in parts)
    between = sum(30 * ((p.mean(0) - x.mean(0)) ** 2).sum() for p in parts)
    assert abs(clustering.calinski_harabasz(df, "g", ["a", "b"]).first()["calinski_harabasz"] - (between / 2) / (within / 87)) < 1e-9
    # before, one plan held the sums, the join and the window over every column
    assert clustering.scatter_within(df, "g", ["a", "b"]).staged_at


def test_two_blocks_meet_once_and_close_rows_far_away_keep_their_distances(spark, monkeypatch):
    import numpy as np

    from lobule.operators import clustering

    calls = spark.sparkContext.accumulator(0)
    plain = clustering.distances

    def counted(x, y):
        calls.add(len(x) * len(y))
        return plain(x, y)

    monkeypatch.setattr(clustering, "BLOCK", 32)
    monkeypatch.setattr(clustering, "distances", counted)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * 1e-3 + np.repeat([[0.0], [1e6], [5.0], [5.002]], 50, 0)
    g = np.repeat([1, 2, 3, 4], 50)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    a = np.array([d[i, g == g[i]].sum() / 49 for i in range(200)])
    b = np.array([min(d[i, g == h].mean() for h in range(1, 5) if h != g[i]) for i in range(200)])
    df = spark.createDataFrame([(i, int(h), *map(float, r)) for i, (h, r) in enumerate(zip(g, x))], "id long, g int, a double, b double, c double")
    row = clustering.silhouette(df, "id", "g", ["a", "b", "c"]).first()
    assert row["n"] == 200 and abs(row["silhouette"] - np.mean((b - a) / np.maximum(a, b))) < 1e-8
    assert 0 < calls.value < 0.7 * 200 * 200
