import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.llm import clusters, neighbours

NAMES = ["a", "b", "c", "d"]


def frame(spark, x, ids=None, extra=True):
    ids = range(len(x)) if ids is None else ids
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "row_id long, a double, b double, c double, d double")
    return df.withColumns({"id": F.lit("clash"), "vec": F.lit(1)}) if extra else df


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [int(ids[j]) for j in sorted(range(len(x)), key=lambda j: (d[i, j], ids[j]))[:k]] for i in range(len(x))}


def test_recall_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(1500, 4))
    got = {}
    for r in neighbours.nearest_vectors(frame(spark, x), "row_id", NAMES, None, 10, sample=500).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    want = brute(x, np.arange(1500), 10)
    assert np.mean([len(got[i] & set(w)) / 10 for i, w in want.items()]) >= 0.99


def test_copies_ties_nulls_and_unknown_queries(spark):
    x = np.array([[0, 0, 0, 0]] * 40 + [[1, 0, 0, 0], [5, 5, 5, 5], [float("nan"), 0, 0, 0]], float)
    df = frame(spark, x)
    asked = spark.createDataFrame([(39,), (40,), (42,), (999,), (None,), (39,)], "row_id long")
    rows = neighbours.nearest_vectors(df, "row_id", NAMES, asked, 3).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["neighbour_id"], round(r["distance"], 9)) for r in rows] == [(39, 0, 0.0), (39, 1, 0.0), (39, 2, 0.0), (40, 0, 1.0), (40, 1, 1.0), (40, 2, 1.0)]


def test_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    x = np.r_[np.zeros((300, 4)), np.random.default_rng(1).normal(size=(300, 4))]
    got = {}
    for r in neighbours.nearest_vectors(frame(spark, x), "row_id", NAMES, None, 5).collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(x, np.arange(600), 5).items()}


def test_empty_and_single(spark):
    assert neighbours.nearest_vectors(frame(spark, np.empty((0, 4))), "row_id", NAMES).count() == 0
    assert neighbours.nearest_vectors(frame(spark, np.zeros((1, 4))), "row_id", NAMES).count() == 0


@pytest.mark.parametrize("width", [14, 64])
def test_abandoning_test_acts_and_loses_little(width):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(6000, width)), rng.normal(size=(60, width))
    turn = neighbours.rotation(width)
    a, b, dist, counts = neighbours.scan(neighbours.turned(q, turn), np.full(60, np.inf), neighbours.turned(x, turn), np.arange(6000), 10)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    want = {(i, j) for i in range(60) for j in np.argsort(d[i], kind="stable")[:10].tolist()}
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.98 * len(want)
    assert counts[0] == 60 * 6000 and counts[1] > 0.05 * counts[0] and counts[3] < 0.2 * counts[0]


def test_plausible_share_is_the_quantile_of_random_turns():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200_000, 14))
    share = (v[:, :4] ** 2).sum(1) / (v**2).sum(1)
    assert abs((share > neighbours.plausible(4, 14, 0.01)).mean() - 0.01) < 0.001
    assert neighbours.plausible(14, 14) == 1.0 and neighbours.plausible(4, 14) < 0.9


def test_outlier_and_all_rows_bound(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=(2000, 4)), [[1e6, 0, 0, 0]]]
    counters = [spark.sparkContext.accumulator(0) for _ in range(4)]
    got = {}
    for r in neighbours.nearest_vectors(frame(spark, x), "row_id", NAMES, None, 10, sample=500, counters=counters).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    want = brute(x, np.arange(2001), 10)
    assert np.mean([len(got[i] & set(w)) / 10 for i, w in want.items()]) >= 0.98
    assert counters[0].value < 0.7 * 2001 * 2001  # far fewer pairs than all


def three_groups(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 9, 0]], float)
    own = rng.integers(0, 3, n)
    noise = rng.normal(size=(n, 4))
    return centres[own] + 0.9 * noise / np.maximum(1, np.linalg.norm(noise, axis=1, keepdims=True)), own


@pytest.mark.parametrize("block", [4096, 60])
def test_classes_of_transitive_similarity(spark, block):
    x, own = three_groups(700)
    x = np.r_[x, x[:200], [[99, 99, 99, 99]], [[float("inf"), 0, 0, 0]]]
    own = np.r_[own, own[:200], 3]
    got = {r["id"]: r["cluster"] for r in clusters.similarity_clusters(frame(spark, x), "row_id", NAMES, 2.5, block=block).collect()}
    assert set(got) == set(range(901))
    assert len({(own[i], c) for i, c in got.items()}) == 4 == len(set(got.values()))


@pytest.mark.parametrize("pairs,block", [(400, 60), (150, 40)])
def test_more_clusters_than_a_block_holds(spark, pairs, block):
    rng = np.random.default_rng(4)
    centres = rng.integers(-40, 40, size=(pairs, 4)) * 10.0  # every centre once, or twice by chance
    x = np.r_[centres + rng.uniform(-0.4, 0.4, (pairs, 4)), centres + rng.uniform(-0.4, 0.4, (pairs, 4))]
    got = {r["id"]: r["cluster"] for r in clusters.similarity_clusters(frame(spark, x), "row_id", NAMES, 2.5, block=block).collect()}
    want = {}
    for i, c in enumerate(map(tuple, np.r_[centres, centres].tolist())):
        want.setdefault(c, []).append(i)
    assert len(got) == 2 * pairs and len(set(got.values())) == len(want)
    assert all(len({got[i] for i in members}) == 1 for members in want.values())


def test_degrees_are_those_of_the_whole_cluster(spark):
    x, own = three_groups(500, 6)
    x = np.r_[x, x[:100]]
    own = np.r_[own, own[:100]]
    rows = clusters.similarity_clusters(frame(spark, x), "row_id", NAMES, 2.5, block=60).collect()
    near = np.exp(-4 * ((x[:, None] - x) ** 2).sum(2) / 2.5**2) * (own[:, None] == own)
    want = near.sum(1) - 1
    for r in rows:
        assert abs(r["degree"] - want[r["id"]]) < (1e-6 if r["is_candidate"] else 0.2 * want[r["id"]])
    for g in range(3):  # the three most typical members are the true ones
        mine = sorted((r for r in rows if own[r["id"]] == g and r["is_candidate"]), key=lambda r: (-round(r["degree"], 9), r["id"]))[:3]
        assert [r["id"] for r in mine] == sorted(np.flatnonzero(own == g).tolist(), key=lambda i: (-round(want[i], 9), i))[:3]


@pytest.mark.parametrize("cut", [32_768, 200])
def test_degrees_of_all_members_are_exact_in_big_clusters(spark, monkeypatch, cut):
    # before, members of clusters of more than 256 points had estimates
    monkeypatch.setattr(clusters, "MEET", cut)
    monkeypatch.setattr(clusters, "LEAF", 64)
    x, own = three_groups(500, 6)
    x = np.r_[x, x[:100]]
    own = np.r_[own, own[:100]]
    rows = clusters.similarity_clusters(frame(spark, x), "row_id", NAMES, 2.5).collect()
    near = np.exp(-4 * ((x[:, None] - x) ** 2).sum(2) / 2.5**2) * (own[:, None] == own)
    want = near.sum(1) - 1
    assert len(rows) == len(x) and max(abs(r["degree"] - want[r["id"]]) for r in rows) < 1e-9
    for g in range(3):
        ranked = sorted(np.flatnonzero((own == g) & (np.arange(len(x)) < len(x) - 100)).tolist(), key=lambda i: (-round(want[i], 6), i))
        assert {r["id"] for r in rows if own[r["id"]] == g and r["is_candidate"] and r["id"] < len(x) - 100} == set(ranked[: clusters.CANDIDATES])


def test_kernel_sums_far_apart_and_where_products_cancel():
    rng = np.random.default_rng(8)
    for away in (0.0, 5.0, 60.0, 1e7):
        x, y = rng.normal(size=(1300, 3)), rng.normal(size=(700, 3))
        x[::7] += away
        y[::5, 0] += away
        if away == 1e7:
            x[0] = 1e9  # a leaf wider than its products bear
        u, v = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
        near = np.exp(-4 * ((x[:, None] - y) ** 2).sum(2) / 1.5**2)
        a, b = clusters.kernel_sums(x, u, y, v, 1.5)
        assert np.abs(a - near @ v).max() < 1e-9 and np.abs(b - u @ near).max() < 1e-9
        a, b = clusters.kernel_sums(x, u, None, None, 1.5)
        assert b is None and np.abs(a - np.exp(-4 * ((x[:, None] - x) ** 2).sum(2) / 1.5**2) @ u).max() < 1e-9


def test_clusters_of_nothing_and_of_copies(spark):
    assert clusters.similarity_clusters(frame(spark, np.empty((0, 4))), "row_id", NAMES, 1.0).count() == 0
    got = clusters.similarity_clusters(frame(spark, np.zeros((50, 4))), "row_id", NAMES, 1.0).collect()
    assert {r["cluster"] for r in got} == {0} and len(got) == 50


def test_neighbour_descent_recall():
    x = np.random.default_rng(3).normal(size=(800, 8))
    near, _ = clusters.neighbour_descent(x, 10)
    want = brute(x, np.arange(800), 10)
    assert np.mean([len(set(near[i]) & set(want[i])) / 10 for i in range(800)]) > 0.9


def test_modularity_splits_two_cliques():
    edges = [(i, j) for g in (range(6), range(6, 12)) for i in g for j in g if i < j] + [(0, 6)]
    a, b = np.array(edges).T
    label = clusters.communities(np.r_[a, b], np.r_[b, a], np.ones(2 * len(a)), np.ones(12))
    assert len(set(label)) == 2 and len(set(label[:6])) == 1 and len(set(label[6:])) == 1
