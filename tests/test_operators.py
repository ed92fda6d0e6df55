"""Operators on small cases with nulls, ties, repeated and missing rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.functions import cleaning as C
from lobule.functions import labels as L
from lobule.functions import special as S
from lobule.operators import alignment, bins, clustering, graph, grouping, models, ranking, spatial, statistics
from lobule.sources import files

NAN, INF = float("nan"), float("inf")


def test_null_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN), (4, INF), (5, 3.0)], "id int, x double")
    got = lambda p: [r["x"] for r in C.apply_nulls(df, p, ["x"]).orderBy("id").collect()]
    assert got(C.NullPolicy.EPS_FILL) == [1.0, 1e-8, 1e-8, 1e-8, 3.0]
    assert got(C.NullPolicy.ZERO_FILL_ALL) == [1.0, 0, 0, 0, 3.0]
    assert got(C.NullPolicy.ZERO_FILL_DROP_INF) == [1.0, 0, 0, 3.0]
    assert got(C.NullPolicy.MEDIAN_FILL) == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert got(C.NullPolicy.COERCE_DROP) == [1.0, 3.0]
    with pytest.raises(ValueError):
        got(C.NullPolicy.REQUIRE_NO_NULL)
    with pytest.raises(ValueError, match="y"):
        C.require_columns(df, ["x", "y"])
    assert C.apply_nulls(df.where("id < 0"), C.NullPolicy.MEDIAN_FILL, ["x"]).count() == 0


def test_labels(spark):
    rows = ["CNT_L1L1a0s0_1", "['STV_L2L3a4s2_13', 'STV_L2L3a4s3_13']", "CL1TS1R2Z0_1", None, "", "P1S1R1S0_001"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, s string")
    got = df.select("i", L.acinus(F.col("s")).alias("a"), L.condition(F.col("s")).alias("c"), *[v.alias(k) for k, v in L.ivm_parts(F.col("s")).items()], L.first_member(F.col("s")).alias("m"), *[v.alias(k) for k, v in L.organ_hierarchy(F.col("s")).items()]).orderBy("i").collect()
    assert [r["a"] for r in got] == ["L1L1a0", "L2L3a4", None, None, None, None]
    assert [r["c"] for r in got] == ["CNT", "STV", "CL1TS1R2Z0", "Unknown", "Unknown", "P1S1R1S0"]
    assert tuple(got[2])[3:6] == ("CL1", "TS1", "R2") and got[1]["m"] == "STV_L2L3a4s2_13"
    assert [got[5][k] for k in ("animal", "section", "region", "slice", "cell")] == [1, 1, 1, 0, 1]
    assert spark.range(1).select(L.route_name(F.lit("3>5>6"))).first()[0] == "H4→FH1→FH2"


def test_bins_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.25, 0.5, 1.0, 1.1, None, NAN)], "x double")
    assert [r[0] for r in df.select(bins.right_closed(F.col("x"), 0.0, 1.0, 4)).collect()] == [0, 0, 1, 3, None, None, None]
    assert [r[0] for r in df.select(bins.left_closed(F.col("x"), 0.0, 1.0, 4)).collect()] == [0, 1, 2, None, None, None, None]


def test_diversity_and_empty_bins(spark):
    df = spark.createDataFrame([("g", 0.1, "a"), ("g", 0.1, "b"), ("g", 0.9, "a")], "g string, x double, c string")
    got = {r["bin"]: r for r in bins.diversity_curve(df, ["g"], F.col("x"), "c", 0.0, 1.0, 3, 2).collect()}
    assert got[0]["H"] == 1.0 and got[0]["D"] == 0.5 and got[0]["E"] == 1.0
    assert got[1]["n_cells"] == 0 and got[1]["H"] is None and got[2]["H"] == 0.0
    assert bins.diversity_curve(df.where("g = 'no'"), ["g"], F.col("x"), "c", 0.0, 1.0, 3, 2).count() == 0


def test_ranks_and_samples(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "id long, v double")
    assert [r[0] for r in df.where("v is not null").withColumn("r", ranking.average_rank(F.col("v"), [])).orderBy("id").select("r").collect()] == [3.5, 1.0, 3.5, 2.0]
    assert ranking.best_row(df.withColumn("k", F.lit(1)), ["k"], "v", "id", ["id"]).first()["id"] == 0
    assert ranking.hash_sample(spark.range(100), "id", 10).count() == 10
    mixed = ranking.permute_within(df.withColumn("k", F.lit(1)), ["k"], "v", "id", 3).collect()
    assert sorted(str(r["shuffled"]) for r in mixed) == sorted(str(r["v"]) for r in mixed)
    boot = ranking.bootstrap(spark.range(2000), "id", 5).groupBy("run").agg(F.sum("copies").alias("n")).collect()
    assert all(abs(r["n"] - 2000) < 250 for r in boot)


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(0, 1, 30), "b": rng.normal(0.5, 2, 20), "c": rng.normal(1, 1, 25)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0), ("a", NAN)], "g string, x double")
    long = statistics.long_values(df, ["g"], ["x"])
    everything = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in groups.values())
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    row = statistics.anova_p(statistics.anova(long, "g")).first()
    assert math.isclose(row["f"], between / 2 / (within / 72), rel_tol=1e-9) and row["n"] == 75
    assert statistics.pairwise(long, "g").count() == 3
    assert statistics.anova(long.where("g = 'a'"), "g").first()["f"] is None
    assert statistics.welch(long.where("g = 'a'"), "g").first()["status"].startswith("skipped")


def test_special_functions_known_values():
    assert math.isclose(S.f_tail(4.0, 2, 10), 0.0529, abs_tol=2e-4)
    assert math.isclose(S.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(S.t_quantile(0.975, 10), 2.2281, abs_tol=1e-3)
    assert math.isclose(S.range_tail(3.877, 3, 10), 0.05, abs_tol=5e-4)
    assert math.isclose(S.range_quantile(0.95, 3, 1e6), 3.314, abs_tol=2e-3)


def test_mixed_model_recovers_variances(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        u = rng.normal(0, 1.0)
        for _ in range(25):
            x = rng.normal()
            rows.append((g, float(x), float(2 + 0.5 * x + u + rng.normal(0, 0.5))))
    table, variances, covariance = statistics.mixed_model(spark.createDataFrame(rows, "g int, x double, y double"), "y", {"x": F.col("x")}, "g")
    assert abs(table["coef"][1] - 0.5) < 0.05 and abs(variances["residual"] - 0.25) < 0.03 and 0.5 < variances["group"] < 1.8


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    y = 1 + x @ [2, -1] + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = statistics.ols(df, "y", {"a": F.col("a"), "b": F.col("b")})
    assert np.allclose(got["coef"], np.linalg.lstsq(np.c_[np.ones(50), x], y, rcond=None)[0])


def test_mixture_and_order(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(-3, 0.5, (80, 2)), rng.normal(3, 0.5, (80, 2))]
    df = spark.createDataFrame([(i, float(a), float(b), float(a)) for i, (a, b) in enumerate(x)], "id long, a double, b double, position double")
    model = clustering.gaussian_mixture(df, ["a", "b"], 2)
    assert np.allclose(sorted(model["means"][:, 0]), [-3, 3], atol=0.3)
    labelled = clustering.mixture_labels(df, ["a", "b"], model)
    ordered = clustering.order_along_axis(labelled, "prediction", ["a", "b"], "position", "id").orderBy("new_label").collect()
    assert ordered[0]["estimated_position"] > ordered[1]["estimated_position"]


def test_graph_on_a_path(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ((1, 2), (2, 3), (3, 4), (8, 9))] + [(b, a, 1.0) for a, b in ((1, 2), (2, 3), (3, 4), (8, 9))], "src long, dst long, w double")
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    roots = spark.createDataFrame([(1,)], "node long")
    time = graph.pseudotime(edges.select(F.col("src").alias("node")).distinct(), graph.shortest_paths(edges, roots), roots)
    got = {r["node"]: r["pseudotime"] for r in time.collect()}
    assert got[1] == 0 and got[2] == 0 and abs(got[3] - 0.5) < 1e-9 and got[4] == 1 and got[9] == 1
    assert {r["node"] for r in graph.reachable(edges, roots).collect()} == {1, 2, 3, 4}
    hits = graph.first_hits(graph.markov(edges, time), roots.withColumn("mass", F.lit(1.0)), spark.createDataFrame([(4,)], "node long"), most_rounds=200)
    assert abs(hits.first()["prob"] - 1) < 1e-3


@pytest.mark.parametrize("held", [graph.HELD, 0])
def test_first_hits_solve_the_absorbing_chain(spark, held):
    walk = [(1, 1, 0.5), (1, 2, 0.3), (1, 7, 0.2), (2, 1, 0.4), (2, 3, 0.25), (2, 4, 0.35), (3, 9, 1.0), (4, 4, 1.0), (7, 7, 1.0), (9, 1, 1.0)]  # 7: no way on
    p = spark.createDataFrame([(a, b, float(c)) for a, b, c in walk], "src long, dst long, p double")
    start, goals = spark.createDataFrame([(1, 0.75), (2, 0.25)], "node long, mass double"), spark.createDataFrame([(3,), (4,)], "node long")
    got = {(r["target"], r["via"]): r["prob"] for r in graph.first_hits(p, start, goals, held=held).collect()}
    visits = np.linalg.solve(np.eye(2) - np.array([[0.5, 0.3], [0.4, 0.0]]).T, [0.75, 0.25])
    assert got.keys() == {(3, 2), (4, 2)} and abs(got[3, 2] - 0.25 * visits[1]) < 1e-8 and abs(got[4, 2] - 0.35 * visits[1]) < 1e-8
    with pytest.raises(RuntimeError, match="on its way"):
        graph.first_hits(p, start, goals, most_rounds=1, held=held)


def test_knn_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, -1.0), (4, None), (5, 0.0)], "id long, x double")
    got = {r["src"]: [] for r in df.where("x is not null").select(F.col("id").alias("src")).collect()}
    for r in graph.knn(df, "id", ["x"], 2).orderBy("src", "place").collect():
        got[r["src"]].append(r["dst"])
    assert got[1] == [5, 2] and got[5] == [1, 2]


def test_moran_sign(spark):
    rows = [(0, i, float(i), 0.0, 1 if i < 10 else 2, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "s int, id long, x double, y double, cat int, bin int")
    edges = spatial.undirected(spatial.neighbours(df, ["s"], "id", "x", "y", 2, 1.5), ["s"])
    assert edges.count() == 19
    assert all(r["moran"] > 0.5 for r in spatial.moran(edges, spatial.residuals(df, ["s"], "id", "cat", "bin"), ["s"]).collect())


def test_permutations_within_bins_of_every_group(spark):
    rng = np.random.default_rng(6)
    # group 0: two halves of the plane, one bin; group 1: categories fixed by the bin, so shuffles within bins change nothing
    rows = [(0, i, float(i % 8), float(i // 8), 1 if i < 32 else 2, 0) for i in range(64)] + [(1, 100 + i, float(i % 8), float(i // 8), 1 + i // 32, i // 32) for i in range(64)]
    rows += [(2, 200 + i, float(i % 8), float(i // 8), int(rng.integers(1, 4)), int(rng.integers(0, 2))) for i in range(64)] + [(3, 300, 0.0, 0.0, 1, 0)]
    df = spark.createDataFrame(rows, "s int, id long, x double, y double, cat int, bin int")
    edges = spatial.undirected(spatial.neighbours(df, ["s"], "id", "x", "y", 4, 1.1), ["s"])
    seen = {(r["s"], r["ci"], r["cj"]): r["n"] for r in spatial.adjacency(edges, df, ["s"], "cat").collect()}
    got = {(r["s"], r["ci"], r["cj"]): r for r in spatial.adjacency_test(edges, df, ["s"], "cat", "bin").collect()}
    assert all(got[k]["n"] == n for k, n in seen.items()) and len(got) == 4 + 4 + 9
    assert got[0, 1, 2]["p"] == 1 / 201 and got[1, 1, 2]["p"] == 1 and got[1, 1, 2]["mean"] == got[1, 1, 2]["n"]
    whole = {r["s"]: r for r in spatial.niche_tests(edges, df, ["s"], "cat", "bin").collect()}
    assert whole.keys() == {0, 1, 2} and whole[0]["moran_p"] == 1 / 201 and whole[0]["pairs"] == 3 and whole[0]["fraction_explained"] == 0 and whole[0]["fraction_p"] == 1
    assert whole[1]["fraction_explained"] == 1 and whole[1]["fraction_p"] == 1 / 501 and whole[1]["moran"] is None and whole[1]["pairs"] == 0
    moran = [r["moran"] for r in spatial.moran(edges, spatial.residuals(df, ["s"], "id", "cat", "bin"), ["s"]).where("s = 2").collect()]
    assert abs(np.mean(moran) - whole[2]["moran"]) < 1e-9 and whole[2]["moran_p"] > 0.02


def test_wasserstein_of_shifted_samples(spark):
    left = spark.createDataFrame([(1, float(i)) for i in range(10)] + [(1, None)], "a int, x double")
    right = spark.createDataFrame([(7, i + 2.5) for i in range(10)], "b int, x double")
    assert abs(alignment.wasserstein(left, right).first()["w"] - 2.5) < 1e-9


def test_alignment_in_resamples(spark):
    rng = np.random.default_rng(7)
    draw = lambda: [(c, float(round(v, 2))) for c, m, k in ((1, -0.5, 60), (2, 0.1, 40), (3, 0.5, 4)) for v in rng.normal(m, 0.2, k)]
    rows, others = draw(), draw()
    left, right = spark.createDataFrame(rows + [(1, None)], "a int, x double"), spark.createDataFrame(others, "b int, x double")
    x = np.unique([v for _, v in rows + others])
    counts = np.array([[sum(1 for c, v in part if c == k and v == at) for at in x] for part in (rows, others) for k in (1, 2, 3)])
    w, weight = alignment._consensus_of(x, counts, 3)
    for r in alignment.consensus(left, right).collect():
        assert abs(w[r["a"] - 1, r["b"] - 1] - r["w"]) < 1e-9 and abs(weight[r["a"] - 1, r["b"] - 1] - r["consensus"]) < 1e-9
    got = alignment.bootstrap_alignment(left, right, 60, tasks=5).toPandas()
    assert len(got) == 540 and got["run"].nunique() == 60 and got.groupby("run")["tau"].nunique().max() == 1 and got["tau"].nunique() > 50
    assert (got.groupby("run")["matched"].sum() == 3).all() and got[(got["a"] == 1) & (got["b"] == 1)]["matched"].mean() > 0.9
    again = alignment.bootstrap_alignment(left.repartition(3), right, 60, tasks=5).toPandas()
    assert got.sort_values(["run", "a", "b"]).reset_index(drop=True).equals(again.sort_values(["run", "a", "b"]).reset_index(drop=True))


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(float(a), float(b), float(c), int(a + b > 0)) for a, b, c in x], "a double, b double, c double, y int")
    model = models.forest(df, ["a", "b", "c"], "y", trees=3, depth=3)
    trees = models.forest_nodes(model)
    for tree in trees:
        values = models.shapley_of_tree(tree, x, 3)

        def predict(row, node=0):
            f = tree["feature"][node]
            return tree["value"][node] if f < 0 else predict(row, tree["left"][node] if row[f] <= tree["threshold"][node] else tree["right"][node])

        leaves = [i for i in range(len(tree["feature"])) if tree["feature"][i] < 0]
        mean = sum(tree["value"][i] * tree["cover"][i] for i in leaves) / tree["cover"][0]
        assert np.allclose(values.sum(1) + mean, [predict(r) for r in x], atol=1e-9)


def test_perceptron_learns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in x] + [(None, 1.0, 0)], "a double, b double, y int")
    layers = models.fit_mlp(df, ["a", "b"], "y", 2, (16,), 60, rate=0.05)
    assert models.accuracy(models.predict_mlp(df, ["a", "b"], layers), "y", "predicted").first()["accuracy"] > 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,a,a,position\nx,1.5,-,0.1\ny,bad,2,0.2\n")
    df = files.scan_csv(spark, str(tmp_path / "m.csv"), ["id"])
    assert df.columns == ["id", "a", "a.1", "position"]
    assert [r["x"] for r in files.modality_matrix(df).orderBy("cell_id").collect()] == [[1.5, 0.0], [0.0, 2.0]]
    files.write_summary(spark, str(tmp_path / "s"), {"k": np.float64("nan"), "v": [np.int64(3)]})
    assert files.read_summaries(spark, [str(tmp_path / "s")]).first()["v"] == [3]
    with pytest.raises(FileNotFoundError):
        files.scan_first(spark, [str(tmp_path / "none.csv")])


def test_stream_of_counts(spark, tmp_path):
    from lobule.streaming import diversity

    spark.createDataFrame([("g", 0.1, "a"), ("g", 0.1, "b"), ("g", 0.9, "a"), ("g", 2.0, "a")], "g string, x double, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, x double, c string").parquet(str(tmp_path / "in"))
    q = diversity.bin_counts(stream, ["g"], "x", "c", 0.0, 1.0, 2).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {r["bin"]: r["H"] for r in diversity.indices(spark.table("counts"), ["g"]).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_grouping(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, None, 2), (2, 0.0, 1)], "k int, x double, id int")
    assert {(r["k"], r["share"]) for r in grouping.composition(df, ["k"], ["x"]).collect()} == {(1, 1.0), (2, 0.0)}
    with pytest.raises(ValueError):
        grouping.assert_unique(df, "k", "id")


def test_communities_of_two_cliques(spark):
    from lobule.operators import communities

    pairs = [(i, j) for g in (range(6), range(6, 12)) for i in g for j in g if i != j] + [(0, 6), (6, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    labels = communities.modularity_communities(edges)
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(6, 12)}) == 1 and got[0] != got[6]
    assert communities.modularity(edges, labels) > 0.4
