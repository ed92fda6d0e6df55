import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.operators import alignment, bins, clustering, graph, grouping, ranking, spatial, statistics
from lobule.shared import free, join_one_row_each, numbered, stage
from lobule.sources import files


def test_numbered_counts_on_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = numbered(df, ["v"], "place").collect()
    assert sorted((r["v"], r["place"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert numbered(df.where("v < 0"), ["v"], "place").count() == 0


def test_join_one_row_each_with_hot_key(spark):
    big = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_one_row_each(big, small, ["k"], "n", hot=50)
    assert sorted(got.columns) == ["id", "k", "top"] and got.count() == 300 and got.where("k = 1 and top = 199").count() == 200


def test_free_removes_a_stage_table(spark):
    df = stage(spark.range(3), "gone")
    free(df)
    free(df)
    with pytest.raises(Exception):
        df.count()


def test_first_hits_of_several_starts_add_up(spark):
    rng = np.random.default_rng(0)
    edges = [(i, int(j), float(rng.random() + 0.1)) for i in range(40) for j in rng.choice(40, 5, replace=False)]
    p = graph.markov(spark.createDataFrame(edges, "src long, dst long, w double"))
    targets = spark.createDataFrame([(38,), (39,)], "node long")
    starts = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 0.5), ("b", 2, 0.5)], "start string, node long, mass double")
    rows = graph.first_hits_of(p, starts, targets).groupBy("start").agg(F.sum("prob").alias("p")).collect()
    assert {r["start"] for r in rows} == {"a", "b"} and all(abs(r["p"] - 1) < 1e-6 for r in rows)
    one = graph.first_hits(p, starts.where("start = 'b'").select("node", "mass"), targets).agg(F.sum("prob")).first()[0]
    assert abs(one - 1) < 1e-6
    short = spark.createDataFrame([(0, 1, 0.2), (0, 38, 0.8), (1, 0, 0.1), (1, 39, 0.9), (2, 39, 1.0)], "src long, dst long, p double")
    slow = graph.first_hits_of(short, starts, targets, tolerance=1e-3, held=0).groupBy("start").agg(F.sum("prob").alias("p")).collect()
    assert len(slow) == 2 and all(abs(r["p"] - 1) < 2e-3 for r in slow)


def test_a_trap_is_a_sink(spark):
    p = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (2, 2, 1.0)], "src long, dst long, p double")
    got = graph.first_hits(p, spark.createDataFrame([(0, 1.0)], "node long, mass double"), spark.createDataFrame([(1,)], "node long")).collect()
    assert [(r["target"], r["via"], r["prob"]) for r in got] == [(1, 0, 0.5)]


def test_routes_and_hub(spark):
    assert graph.default_routes("c", ["x", "y"]) == [["c", "x"], ["c", "y"], ["c", "x", "y"], ["c", "y", "x"]]
    t = spark.createDataFrame([("c1", "x", 0.2), ("c2", "y", 0.7), ("c0", "x", 0.7)], "start string, name string, prob double")
    assert graph.hub_of(t) == ("c0", "x", 0.7) and graph.hub_of(t.where("prob > 1")) == (None, None, 0.0)


def test_root_component_and_unfinished_iterations_raise(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 1.0), (4, 3, 1.0)], "src long, dst long, w double")
    roots = spark.createDataFrame([(0,), (2,), (4,)], "node long")
    assert {r["node"] for r in graph.root_component(e, roots).collect()} == {2, 3, 4}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(e, roots.where("node = 2"), most_rounds=1)
    with pytest.raises(RuntimeError):
        graph.reachable(e, roots.where("node = 2"), most_rounds=1)


def test_neighbours_or_within_finds_lonely_rows(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 1.0, 0.0), ("s", 2, 2.0, 0.0), ("s", 3, 500.0, 0.0), ("t", 9, 0.0, 0.0), ("s", 4, None, 0.0)], "g string, id long, x double, y double")
    got = {(r["a"], r["b"]) for r in spatial.neighbours_or_within(df, ["g"], "id", "x", "y", 1, 2.5, 3.0).collect()}
    assert got == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 0), (3, 2)}
    assert spatial.neighbours_or_within(df.where("id > 99"), ["g"], "id", "x", "y", 1, 2.5, 3.0).count() == 0


def test_planned_contrast_uses_the_whole_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 8}", float(i % 2), float(x), float(0.5 * (i % 2) + x + rng.normal())) for i, x in enumerate(rng.normal(3, 1, 600))]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    table, _, covariance = statistics.mixed_model(df, "y", {"a": F.col("a"), "b": F.col("b")}, "g")
    assert np.allclose(np.sqrt(np.diag(covariance)), table["se"]) and abs(covariance[0, 2]) > 1e-5
    w = np.array([1.0, 1.0, 3.0])
    assert abs(statistics.contrast(table["coef"].to_numpy(), covariance, w)["se"] - np.sqrt(w @ covariance @ w)) < 1e-12


def test_outliers_signed_axis_and_places(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,), (float("nan"),)], "x double")
    assert ranking.outlier_cut(df, "x", 0.5, 1e9).count() == 50
    assert ranking.outlier_cut(df, "x", 0.0, 10.0).count() == 10  # the quantile leaves too few
    s = ranking.signed_rescale(df, "x", F.col("x") == 0, F.col("x") >= 50).agg(F.min("signed"), F.max("signed"), F.min("unit")).first()
    assert tuple(s) == (-1.0, 1.0, 0.0)
    p = spark.createDataFrame([("g", "a", 0.6), ("g", "b", 0.3), ("g", "c", 0.1)], "g string, c string, p double")
    assert ranking.places_to(p, ["g"], "p", "c", 0.9).first()["needed"] == 2


def test_bins_of_data_range_and_levels(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r["bin"] for r in bins.data_range_bins(df, "x", 20).orderBy(F.asc_nulls_last("x")).collect()] == [1, 10, 20, None]
    assert bins.data_range_bins(df.where("x = 5"), "x", 20).first()["bin"] == 1
    g = spark.createDataFrame([("b",), ("a",), (None,), ("10",)], "g string")
    assert {(r["g"], r["n"]) for r in grouping.ordinal_levels(g, "g", "n").collect()} == {("10", 0), ("a", 1), ("b", 2), (None, None)}
    n = spark.createDataFrame([("10",), ("9",), ("9.0",), ("1",), ("2",), ("3",), ("junk",)], "g string")
    assert {(r["g"], r["n"]) for r in grouping.ordinal_levels(n, "g", "n").collect()} >= {("9", 3), ("9.0", 3), ("10", 4), ("junk", None)}


def test_unit_wasserstein_draws_no_more_than_asked(spark):
    left = spark.createDataFrame([("a", f"u{i}", float(i % 3)) for i in range(40)], "a string, unit string, x double")
    right = spark.createDataFrame([("b", f"v{i}", 1.0) for i in range(40)] + [("b", None, 5.0)], "b string, unit string, x double")
    got = alignment.unit_wasserstein(left, right, 100).first()
    assert got["support"] == 100 and 0.4 < got["w"] < 0.9
    assert alignment.unit_wasserstein(left.limit(2), right, 100).first()["support"] == 80


def test_stable_and_variable_features(spark):
    df = spark.createDataFrame([(1.0, 10.0, 0.0), (1.1, 30.0, 5.0), (0.9, 20.0, 0.0)], "a double, b double, c double")
    assert [r["feature"] for r in clustering.stable_features(df, ["a", "b", "c"], 2).orderBy("place").collect()] == ["a", "b"]
    assert clustering.variable_features(df, ["a", "b", "c"], 1).first()["feature"] in ("b", "c")


def test_resolve_and_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 3)], "id long, position double, component_1 double, component_2 double, cat int")
    files.write_assignments(df, p, "id", "position", ["component_1", "component_2"], "cat")
    assert files.resolve(spark, "t", [str(tmp_path / "no"), str(tmp_path)]) == p
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, "nothing", [str(tmp_path)])
    assert files.precomputed_components(df, "id").columns == ["id", "component_1", "component_2"]
    with pytest.raises(ValueError):
        files.precomputed_components(df.select("id"), "id")
