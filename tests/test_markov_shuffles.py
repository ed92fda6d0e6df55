import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.operators import graph, nearest

SLACK = 1e-3


@pytest.fixture(scope="module")
def web(spark):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 44, 150), rng.choice([0.0, 0.5, 1.0, 2.0], 150)) if a != b}
    times = {n: float(rng.choice([0.1, 0.1005, 0.4, 0.7])) for n in range(44) if n % 9}
    return edges, times, spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double"), spark.createDataFrame(list(times.items()), "node long, pseudotime double")


def plain(edges, fine):
    kept = {e: w for e, w in edges.items() if w > 0 and fine(*e)}
    total = {}
    for (a, _), w in kept.items():
        total[a] = total.get(a, 0.0) + w
    return sorted([(a, b, round(w / total[a], 9)) for (a, b), w in kept.items()] + [(n, n, 1.0) for n in {n for e in edges for n in e} - set(total)])


def rows(df):
    return sorted((r["src"], r["dst"], round(r["p"], 9)) for r in df.collect())


def test_markov_with_dead_ends_missing_times_and_nodes_without_an_edge_of_their_own(web):
    edges, times, df, time = web
    assert rows(graph.markov(df)) == plain(edges, lambda a, b: True)
    assert rows(graph.markov(df, time)) == plain(edges, lambda a, b: a in times and b in times and times[b] + SLACK >= times[a])


def test_times_that_travel_with_the_pairs_equal_times_that_are_joined(spark, web):
    x = spark.createDataFrame([(i, float(v), float(u)) for i, (v, u) in enumerate(np.random.default_rng(6).normal(size=(44, 2)))], "id long, a double, b double")
    near, time = graph.knn(x, "id", ["a", "b"], 4), web[3]
    want = rows(graph.markov(graph.affinity(near, 4), time))
    assert rows(graph.markov(graph.both_ways(graph.pair_weights(near, time)), both=True)) == want and len({r[0] for r in want}) == 44


def test_markov_sorts_its_edges_once(spark, web):
    # before, edges were shuffled by src, by dst and by src again, and the nodes apart from them
    _, _, df, time = web
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffles = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(graph.markov(df)) == 1 and shuffles(graph.markov(df, time)) <= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_rows_that_ask_other_cells_are_sent_again(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(nearest, "stage", lambda df, hint, _stage=nearest.stage: staged.setdefault(hint, _stage(df, hint)))
    monkeypatch.setattr(nearest, "free", lambda df: None)
    x = np.random.default_rng(7).normal(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    found = nearest.nearest(df.select("id", F.array("a", "b").alias("x")), 2, 3, 150)
    own = staged["own"].select(F.size("to").alias("asks"), F.col("x").isNotNull().alias("sent")).collect()
    assert all((r["asks"] > 0) == r["sent"] for r in own) and 0 < sum(r["sent"] for r in own) < 300
    assert found.count() == 1800
