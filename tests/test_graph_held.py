import numpy as np
import pytest
from pyspark.sql import functions as F

from lobule.operators import communities, graph

TOLD = "every round was a job of its own, whatever the size of the graph"


@pytest.fixture(scope="module")
def web(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(map(int, rng.integers(0, 20, 2) + 20 * block))) for block in range(3) for _ in range(60)}
    pairs = {(a, b) for a, b in pairs if a != b} | {(0, 20)}
    rows = [(x, y, 1.0 + (a * 7 + b) % 5) for a, b in pairs for x, y in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "src long, dst long, w double").cache()


def rows(df):
    return sorted((r[0], round(r[1], 9)) for r in df.collect())


def rounds(monkeypatch, module):
    taken = []
    monkeypatch.setattr(module, "stage", lambda df, *a, _stage=module.stage, **k: taken.append(a) or _stage(df, *a, **k))
    return taken


@pytest.mark.parametrize("name", ["connected_components", "shortest_paths", "reachable"])
def test_graph_walks_in_one_task_equal_the_rounds(spark, web, monkeypatch, name):
    walk, more = getattr(graph, name), [] if name == "connected_components" else [spark.createDataFrame([(3,), (7,)], "node long")]
    want = rows(walk(web, *more, held=0))
    taken = rounds(monkeypatch, graph)
    assert rows(walk(web, *more)) == want and len(taken) == 1, TOLD


def test_communities_in_one_task_equal_the_rounds(web, monkeypatch):
    for resolution in (0.5, 1.0):
        assert rows(communities.modularity_communities(web, resolution)) == rows(communities.modularity_communities(web, resolution, held=0))
    taken = rounds(monkeypatch, communities)
    communities.modularity_communities(web).count()
    assert not taken, TOLD
    assert communities.modularity_communities(web.where(F.lit(False))).isEmpty()
