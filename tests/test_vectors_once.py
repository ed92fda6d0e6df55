import pytest

from lobule.plans import analysis, further


@pytest.mark.parametrize("name", ["k_step_flow", "graph_pseudotime", "first_hit_categories", "root_sensitivity", "reach", "root_component", "route_table", "hub_choice"])
def test_the_vectors_are_staged_once(spark, monkeypatch, name):
    calls, plain = [], analysis.vectors

    def counted(spark, d):
        calls.append(d)
        return plain(spark, d)

    monkeypatch.setattr(analysis, "vectors", counted)
    monkeypatch.setattr(further, "vectors", counted)
    (analysis.QUERIES | further.QUERIES)[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
