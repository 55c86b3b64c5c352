import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import measures, neighborhoods, references, transport


@pytest.mark.parametrize("weights", [(10.0, 0.25, 0.1), (1.0, 1.0, 900.0)])
def test_self_costs_of_neighborhoods_are_those_of_measures(spark, weights):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 250)) * 9
    cells = spark.createDataFrame([(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, 0, None, 1.0)], "row_idx long, sample_id int, x double, y double")
    vectors = spark.createDataFrame([(i, v) for i, v in zip([*range(250), 900], rng.normal(size=(251, 2)).tolist(), strict=True)], "row_idx long, z array<double>")
    tokens = measures.tokens(neighborhoods.supports(cells, 5.0, "gaussian"), cells, vectors, 5.0)
    packed = measures.packed(measures.scaled_tokens(tokens, weights, (1.0, 1.0, 1.0)))
    want = {r.row_idx: r.self_cost for r in transport.self_costs(packed, 0.5, 3).collect()}
    got = {r.row_idx: r.self_cost for r in references.self_costs(cells, vectors, 5.0, weights, epsilon=0.5, sweeps=3).collect()}
    assert got.keys() == want.keys() and len(got) == 251 and all(got[k] == pytest.approx(v, abs=1e-10) for k, v in want.items())


def test_query_makes_no_table_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(measures, "tokens", None)
    assert catalog.QUERIES["sinkhorn_self_cost"](spark, "/root/testdata/sf0.001").count() > 0
