import pytest

from loomspark.plans import QUERIES, decisions


@pytest.mark.parametrize("name", ["crag_filter", "context_selection"])
def test_the_search_is_planned_once(spark, monkeypatch, name):
    calls, dense = [], decisions.dense
    monkeypatch.setattr(decisions, "dense", lambda *a: calls.append(a) or dense(*a))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
