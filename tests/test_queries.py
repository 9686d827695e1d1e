import pytest

from strandlog.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, compare):
    compare(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_window_spans_the_log(spark):
    """Ordered statistics start anew with each segment: no window over the log's rows is unpartitioned."""
    plan = QUERIES["ts_delta"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seg" in plan
