"""Plan checks over every catalog query: no cartesian products, no nested
loop joins, no Python evaluation in the hot path, and the event scans prune
columns and receive the event-type filters."""

import contextlib
import io

import pytest

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _keys():
    from tidepool.plans import catalog

    return sorted(catalog.queries())


@pytest.mark.parametrize("key", _keys())
def test_no_pair_explosion_or_python_in_plan(spark, key):
    from __spark_entry__ import queries

    plan = plan_of(queries()[key](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{key}: {bad}"


def test_flagship_scans_are_pruned_and_filtered(spark):
    from __spark_entry__ import queries

    plan = plan_of(queries()["live_window_agg"](spark, SF))
    assert "PushedFilters: [In(event_type, [purchase,view])" in plan
    assert "PushedFilters: [In(event_type, [click,error,signup])" in plan
    for line in plan.splitlines():
        if line.startswith("ReadSchema: struct<") and "event" in plan:
            assert "props" not in line or "event_id" in line  # only used columns are read
