"""Plan-shape guards for every registered query: the physical plan must stay
scalable (no cartesian or nested-loop joins, no Python evaluation, no window
over a possibly hot key, groups collected only where bounded)."""
import pytest

import __spark_entry__ as E
from conftest import SF0001
from satledger.plans import catalog

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "Window ", "WindowGroupLimit"]
# collect_list only groups one landing page (at most 100 invoices), or the pages of one file.
# Windows over bounded partitions: the seconds of three buckets.
BOUNDED_WINDOW = {"similar_payments"}
BOUNDED_COLLECT = {"decode_payload", "decode_quarantine", "stream_ingest", "markdown_directory"}


def plan_text(df):
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_plan_is_scalable(spark, key):
    text = plan_text(E.queries()[key](spark, SF0001))
    for bad in FORBIDDEN if key not in BOUNDED_WINDOW else [b for b in FORBIDDEN if b != "Window "]:
        assert bad not in text, f"{key}: {bad}"
    if key not in BOUNDED_COLLECT:
        assert "collect_list" not in text and "collect_set" not in text, key


def test_aggregates_are_partial(spark):
    text = E.queries()["report_senders"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and "partial_min" in text
    assert text.count("Exchange hashpartitioning") == 1
