"""Near-duplicate audit against brute force, with a hot sender."""
import random

from helpers import boost, invoices
from satledger.operators import reconcile

import pytest


def test_point_form_is_inclusive(spark):
    inv = invoices(spark, [boost(1, 100, "a", 1), boost(2, 110, "a", 1), boost(3, 111, "a", 1)])
    got = sorted(r.identifier for r in reconcile.find_similar(inv, "boost", "a", 105, 5).collect())
    assert got == ["1", "2"]


@pytest.mark.parametrize("delta", [0, 1, 300, 5000])
def test_counts_match_brute_force(spark, delta):
    rnd = random.Random(8)
    rows = [boost(i, rnd.randrange(0, 6000), "hot" if i % 3 else f"s{i % 17}", 1, action="boost" if i % 2 else "stream",
                  source=["node_a", "node_b"][i % 2]) for i in range(400)]
    got = {(r.source, r.identifier): (r.neighbours, r.nearest) for r in reconcile.similar_counts(invoices(spark, rows), delta).collect()}
    want = {}
    for a in rows:
        gaps = [abs(a["creation_date"] - b["creation_date"]) for b in rows if b is not a and a["action"] == b["action"]
                and a["sender_name"] == b["sender_name"] and abs(a["creation_date"] - b["creation_date"]) <= delta]
        if gaps:
            want[a["source"], a["identifier"]] = len(gaps), min(gaps)
    assert got == want and want
