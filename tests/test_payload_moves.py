"""What is moved to check payloads: lines of orders only, not the files, digests and bytes made of them."""

from __future__ import annotations

import re

from skillcorpus.plans import ledger_queries
from skillcorpus.plans.registry import QUERIES


def test_only_lines_are_moved(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(ledger_queries, "cut", lambda df, name: written.append(name) or df)
    plan = QUERIES["catalog_payloads"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"(?<!Broadcast)Exchange .*", plan)
    assert not written and moved and all("hashpartitioning(l_orderkey" in m and "REPARTITION_BY_NUM" in m for m in moved)
